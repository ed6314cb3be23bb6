"""Quality of a page's embedded words, the gate that it opens, and a document's diagnosis.

Words: key columns of a page, pos, word. One shuffle by page and one sort; a document's pages are aggregated from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions.quality import MIN_PAGE_WORDS, MIN_SPACED_RUN, PAGE_MIN_QUALITY, core_ok, is_letter, letter_balance, word_core


def mark_words(words: DataFrame, page: list[str]) -> DataFrame:
    """words with single, spaced (in a run of single letters), cyrillic (of the page) and ok."""
    order, whole = Window.partitionBy(*page).orderBy("pos"), Window.partitionBy(*page)
    # The cleaned word is a column of its own up to the end, so that it is made once.
    out = words.withColumn("core", word_core(F.col("word"))).withColumn("balance", letter_balance(F.col("word")))
    out = out.withColumn("single", is_letter(F.col("core")))
    # A letter is in a long run if any stretch of MIN_SPACED_RUN words around it is all single letters.
    n = MIN_SPACED_RUN
    runs = [F.sum(F.col("single").cast("int")).over(order.rowsBetween(-k, n - 1 - k)) for k in range(n)]
    out = out.withColumn("spaced", F.col("single") & (F.greatest(*runs) >= n))
    out = out.withColumn("cyrillic", F.sum("balance").over(whole) > 0)
    return out.withColumn("ok", core_ok(F.col("core"), F.col("cyrillic"))).drop("core", "balance")


def page_quality(words: DataFrame, page: list[str], pages: DataFrame | None = None) -> DataFrame:
    """page, n_words, quality (share of characters in plausible words; 0.0 without any), measured (rounded to 3, null
    under 5 words) and usable; `pages` adds those without words."""
    good = F.when(F.col("ok") & ~F.col("spaced"), F.length("word")).otherwise(0)
    out = mark_words(words, page).groupBy(*page).agg(F.count(F.lit(1)).alias("n_words"), F.sum(good).alias("good"), F.sum(F.length("word")).alias("chars"))
    if pages is not None:
        out = pages.select(*page).join(out, page, "left")
    out = out.withColumn("n_words", F.coalesce("n_words", F.lit(0)))
    quality = F.when(F.col("chars") > 0, F.col("good").cast("double") / F.nullif(F.col("chars"), F.lit(0))).otherwise(F.lit(0.0))
    out = out.withColumn("quality", quality)
    measured = F.when(F.col("n_words") >= MIN_PAGE_WORDS, F.bround("quality", 3))
    usable = F.when(F.col("n_words") == 0, False).when(F.col("n_words") < MIN_PAGE_WORDS, True).otherwise(F.col("quality") >= PAGE_MIN_QUALITY)
    return out.select(*page, "n_words", "quality", measured.alias("measured"), usable.alias("usable"))


def diagnose(pages: DataFrame, doc: list[str], page: str = "page") -> DataFrame:
    """doc, pages_without_text, usable_pages, median_quality, page_quality, recommend; pages as page_quality gives them."""
    out = pages.groupBy(*doc).agg(
        F.count_if(F.col("n_words") == 0).alias("pages_without_text"), F.count_if(F.col("n_words") > 0).alias("with_text"), F.count_if("usable").alias("usable_pages"),
        F.bround(F.median("measured"), 3).alias("median_quality"),
        F.transform(F.sort_array(F.collect_list(F.struct(page, "measured"))), lambda p: p["measured"]).alias("page_quality"),
    )
    recommend = F.when((F.col("with_text") > 0) & (F.col("usable_pages") == F.col("with_text")), "text_layer").when(F.col("usable_pages") > 0, "mixed").otherwise("ocr")
    return out.select(*doc, "pages_without_text", "usable_pages", "median_quality", "page_quality", recommend.alias("recommend"))


def diagnose_files(files: DataFrame, pages: DataFrame, doc: list[str], page: str = "page") -> DataFrame:
    """files (doc.., error: why a file could not be read, else null) with the diagnosis of their pages and recommend: an
    unreadable file, and one without any page, is for OCR; the rest of an unreadable file's diagnosis is null."""
    out = files.select(*doc, "error").join(diagnose(pages, doc, page), doc, "left")
    told = [c for c in out.columns if c not in (*doc, "error", "recommend")]
    bad = F.col("error").isNotNull()
    return out.select(*doc, "error", *[F.when(~bad, F.col(c)).alias(c) for c in told], F.when(bad, "ocr").otherwise(F.coalesce("recommend", F.lit("ocr"))).alias("recommend"))


def route(pages: DataFrame, use_text_layer: bool = True, ocr_fallback: bool = True) -> DataFrame:
    """pages with route: text_layer, ocr, or skip when there is no fallback; an unread gate means OCR."""
    usable = F.coalesce(F.col("usable"), F.lit(False)) & F.lit(use_text_layer)
    return pages.withColumn("route", F.when(usable, "text_layer").otherwise("ocr" if ocr_fallback else "skip"))
