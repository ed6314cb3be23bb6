"""Views over the given tables that feed the queries: readings, boxes, words, catalogues and job logs by plain integer
arithmetic, as DataFrames and, for the oracle, as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.storage import is_folder

ENGINES = ["paddle", "surya", "tesseract"]
VLM_ENGINES = ["paddleocr_vl", "hunyuan_ocr", "glm_ocr"]
LATIN, LOOKING_ALIKE = "ABCEHKMOPTXaceopxy", "АВСЕНКМОРТХасеорху"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; the table may be one file or a folder of files."""
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    path = f"{sf_dir}/{name}.parquet"
    return reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def lines(spark: SparkSession, sf_dir: str, grouped: bool = False) -> DataFrame:
    """doc_id, line_no (from 0), text of every line of every document. grouped: documents are dealt by doc_id before they
    become rows, so that what groups by line or page shuffles a text once, not each of its rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.repartition("doc_id") if grouped else docs
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).withColumn("line_no", F.col("line_no").cast("long"))


def mixed(*terms: tuple[Column, int]) -> Column:
    total = None
    for c, f in terms:
        total = c * f if total is None else total + c * f
    return F.pmod(total, F.lit(1000))


def _variant(text: Column, h: Column) -> Column:
    d = h % 10
    return F.when(d < 6, text).when(d < 8, F.replace(text, F.lit("e"), F.lit("c"))).when(d == 8, F.lit("")).otherwise(F.replace(text, F.lit("o"), F.lit("0")))


def _engines(names: list[str]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("engine_ord"), F.lit(e).alias("engine")) for k, e in enumerate(names)]))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, engine_ord, engine, text, score: three engines that differ on some lines."""
    rows = lines(spark, sf_dir, True).withColumn("e", _engines(ENGINES))
    h = mixed((F.col("doc_id"), 7919), (F.col("line_no"), 104_729), (F.col("e.engine_ord"), 1_299_709))
    return rows.select("doc_id", "line_no", "e.engine_ord", "e.engine", _variant(F.col("text"), h).alias("text"), ((h % 101) / F.lit(100.0)).alias("score"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page (twelve lines each), engine_ord, engine, idx, x0, y0, x1, y1, text; each ninth box is missing."""
    rows = lines(spark, sf_dir, True).withColumn("e", _engines(VLM_ENGINES))
    h = mixed((F.col("doc_id"), 31), (F.col("line_no"), 104_729), (F.col("e.engine_ord"), 1_299_709))
    rows = rows.withColumn("h", h).filter(F.col("h") % 9 != 0)
    page, idx = F.floor(F.col("line_no") / 12), F.col("line_no") % 12
    x0, y0 = F.col("h") % 5, idx * 18 + F.col("h") % 7
    text = F.when(F.col("h") % 4 == 0, F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("  ")))).otherwise(_variant(F.col("text"), F.col("h")))
    return rows.select(
        "doc_id", page.alias("page"), "e.engine_ord", "e.engine", idx.cast("int").alias("idx"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"),
        (x0 + 8 * F.least(F.length("text"), F.lit(100)) + 1).cast("double").alias("x1"), (y0 + 9 + F.col("h") % 8).cast("double").alias("y1"), text.alias("text"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page (twenty lines each), pos, word: every third document in Cyrillic look-alikes, every fifth with words
    that are broken into letters."""
    rows = lines(spark, sf_dir, True).select("doc_id", "line_no", F.posexplode(F.split("text", " ")).alias("k", "word")).filter("word <> ''")
    word = F.when((F.col("doc_id") % 5 == 0) & (F.col("k") % 40).isin(1, 2, 3, 4), F.substring("word", 1, 1)).otherwise(F.col("word"))
    word = F.when(F.col("k") % 97 == 7, F.lit("19B6")).otherwise(word)
    word = F.when(F.col("doc_id") % 3 == 0, F.translate(word, LATIN, LOOKING_ALIKE)).otherwise(word)
    return rows.select("doc_id", F.floor(F.col("line_no") / 20).alias("page"), (F.col("line_no") * 1_000_000 + F.col("k")).alias("pos"), word.alias("word"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, grp, designation, date, sha1, mime, width, license, title, text of documents as catalogue entries."""
    d = F.col("doc_id")
    tail = F.when(d % 2 == 0, F.format_string("%02d", d % 100)).otherwise((1900 + d % 120).cast("string"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("grp"), F.concat(F.lit("RD "), d, F.lit("-"), tail).alias("designation"),
        F.when(d % 4 == 0, F.format_string("%02d.%02d.%d", d % 28 + 1, d % 12 + 1, 1950 + d % 90)).otherwise("").alias("date"),
        F.sha2("text", 256).alias("sha"), F.element_at(F.array(*[F.lit(m) for m in ["image/jpeg", "image/png", "image/tiff", "image/svg+xml"]]), (d % 4 + 1).cast("int")).alias("mime"),
        (d * 37 % 3000).alias("width"), F.when(d % 3 == 0, "Public Domain").when(d % 3 == 1, "CC BY-SA 4.0").otherwise("").alias("license"),
        F.concat(F.lit("File:"), F.col("source"), F.lit(" "), 1650 + d % 500, F.lit(".jpeg")).alias("title"), "text",
    )


def job_log(events: DataFrame, *more: str) -> DataFrame:
    """job_id, seq, kind, bucket, diverged, msg and further columns of events; also of a stream of events."""
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"),
        F.when(kind == "purchase", "file_done").when(kind == "error", "error").otherwise("line").alias("kind"),
        F.when(kind.isin("click", "signup"), "good").when(kind == "view", "needs_review").alias("bucket"), (kind == "signup").alias("diverged"),
        F.concat(F.lit("message "), F.col("event_id")).alias("msg"), *more,
    )


_H = "(doc_id * {a} + line_no * 104729 + engine_ord * 1299709) % 1000"
_VARIANT = "CASE WHEN h % 10 < 6 THEN text WHEN h % 10 < 8 THEN replace(text, 'e', 'c') WHEN h % 10 = 8 THEN '' ELSE replace(text, 'o', '0') END"
_VALUES = lambda names: ", ".join(f"({k}, '{e}')" for k, e in enumerate(names))
#: The same views for the oracle, by name; each needs those before it.
SQL = {
    "lines": "SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)",
    "readings": f"""SELECT doc_id, line_no, engine_ord, engine, {_VARIANT} AS text, (h % 101) / 100.0::DOUBLE AS score
      FROM (SELECT *, {_H.format(a=7919)} AS h FROM lines, (VALUES {_VALUES(ENGINES)}) e(engine_ord, engine))""",
    "boxes": f"""SELECT doc_id, line_no // 12 AS page, engine_ord, engine, CAST(line_no % 12 AS INT) AS idx, (h % 5)::DOUBLE AS x0, (line_no % 12 * 18 + h % 7)::DOUBLE AS y0,
        (h % 5 + 8 * least(length(text), 100) + 1)::DOUBLE AS x1, (line_no % 12 * 18 + h % 7 + 9 + h % 8)::DOUBLE AS y1,
        CASE WHEN h % 4 = 0 THEN '  ' || replace(text, ' ', '  ') ELSE {_VARIANT} END AS text
      FROM (SELECT *, {_H.format(a=31)} AS h FROM lines, (VALUES {_VALUES(VLM_ENGINES)}) e(engine_ord, engine)) WHERE h % 9 <> 0""",
    "words": f"""SELECT doc_id, line_no // 20 AS page, line_no * 1000000 + k AS pos, CASE WHEN doc_id % 3 = 0 THEN translate(w, '{LATIN}', '{LOOKING_ALIKE}') ELSE w END AS word
      FROM (SELECT doc_id, line_no, k, CASE WHEN k % 97 = 7 THEN '19B6' WHEN doc_id % 5 = 0 AND k % 40 IN (1, 2, 3, 4) THEN left(w, 1) ELSE w END AS w
            FROM (SELECT doc_id, line_no, unnest(range(len(a))) AS k, unnest(a) AS w FROM (SELECT doc_id, line_no, string_split(text, ' ') AS a FROM lines)) WHERE w <> '')""",
    "catalog": """SELECT doc_id, source AS grp, 'RD ' || doc_id || '-' || CASE WHEN doc_id % 2 = 0 THEN printf('%02d', doc_id % 100) ELSE CAST(1900 + doc_id % 120 AS VARCHAR) END AS designation,
        CASE WHEN doc_id % 4 = 0 THEN printf('%02d.%02d.%d', doc_id % 28 + 1, doc_id % 12 + 1, 1950 + doc_id % 90) ELSE '' END AS date, sha256(text) AS sha,
        ['image/jpeg', 'image/png', 'image/tiff', 'image/svg+xml'][doc_id % 4 + 1] AS mime, doc_id * 37 % 3000 AS width,
        CASE doc_id % 3 WHEN 0 THEN 'Public Domain' WHEN 1 THEN 'CC BY-SA 4.0' ELSE '' END AS license, 'File:' || source || ' ' || (1650 + doc_id % 500) || '.jpeg' AS title, text FROM documents""",
    "job_log": """SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'file_done' WHEN 'error' THEN 'error' ELSE 'line' END AS kind,
        CASE WHEN event_type IN ('click', 'signup') THEN 'good' WHEN event_type = 'view' THEN 'needs_review' END AS bucket, event_type = 'signup' AS diverged, 'message ' || event_id AS msg FROM events""",
}
NEEDS = {"readings": ["lines"], "boxes": ["lines"], "words": ["lines"]}


def with_views(views: str, sql: str) -> str:
    """sql with the named views (and what they need) in front; sql may go on with `WITH` or `WITH RECURSIVE`."""
    names: list[str] = []
    for v in views.split():
        names += [n for n in [*NEEDS.get(v, []), v] if n not in names]
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    sql = sql.strip()
    for word in ("WITH RECURSIVE", "WITH"):
        if sql.startswith(word + " "):
            return f"{word} {head}, {sql[len(word) :].strip()}"
    return f"WITH {head} {sql}"
