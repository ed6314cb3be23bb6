"""Labelling records: machine lines and human edits as tables that are merged, filtered, paged and counted.

A line is (ord, value): the text of a row of a label file and its place. A record is (name, ord, path, text, w, h, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions.text import image_name, split_crop_size, strip

IMAGES = r"(?i)\.(jpg|jpeg|png|bmp|tif|tiff|webp)$"
#: Priority of the files that records come from.
PRIORITY = {"review": 0, "good": 1, "needs_review": 2}


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """lines with path, name, text, w, h; blank lines fall away."""
    rows = lines.filter(strip(F.col(value)) != "")
    parts = F.split(value, "\t", 2)
    sized = split_crop_size(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    rows = rows.withColumn("path", strip(F.get(parts, F.lit(0)))).withColumn("name", image_name(F.col(value))).withColumn("_s", sized)
    return rows.withColumn("text", strip(F.col("_s.text"))).withColumn("w", F.col("_s.w")).withColumn("h", F.col("_s.h")).drop("_s")


def inside(path: Column) -> Column:
    """Whether a relative path stays inside its folder: no prefix of it goes up more often than down."""
    steps = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(
        steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")),
        lambda acc, p: F.struct((acc["at"] + F.when(p == "..", -1).otherwise(1)).alias("at"), F.least(acc["low"], acc["at"] + F.when(p == "..", -1).otherwise(1)).alias("low")),
    )
    return ~path.startswith("/") & (depth["low"] >= 0)


def records(parsed: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, rows whose image is missing). A name has the place of its first line and the values of its last. `files`
    (path) are the images that exist."""
    rows = parsed.filter(inside(F.col("path")))
    images = rows.filter(F.col("path").rlike(IMAGES))
    missing = images.limit(0)
    if files is not None:
        here = files.select("path").distinct()
        missing, images = images.join(here, "path", "left_anti"), images.join(here, "path", "left_semi")
    value = F.struct("path", "text", "w", "h")
    out = images.groupBy("name").agg(F.min("ord").alias("ord"), F.max_by(value, "ord").alias("_v"))
    return out.select("name", "ord", "_v.*"), missing


def merge_sources(parsed: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """parsed with src (review, good or needs_review): one record a name, of the first source in this order that has it;
    records of good are done, and so marked."""
    rows = parsed.filter(inside(F.col("path")) & F.col("path").rlike(IMAGES))
    if files is not None:
        rows = rows.join(files.select("path").distinct(), "path", "left_semi")
    prio = F.element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), F.col("src"))
    value = F.struct("path", "text", "w", "h", "src")
    rows = rows.withColumn("_prio", prio)
    out = rows.groupBy("name").agg(F.max_by(value, F.struct(-F.col("_prio"), F.col("ord"))).alias("_v"), F.min(F.struct("_prio", "ord")).alias("_first"))
    return out.select("name", F.col("_first.ord").alias("ord"), "_v.*", (F.col("_v.src") == "good").alias("is_marked"))


def with_status(recs: DataFrame, marked: DataFrame) -> DataFrame:
    """recs with is_marked also for the names in `marked` (name)."""
    names = marked.select(F.col("name"), F.lit(True).alias("_marked")).distinct()
    own = F.col("is_marked") if "is_marked" in recs.columns else F.lit(False)
    return recs.join(names, "name", "left").withColumn("is_marked", F.coalesce("_marked", own)).drop("_marked")


def with_debug(recs: DataFrame, debug: DataFrame) -> DataFrame:
    """recs with diverged of the last debug record of their path; debug (ord, crop, diverged)."""
    last = debug.groupBy(F.col("crop").alias("_crop")).agg(F.max_by(F.coalesce("diverged", F.lit(False)), "ord").alias("diverged"))
    return recs.drop("diverged").join(last, F.col("path") == F.col("_crop"), "left").withColumn("diverged", F.coalesce("diverged", F.lit(False))).drop("_crop")


def apply_edits(recs: DataFrame, edits: DataFrame) -> DataFrame:
    """recs with the last edit of each name; an edited record is marked. edits (name, ord, text)."""
    last = edits.groupBy("name").agg(F.max_by("text", "ord").alias("_text"), F.lit(True).alias("_edited"))
    own = F.col("is_marked") if "is_marked" in recs.columns else F.lit(False)
    out = recs.join(last, "name", "left").withColumn("text", F.when(F.col("_edited"), F.col("_text")).otherwise(F.col("text")))
    return out.withColumn("is_marked", F.coalesce(F.col("_edited"), F.lit(False)) | own).drop("_text", "_edited")


def delete(recs: DataFrame, names: DataFrame) -> DataFrame:
    return recs.join(names.select("name").distinct(), "name", "left_anti")


def select_records(recs: DataFrame, which: str = "all") -> DataFrame:
    """all, unmarked, marked or diverged."""
    return {"all": recs, "unmarked": recs.filter("not is_marked"), "marked": recs.filter("is_marked"), "diverged": recs.filter("diverged")}[which]


def page_of(recs: DataFrame, page: int, size: int = 50, order: str = "ord") -> DataFrame:
    """One page of the list; a page beyond the last is the last."""
    last = max(0, -(-recs.count() // size) - 1)
    return recs.orderBy(order).offset(min(max(page, 0), last) * size).limit(size)


def stats(recs: DataFrame, *group: str) -> DataFrame:
    total, marked = F.count(F.lit(1)), F.count_if("is_marked")
    return recs.groupBy(*group).agg(total.alias("total"), marked.alias("marked"), (total - marked).alias("remaining"), F.when(total > 0, F.floor(marked * 100 / total)).otherwise(0).cast("long").alias("percent"))


def keep_last(rows: DataFrame, n: int, order: str, *group: str) -> DataFrame:
    """The last n rows (of each group) in order of insertion."""
    last = Window.partitionBy(*group).orderBy(F.col(order).desc())
    return rows.withColumn("_rn", F.row_number().over(last)).filter(F.col("_rn") <= n).drop("_rn")


def append_new(old: DataFrame, new: DataFrame, line: str = "line") -> DataFrame:
    """old and those lines of new that it has not, each once."""
    return old.select(line).unionByName(new.select(line).distinct().join(old.select(line), line, "left_anti"))
