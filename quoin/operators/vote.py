"""N-of-M voting over the readings of a line.

Readings: key columns, engine_ord (order of the engines), engine, text, score; a failed reading is ('', 0.0). One shuffle
and one sort, by key and text, give everything: the first window deals the rows by their key alone, and all that follows
keeps to that. Ties go to the text or engine that comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def vote(readings: DataFrame, key: list[str], threshold: float, preferred: str | None = None, min_agree: int = 2, lines: DataFrame | None = None, with_readings: bool = False) -> DataFrame:
    """key, bucket, text, engine, diverged for each line, and with_readings engines: array of (engine, text, score) in
    engine order; `lines` adds keys that have no reading at all, and its further columns."""
    more = ["engines"] if with_readings else []
    same, by_text = Window.partitionBy(*key, "text"), Window.partitionBy(*key).orderBy("text")
    rows = readings.withColumn("nth_text", F.dense_rank().over(by_text)).withColumn("votes", F.count(F.lit(1)).over(same)).withColumn("first_ord", F.min("engine_ord").over(same))
    reading = F.struct("text", "engine", "score")
    held = (F.col("text") != "") & (F.col("score") >= threshold)
    out = rows.groupBy(*key).agg(
        F.max_by(reading, F.struct(F.col("score"), -F.col("engine_ord"))).alias("best"),
        F.max_by(F.when(F.col("engine") == F.lit(preferred), reading), F.when(F.col("engine") == F.lit(preferred), -F.col("engine_ord"))).alias("pref"),
        F.max_by(
            F.when(F.col("text") != "", F.struct("text", "engine", "votes")),
            F.when(F.col("text") != "", F.struct(F.col("votes"), -F.col("first_ord"), -F.col("engine_ord"))),
        ).alias("most"),
        F.coalesce(F.min(F.when(held, F.col("nth_text"))) < F.max(F.when(held, F.col("nth_text"))), F.lit(False)).alias("diverged"),
        *([_engines().alias("engines")] if with_readings else []),
    )
    if min_agree >= 2:
        hint = F.when(F.col("pref.text") != "", F.col("pref")).otherwise(F.col("best"))
        agreed = F.coalesce(F.col("most.votes") >= min_agree, F.lit(False))
        chosen = F.when(agreed, F.struct("most.text", "most.engine")).otherwise(F.struct(hint["text"].alias("text"), hint["engine"].alias("engine")))
        bucket = F.when(agreed, "good").otherwise("needs_review")
    else:
        first = F.coalesce(F.col("pref.score") >= threshold, F.lit(False))
        chosen = F.when(first, F.struct("pref.text", "pref.engine")).otherwise(F.struct("best.text", "best.engine"))
        bucket = F.when(first | (F.col("best.score") >= threshold), "good").otherwise("needs_review")
    out = out.select(*key, bucket.alias("bucket"), chosen["text"].alias("text"), chosen["engine"].alias("engine"), "diverged", *more)
    if lines is None:
        return out
    return lines.join(out, key, "left").select(
        *lines.columns, F.coalesce("bucket", F.lit("needs_review")).alias("bucket"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("engine", F.lit("")).alias("engine"), F.coalesce("diverged", F.lit(False)).alias("diverged"),
        *[F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c) for c in more],
    )


def _engines() -> Column:
    rows = F.sort_array(F.collect_list(F.struct("engine_ord", "engine", "text", "score")))
    return F.transform(rows, lambda e: F.struct(e["engine"].alias("engine"), e["text"].alias("text"), e["score"].alias("score")))


def hints(readings: DataFrame, key: list[str], preferred: str | None) -> DataFrame:
    """key, engine, text: the preferred engine's reading if it isn't empty, else the surest."""
    reading = F.struct("engine", "text")
    best = F.max_by(reading, F.struct(F.col("score"), -F.col("engine_ord")))
    own = F.min_by(reading, F.when((F.col("engine") == F.lit(preferred)) & (F.col("text") != ""), F.col("engine_ord")))
    return readings.groupBy(*key).agg(F.coalesce(own, best).alias("hint")).select(*key, "hint.*")


def split_multiline(readings: DataFrame, key: list[str], detector: str) -> tuple[DataFrame, DataFrame]:
    """(readings to vote on, keys of dropped lines): with the surya detector a line of which any reading holds a line
    break is a merged box, dropped and counted as an error."""
    if detector != "surya":
        return readings, readings.select(*key).limit(0)
    merged = readings.withColumn("_merged", F.max(F.contains("text", F.lit("\n"))).over(Window.partitionBy(*key)))
    return merged.filter("not _merged").drop("_merged"), merged.filter("_merged").select(*key).distinct()
