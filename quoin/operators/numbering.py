"""Global, resumable numbering of lines, and the crop paths that follow from it."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.scratch import stored

PER_FOLDER = 10_000
CROP = r"^image_([0-9]+)\.webp$"


def number_rows(rows: DataFrame, order: list[str], start: int = 1, name: str = "n") -> DataFrame:
    """rows with consecutive numbers in the order of `order`, which must tell all rows apart. Range partitions are sorted
    and counted; a row's number is its place plus the rows of the partitions before, so no task sees all rows."""
    spark = rows.sparkSession
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(placed, "numbered")  # counting and numbering see the same partitions
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count(F.lit(1)).alias("rows")).orderBy("_part").collect()
    bases, seen = [], start
    for s in sizes:
        bases.append({"_part": s["_part"], "_base": seen})
        seen += s["rows"]
    base = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(bases)), "array<struct<_part:bigint,_base:bigint>>")))
    out = placed.join(F.broadcast(base), F.shiftright("_at", 33) == F.col("_part"))  # a row for each partition
    return out.withColumn(name, F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_base")


def rank_within(rows: DataFrame, group: str, order: list[str], name: str = "rank") -> DataFrame:
    """rows with consecutive numbers from 1 in each group, in the order of `order`. A group may lie over many range
    partitions; only a row for each partition and group is added up."""
    order = [group, *order]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(placed, "ranked")
    runs = placed.groupBy(F.shiftright("_at", 33).alias("_part"), F.col(group).alias("_group")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    out = placed.join(runs, (F.shiftright("_at", 33) == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return out.withColumn(name, F.col("_at") - F.col("_first") + F.col("_base") + 1).select(*rows.columns, name)


def crop_path(n: Column) -> Column:
    return F.format_string("crops/%d/image_%05d.webp", F.floor(n / PER_FOLDER), n)


def resume_from(paths: DataFrame, path: str = "path") -> DataFrame:
    """One row, next: the number after the greatest among files named image_N.webp, directly or one folder deep."""
    name = F.element_at(F.split(path, "/"), -1)
    n = F.regexp_extract(name, CROP, 1).try_cast("long")
    return paths.filter(F.size(F.split(path, "/")) <= 2).agg((F.coalesce(F.max(n), F.lit(0)) + 1).alias("next"))
