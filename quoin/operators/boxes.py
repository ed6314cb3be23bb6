"""Matching the boxes of several engines on a page, one to one, by overlap.

Boxes: key columns of a page, engine_ord, engine, idx, x0, y0, x1, y1 (double), text. Boxes meet over the cells of a grid of
about their own size, so a page with very many boxes is spread over tasks and only neighbours are compared. The greedy order
is a fold over the pairs that overlap enough, streamed in order; a box without such a pair is a group of its own and never
reaches it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions.geometry import big_enough, clamped_bbox, iou
from quoin.functions.text import postprocess
from quoin.session import ship

MEMBER = "struct<e:int,i:int,engine:string,x0:double,y0:double,x1:double,y1:double,text:string>"
SIDES = ["x0", "y0", "x1", "y1"]


def overlaps(boxes: DataFrame, page: list[str], threshold: float) -> DataFrame:
    """page, a_e, a_i, b_e, b_i, iou: the pairs of boxes of different engines, the earlier engine's first, whose overlap is at
    least `threshold`, which is over 0. A pair counts in the one cell that holds the upper left corner of what they share."""
    if threshold <= 0:
        raise ValueError("threshold must be over 0")
    rows = boxes.select(*page, F.col("engine_ord").cast("int").alias("e"), F.col("idx").cast("int").alias("i"), F.struct(*[F.col(c).cast("double").alias(c) for c in SIDES]).alias("b"))
    on_page = Window.partitionBy(*page)
    size = lambda low, high: F.greatest(F.avg(F.col(f"b.{high}") - F.col(f"b.{low}")).over(on_page), F.lit(1.0))
    rows = rows.withColumn("_w", size("x0", "x1")).withColumn("_h", size("y0", "y1"))
    at = lambda value, step: F.floor(value / step)
    span = lambda low, high, step: F.explode(F.sequence(at(F.col(f"b.{low}"), F.col(step)), F.greatest(at(F.col(f"b.{low}"), F.col(step)), at(F.col(f"b.{high}"), F.col(step)))))
    cells = rows.withColumn("_cx", span("x0", "x1", "_w")).withColumn("_cy", span("y0", "y1", "_h"))
    side = lambda n: cells.select(*page, "_cx", "_cy", *[F.col(c).alias(f"{n}_{c}") for c in "eib"], *(["_w", "_h"] if n == "a" else []))
    met = side("a").join(side("b"), [*page, "_cx", "_cy"]).filter("a_e < b_e")
    corner = lambda c: F.greatest(F.col(f"a_b.{c}"), F.col(f"b_b.{c}"))
    met = met.filter((at(corner("x0"), F.col("_w")) == F.col("_cx")) & (at(corner("y0"), F.col("_h")) == F.col("_cy")))
    return met.select(*page, "a_e", "a_i", "b_e", "b_i", iou(F.col("a_b"), F.col("b_b")).alias("iou")).filter(F.col("iou") >= threshold)


def _taken(pairs: DataFrame, page: list[str]) -> DataFrame:
    """page, e, i, a_e, a_i: each box that an anchor takes. Anchors come in order of (engine, index); one that is taken itself
    takes none, and the others take of each later engine the free box of greatest overlap, of equals the last."""
    ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = anchor = engine = None
        used: set[tuple] = set()
        free = False
        for batch in batches:
            keep, columns = [], [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for k, row in enumerate(zip(*columns, strict=True)):
                here, a, b = row[:-5], row[-5:-3], row[-3:-1]
                if here != key:
                    key, anchor, used = here, None, set()
                if a != anchor:
                    anchor, engine, free = a, None, a not in used
                if free and b[0] != engine and b not in used:
                    engine = b[0]
                    used.add(b)
                    keep.append(k)
            if keep:
                yield batch.take(pa.array(keep)).select(list(range(batch.num_columns - 1)))

    order = [*page, "a_e", "a_i", "b_e", F.col("iou").desc(), F.col("b_i").desc()]
    rows = pairs.select(*page, "a_e", "a_i", "b_e", "b_i", "iou").repartition(*page).sortWithinPartitions(*order)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns if c != "iou")
    return rows.mapInArrow(run, kinds).select(*page, F.col("b_e").alias("e"), F.col("b_i").alias("i"), "a_e", "a_i")


def group_by_iou(boxes: DataFrame, page: list[str], threshold: float = 0.5) -> DataFrame:
    """page, grp (from 0, in order), members (array, the anchor first). Boxes in order of (engine, index) are anchors; each
    takes from every later engine the unused box of greatest overlap, at least `threshold`, the last of equals."""
    one = F.struct(
        F.col("engine_ord").cast("int").alias("e"), F.col("idx").cast("int").alias("i"), "engine", F.col("x0").cast("double").alias("x0"), F.col("y0").cast("double").alias("y0"),
        F.col("x1").cast("double").alias("x1"), F.col("y1").cast("double").alias("y1"), "text",
    )
    taken = _taken(overlaps(boxes, page, threshold), page)
    # Boxes and what has become of them lie together by page, dealt once: a box's group, the groups' order, and the groups.
    rows = boxes.select(*page, F.col("engine_ord").cast("int").alias("e"), F.col("idx").cast("int").alias("i"), one.alias("m")).unionByName(taken, allowMissingColumns=True)
    own = Window.partitionBy(*page, "e", "i")
    anchor = F.coalesce(F.max(F.when(F.col("a_e").isNotNull(), F.struct("a_e", "a_i"))).over(own), F.struct(F.col("e").alias("a_e"), F.col("i").alias("a_i")))
    rows = rows.repartition(*page).withColumn("a", anchor).filter("m is not null")
    rows = rows.withColumn("grp", F.dense_rank().over(Window.partitionBy(*page).orderBy("a")) - 1)
    return rows.groupBy(*page, "grp").agg(F.array_sort(F.collect_list("m")).alias("members"))


def resolve(groups: DataFrame, min_agree: int = 1) -> DataFrame:
    """groups with bucket, text, engine, diverged: the most frequent text that isn't empty, the first of equals."""
    said = F.filter(F.transform("members", lambda m: F.struct(m["engine"].alias("engine"), postprocess(m["text"]).alias("text"))), lambda m: m["text"] != "")
    rows = groups.withColumn("_said", said)
    counted = F.transform(
        "_said", lambda m, i: F.struct(F.size(F.filter("_said", lambda o: o["text"] == m["text"])).alias("n"), (-i).alias("at"), m["text"].alias("text"), m["engine"].alias("engine"))
    )
    rows = rows.withColumn("_top", F.array_max(counted))
    bucket = F.when(F.col("_top.n") >= min_agree, "good").otherwise("needs_review")
    diverged = F.size(F.array_distinct(F.transform("_said", lambda m: m["text"]))) >= 2
    return rows.select(*groups.columns, bucket.alias("bucket"), F.coalesce("_top.text", F.lit("")).alias("text"), F.coalesce("_top.engine", F.lit("")).alias("engine"), diverged.alias("diverged"))


def dedup_groups(resolved: DataFrame, page: list[str]) -> DataFrame:
    """resolved without groups whose text, not empty, is that of an earlier kept group which their box touches. The groups
    of a page with one text meet once, as one row; a group without text is a row of its own."""
    row = F.struct("grp", *[F.col(c) for c in resolved.columns if c not in (*page, "grp", "text")])
    alone = F.when(F.col("text") == "", F.col("grp"))
    met = resolved.groupBy(*page, "text", alone.alias("_alone")).agg(F.sort_array(F.collect_list(F.struct("grp", row.alias("row")))).alias("_all"))

    def step(kept: Column, g: Column) -> Column:
        box = lambda r: r["row"]["members"][0]
        return F.when(F.exists(kept, lambda k: iou(box(k), box(g)) > 0), kept).otherwise(F.concat(kept, F.array(g)))

    kept = F.when(F.size("_all") == 1, F.col("_all")).otherwise(F.aggregate("_all", F.slice("_all", 1, 0), step))
    return met.select(*page, "text", F.explode(kept).alias("_kept")).select(*page, "text", "_kept.row.*").select(*resolved.columns)


def crops(groups: DataFrame, width: Column, height: Column) -> DataFrame:
    """groups with crop (whole pixels), without those of 10 pixels or less on a side."""
    rows = groups.withColumn("crop", clamped_bbox(F.col("members")[0], width, height))
    return rows.filter(big_enough(F.col("crop.x1") - F.col("crop.x0"), F.col("crop.y1") - F.col("crop.y0")))
