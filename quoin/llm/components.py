"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.scratch import drop, stored

ROWS = 100_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b), long, in any order. Gives (node, root) for each node of an edge but the roots: root is the smallest
    node of its component. Each step groups by a node with a partial minimum on the map side and joins that minimum to
    the edges, so a node with very many neighbours is never gathered; AQE splits such a node in the join."""
    now = stored(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct(), "edges")
    size = _mark(now)
    # Steps are small tables next to the corpus; they are written by a task for each ROWS edges, not by every partition.
    few = lambda df: df.coalesce(max(1, -(-2 * size[0] // ROWS)))
    for _ in range(most_rounds):
        # Large star: each neighbour v greater than node u hangs on the smallest neighbour of u, or on u itself.
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, both["u"] == least["n"]).filter("v > u").select("v", F.col("m").alias("u")).filter("u < v").distinct()
        large = stored(few(large), "large-star")
        # Small star: node v and its smaller neighbours hang on the smallest of them.
        least = large.groupBy(F.col("v").alias("n")).agg(F.min("u").alias("m"))
        small = large.join(least, large["v"] == least["n"]).select(F.col("u").alias("v"), F.col("m").alias("u")).filter("u < v")
        small = small.unionByName(least.select(F.col("n").alias("v"), F.col("m").alias("u"))).distinct()
        done, now = [now, large], stored(few(small), "small-star")
        for old in done:
            drop(old)
        before, size = size, _mark(now)
        if size == before:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 24))).first())
