"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows each input partition sends to each shard is drawn from the multivariate hypergeometric law whose margins
are the partitions' row counts and the shards' sizes; each partition permutes its rows and deals them out by its row of
the matrix; the shards permute what they receive, in random blocks of bounded size, so that no task holds a shard. The
matrix has partitions x shards numbers; the partitions, not the rows, pass through the driver.

The law that holds is `rows`: shard sizes differ by one row at most.

Defined cases: a null text has size 1 and CRC 0; repeated rows and null identifiers are rows like any other; an empty
table gives an empty result; a very long text moves as it is; further columns stay as they are.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.scratch import stored

LOW = (1 << 33) - 1


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Row i: how many rows partition i sends to each shard; column sums are the shards' sizes."""
    rng, total = np.random.default_rng(seed), sum(counts)
    left = np.array([total // shards + (k < total % shards) for k in range(shards)], np.int64)
    out = []
    for n in counts:
        sent, rest, open_ = [], n, int(left.sum())
        for room in left.tolist():
            open_ -= room
            k = _hypergeometric(rng, room, open_, rest)
            sent.append(k)
            rest -= k
        left -= np.array(sent)
        out.append(sent)
    return out


def _hypergeometric(rng, good: int, bad: int, draws: int, most: int = 10**9 - 1, few: int = 1000) -> int:
    """How many of `draws` rows without replacement are good. numpy draws from up to `most` rows; beyond that each row is
    taken by itself with the chance draws / rows, which are two binomial draws, and the surplus is given back, or what is
    missing taken from the others, in the same way: about the root of what was left, until `few` are drawn one by one.
    A set of rows taken so is uniform given its size, so the law is the same at every size."""
    hit, sign = 0, 1
    while good and draws:
        if good + bad <= most:
            return hit + sign * int(rng.hypergeometric(good, bad, draws))
        if draws <= few:
            for _ in range(draws):
                one = int(rng.integers(good + bad) < good)
                good, bad, hit = good - one, bad - 1 + one, hit + sign * one
            return hit
        p = draws / (good + bad)
        x, y = int(rng.binomial(good, p)), int(rng.binomial(bad, p))
        hit += sign * x
        if x + y > draws:
            good, bad, draws, sign = x, y, x + y - draws, -sign
        else:
            good, bad, draws = good - x, bad - y, draws - x - y
    return hit


def sharded(docs: DataFrame, shards: int = 8, seed: int = 17, block_rows: int = 10_000) -> DataFrame:
    """docs with shard and slot; columns of these names are replaced."""
    spark = docs.sparkSession
    rows = docs.drop("shard", "slot").select(F.struct("*").alias("row"))
    key = F.xxhash64(F.lit(seed), F.spark_partition_id(), F.monotonically_increasing_id())
    dealt = stored(rows.withColumn("_key", key).sortWithinPartitions("_key").withColumn("_at", F.monotonically_increasing_id()), "dealt")
    counts = dealt.groupBy(F.shiftright("_at", 33).alias("pid")).count().orderBy("pid").collect()
    matrix = communication_matrix([r["count"] for r in counts], shards, seed)
    ends = [(r.pid, [int(x) for x in np.cumsum(sent)]) for r, sent in zip(counts, matrix, strict=True)]
    ends = F.broadcast(spark.createDataFrame(ends, "_pid bigint, _ends array<bigint>"))
    out = dealt.join(ends, F.shiftright("_at", 33) == F.col("_pid"))
    out = out.withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_at").bitwiseAND(F.lit(LOW)))))
    # The second permutation: a random block of the shard, then a random order in the block; blocks are of about block_rows
    # rows, and a slot is the rows of the blocks before plus the place in its own.
    blocks = max(1, math.ceil(sum(r["count"] for r in counts) / (shards * block_rows)))
    drawn = lambda k: F.xxhash64(F.lit(seed + k), "_key", "_at")
    out = out.withColumn("block", F.pmod(drawn(1), F.lit(blocks))).select("row", "shard", "block", drawn(2).alias("_order"), "_at")
    sizes = out.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("_order", "_at"))
    out = out.withColumn("_place", place).join(offsets, ["shard", "block"])
    return out.select("row.*", "shard", (F.col("_base") + F.col("_place") - 1).alias("slot"))


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = docs.select("doc_id", size.alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"))
    return sharded(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
