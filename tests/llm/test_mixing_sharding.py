import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quoin.llm.mixing import mix, mixed_rows, rounded
from quoin.llm.sharding import _hypergeometric, communication_matrix, sharded

SCHEMA = "doc_id bigint, text string, source string, _copies int, shard int, row string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, "z") for i, t, s in rows], SCHEMA)


def sample(seed=1):
    rng = random.Random(seed)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["a", "b", "c", "é", None] + ["a"] * 5)) for i in range(600)]
    return rows + [(600, "x " * 30_000, "b"), (5, rows[5][1], rows[5][2]), (None, "q w e", "c"), (700, None, "d"), (701, "", "d")]


def water(sizes, share=1.5, most=2.0):
    """Targets by dealing and resharing until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


@pytest.mark.parametrize("fan", [4, 16])
def test_mix_hits_targets(spark, fan):
    rows = sample()
    out = mix(frame(spark, rows), fan=fan).withColumn("taken", F.round((F.col("whole") + F.col("part")) * F.col("size"))).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = water(sizes)
    taken, fractional = Counter(), Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and 0 <= r.part <= 1
        taken[r.source] += r.taken * r.rows
        fractional[r.source] += 0 < r.part < 1
    assert sum(r.rows for r in out) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 2 for s in want) and max(fractional.values()) <= 1


def test_mix_is_unbiased_and_repeatable(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate("ab" * 40)]
    docs = frame(spark, rows)
    one, two = (sorted((r.doc_id, r.whole, r.part) for r in mix(docs, share=1.1, seed=3).collect()) for _ in range(2))
    assert one == two
    picked = Counter()
    for seed in range(12):
        for r in mix(docs, share=1.1, seed=seed).collect():
            picked[r.doc_id] += r.whole + r.part
    assert len({v for v in picked.values()}) > 2 and max(picked.values()) <= 24


def test_rounding_keeps_each_expectation(spark):
    """5,000 sources, each with the same five units: a unit ends with 0 or its size, but for one a source; a source's sum stays
    as it is; and over the sources a unit ends with its own mass on average, within four standard deviations."""
    units = [(3.0, 1.2), (5.0, 2.0), (1.0, 0.9), (7.0, 0.7), (2.0, 1.5)]
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(size).alias("size"), F.lit(m).alias("m")) for k, (size, m) in enumerate(units)]))
    rows = spark.range(5000).select(F.col("id").alias("sid"), F.lit(5).cast("long").alias("n"), one.alias("u")).select("sid", "n", (F.col("sid") * 5 + F.col("u.k")).alias("key"), "u.size", "u.m")
    by_fan = []
    for fan in (16, 2):
        out = rounded(rows, fan=fan).withColumn("k", F.col("key") % 5).withColumn("sid", F.floor(F.col("key") / 5)).cache()
        assert out.groupBy("sid").agg(F.sum("settled").alias("s")).filter(F.abs(F.col("s") - sum(m for _, m in units)) > 1e-9).count() == 0
        fractional = out.filter(" and ".join(f"not (k = {k} and (settled < 1e-9 or settled > {size} - 1e-9))" for k, (size, _) in enumerate(units)))
        assert fractional.groupBy("sid").count().filter("count > 1").count() == 0
        means = {r.k: (r.mean, r.sd / 5000**0.5) for r in out.groupBy("k").agg(F.avg("settled").alias("mean"), F.stddev("settled").alias("sd")).collect()}
        assert all(abs(means[k][0] - m) < 4 * means[k][1] for k, (_, m) in enumerate(units)), means
        by_fan.append(sorted(map(tuple, out.select("key", "settled").collect())))
    assert by_fan[0] == sorted(map(tuple, rounded(rows.repartition(7), fan=16).collect()))  # partitions don't matter


def test_mixed_rows(spark):
    rows = sample(2)
    docs = frame(spark, rows)
    out = mixed_rows(docs)
    assert out.columns == docs.columns
    count = Counter((r.doc_id, r.source) for r in out.collect())
    size = {(i, s): len((t or "").split()) for i, t, s in rows}
    repeats = Counter((i, s) for i, _, s in rows)
    assert all(n <= 2 * repeats[k] for k, n in count.items())
    assert all(count[k] == repeats[k] for k in size if size[k] == 0)
    total, sizes, most = Counter(), Counter(), Counter()
    for k, n in repeats.items():
        total[k[1]] += size[k] * count[k]
        sizes[k[1]] += size[k] * n
        most[k[1]] = max(most[k[1]], size[k] * n)
    want = water(sizes)
    assert all(abs(total[s] - want[s]) <= most[s] for s in want)  # whole copies: off by one document at most


def test_empty(spark):
    assert mix(frame(spark, [])).collect() == [] and mixed_rows(frame(spark, [])).collect() == []
    assert sharded(frame(spark, [])).collect() == []


def test_matrix_margins():
    counts = [0, 7, 1000, 3, 50_000]
    m = communication_matrix(counts, 8, 1)
    assert [sum(r) for r in m] == counts
    columns = [sum(r[k] for r in m) for k in range(8)]
    assert max(columns) - min(columns) <= 1 and sum(columns) == sum(counts)
    assert min(map(min, m)) >= 0
    big = communication_matrix([5 * 10**9, 3 * 10**9], 3, 1)
    assert [sum(r) for r in big] == [5 * 10**9, 3 * 10**9]


def test_matrix_law():
    """Each row lands in each shard equally often."""
    first = [communication_matrix([4, 4], 2, s)[0][0] for s in range(3000)]
    share = Counter(first)
    for k, p in {0: 1, 1: 16, 2: 36, 3: 16, 4: 1}.items():
        assert share[k] / 3000 == pytest.approx(p / 70, abs=0.03)


def test_matrix_law_of_a_small_partition_beyond_the_limit_of_numpy():
    """Of 5 rows among more than 10**9, the first shard gets k by the binomial law, near enough."""
    share = Counter(communication_matrix([5, 2 * 10**9], 8, s)[0][0] for s in range(4000))
    for k in range(4):
        assert share[k] / 4000 == pytest.approx(math.comb(5, k) * 7 ** (5 - k) / 8**5, abs=0.03)


@pytest.mark.parametrize("good, bad, draws", [(60, 40, 50), (5, 95, 90), (30, 70, 12), (90, 10, 99)])
def test_hypergeometric_law_by_binomial_draws(good, bad, draws):
    rng = np.random.default_rng(3)
    share = Counter(_hypergeometric(rng, good, bad, draws, most=10, few=4) for _ in range(20_000))
    law = {k: math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws) for k in range(max(0, draws - bad), min(good, draws) + 1)}
    assert set(share) <= set(law)
    assert sum(abs(share[k] / 20_000 - p) for k, p in law.items()) < 0.05


def test_shards(spark):
    rows = [(i % 90, None if i % 7 == 0 else "é" * (i % 5), "s") for i in range(1001)]
    docs = frame(spark, rows).repartition(5)
    out = sharded(docs)
    assert out.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, _ in rows)
    by = Counter(r.shard for r in got)
    assert set(by) == set(range(8)) and max(by.values()) - min(by.values()) <= 1
    for k in by:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(by[k]))


def test_crc_is_unsigned_utf8(spark):
    assert spark.range(1).select(F.crc32(F.lit("é").cast("binary")).alias("c")).first().c == zlib.crc32("é".encode())


def spark_hash(kinds, *values):
    """xxhash64 of ints (i) and longs (q), as Spark chains it."""
    h = 42
    for kind, v in zip(kinds, values, strict=True):
        h = xxhash.xxh64_intdigest(struct.pack(f"<{kind}", v), h)
    return h - (1 << 64) if h >= 1 << 63 else h


def test_sharding_against_plain_version(spark):
    """The same draws dealt out by plain loops: matrix, both permutations, blocks."""
    rows = [(i, "w " * (i % 7), "s") for i in range(230)]
    docs = frame(spark, rows)
    parts = docs.select("doc_id", F.spark_partition_id().alias("pid")).collect()
    dealt = []
    for pid in sorted({r.pid for r in parts}):
        mine = [r.doc_id for r in parts if r.pid == pid]
        keyed = sorted((spark_hash("iiq", 17, pid, (pid << 33) + k), i) for k, i in enumerate(mine))
        dealt.append([(key, (pid << 33) + k, i) for k, (key, i) in enumerate(keyed)])
    placed, blocks = {k: [] for k in range(8)}, math.ceil(len(rows) / (8 * 5))
    for mine, sent in zip(dealt, communication_matrix([len(d) for d in dealt], 8, 17), strict=True):
        shard_of = [k for k, n in enumerate(sent) for _ in range(n)]
        for (key, at, i), k in zip(mine, shard_of, strict=True):
            placed[k].append((spark_hash("iqq", 18, key, at) % blocks, spark_hash("iqq", 19, key, at), at, i))
    want = {i: (k, slot) for k, some in placed.items() for slot, (*_, i) in enumerate(sorted(some))}
    got = {r.doc_id: (r.shard, r.slot) for r in sharded(docs, block_rows=5).collect()}
    assert got == want


def test_sharding_keeps_very_long_texts(spark):
    rows = [(1, "x " * 200_000, "s"), (2, None, None), (None, "", "s"), (2, None, None)]
    out = sharded(frame(spark, rows), shards=3).collect()
    assert sorted((str(r.doc_id), len(r.text or "")) for r in out) == [("1", 400_000), ("2", 0), ("2", 0), ("None", 0)]
    assert sorted(Counter(r.shard for r in out).values()) == [1, 1, 2]
