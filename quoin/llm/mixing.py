"""Mixing sources to target weights by pivotal dependent rounding (DataFrame expressions only).

Each document wants target/size-of-source copies: a whole part, and a fraction that is settled at random so that the
words of a source keep their sum. Pairs of fractional documents move mass (words) between them, up or down with
probabilities that keep both expectations, until one is integral; the other meets the next document. The fold runs in
groups of about `fan` documents of a source, and what each group leaves over goes up a reduction tree, level by level,
so that no task ever holds a source.

Defined cases: a null text has no words; a null source is a source of its own, last in order; documents without words
take none of the budget (0 words, one copy); rows that agree in identifier, source and size are rounded together; an
empty table gives an empty result; a very long text counts all its words; further columns, whatever they are called, stay
untouched in `mixed_rows`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.operators.numbering import number_rows
from quoin.scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(by_source: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """by_source (source, source_size, ...) with sid and target: `share` of all words by weight, and what lies above
    `most` times a source's own words is dealt again by weight among the others. Sources are numbered over range
    partitions. The level at which all is dealt out rises with each pass over them, as those that it fills fall out, until
    no more are filled; a pass is one aggregate."""
    rows = number_rows(by_source.withColumn("_none", F.col("source").isNull()), ["_none", "source"], 1, "sid").drop("_none")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    rows = stored(rows.withColumn("full_at", F.col("cap") / F.col("weight")), "sources")
    budget, level = (rows.agg(F.sum("source_size")).first()[0] or 0) * share, 0.0
    while True:
        full = F.col("full_at") <= level
        used, rest = rows.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.sum(F.when(~full, F.col("weight")))).first()
        if not rest:
            level = float("inf")
            break
        if (budget - used) / rest <= level:
            break
        level = (budget - used) / rest
    return rows.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).drop("weight", "cap", "full_at")


def _fold(units: Column, seed: int) -> Column:
    """units: array of (size, key, m), 0 < m < size. Gives (left: the last fractional unit or null, done: settled units)."""
    kind = "struct<size:double,key:bigint,m:double>"
    start = F.struct(F.lit(None).cast(kind).alias("left"), F.array().cast(f"array<{kind}>").alias("done"))

    def unit(u: Column, m: Column) -> Column:
        return F.struct(u["size"].alias("size"), u["key"].alias("key"), m.alias("m"))

    def step(acc: Column, b: Column) -> Column:
        a = acc["left"]
        up_a, up_b = F.least(a["size"] - a["m"], b["m"]), F.least(a["m"], b["size"] - b["m"])
        chance = F.pmod(F.xxhash64(F.lit(seed), a["key"], b["key"]), F.lit(1 << 52)) / float(1 << 52)
        up = chance * (up_a + up_b) < up_b
        ma = F.when(up, F.when(up_a == a["size"] - a["m"], a["size"]).otherwise(a["m"] + up_a)).otherwise(F.when(up_b == a["m"], F.lit(0.0)).otherwise(a["m"] - up_b))
        mb = F.when(up, F.when(up_a == b["m"], F.lit(0.0)).otherwise(b["m"] - up_a)).otherwise(F.when(up_b == b["size"] - b["m"], b["size"]).otherwise(b["m"] + up_b))
        moved = F.array(unit(a, ma), unit(b, mb))
        open_, shut = (lambda u: (u["m"] > 0) & (u["m"] < u["size"])), (lambda u: (u["m"] <= 0) | (u["m"] >= u["size"]))
        paired = F.transform(F.array(moved), lambda two: F.struct(F.get(F.filter(two, open_), F.lit(0)).alias("left"), F.concat(acc["done"], F.filter(two, shut)).alias("done")))[0]
        return F.when(a.isNull(), F.struct(unit(b, b["m"]).alias("left"), acc["done"].alias("done"))).otherwise(paired)

    return F.aggregate(units, start, step)


def rounded(units: DataFrame, fan: int = 16, seed: int = 7) -> DataFrame:
    """units (sid, n, key, size, m): key with the mass m that it ends with: 0 or size, but for one unit of a source."""
    most, rows = units.agg(F.max("n"), F.count(F.lit(1))).first()
    most = most or 0
    left = units.withColumn("groups", F.ceil(F.col("n") / fan)).withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("groups")))
    parts, groups = [], math.ceil(most / fan)
    while most:
        one = F.struct(F.col("size").cast("double").alias("size"), F.col("key"), F.col("m"))
        level = stored(left.groupBy("sid", "groups", "grp").agg(F.sort_array(F.collect_list(one), asc=False).alias("us")).select("sid", "groups", "grp", _fold(F.col("us"), seed).alias("f")).select("sid", "groups", "grp", "f.left", "f.done").coalesce(max(1, rows // 20_000)), "pivotal")
        parts.append(level.select(F.explode("done").alias("u")))
        rest = level.filter("left is not null")
        if groups <= 1:
            parts.append(rest.select(F.col("left").alias("u")))
            break
        left = rest.select("sid", F.ceil(F.col("groups") / fan).alias("groups"), "grp", "left.*").withColumn("grp", F.pmod("grp", "groups"))
        groups, rows = math.ceil(groups / fan), rows // fan
    if not parts:
        return units.select("key", F.col("m").alias("settled"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("u.key", F.col("u.m").alias("settled"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, fan: int = 16, seed: int = 7) -> DataFrame:
    """doc_id, source, size, rows, source_size, target, whole, settled: a unit (documents alike in the first three, `rows`
    of them) has `whole` copies and the words `settled` of one more: none, all, or, for one unit of a source, a part."""
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    units = stored(sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "units")
    by_source = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("n"))
    by_source = stored(targets(by_source, share, most, weights), "targets")
    t = by_source.withColumnRenamed("source", "t_source")
    rows = units.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumn("whole", F.floor(copies)).withColumn("m", (copies - F.col("whole")) * F.col("size") * F.col("rows"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "source", "size"))
    rows = stored(rows, "wanted")
    open_ = rows.filter("m > 0 and m < size * rows").select("sid", "n", "key", (F.col("size") * F.col("rows")).alias("size"), "m")
    # key is a hash; units that share one are settled together as one unit
    open_ = open_.groupBy("sid", "n", "key").agg(F.sum("size").alias("size"), F.sum("m").alias("m"))
    done = rounded(open_, fan, seed)
    weight = F.sum(F.col("size") * F.col("rows")).over(Window.partitionBy("sid", "key"))
    return rows.withColumn("all", weight).join(done, "key", "left").withColumn("part", F.coalesce(F.col("settled") / F.col("all"), F.lit(0.0))).drop("settled", "m", "n", "key", "all")


def op2_pivotal_mix(spark, sf_dir: str) -> DataFrame:
    """The one unit of a source that stays fractional gives its share of words, so that a source misses its target by a
    rounding at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    taken = F.least(F.round((F.col("whole") + F.col("part")) * F.col("size")), F.col("size") * 2).cast("long")
    out = mix(docs).withColumn("taken", taken)
    return out.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """docs, each row as often as the mix takes it; the last fractional unit of a source is settled by chance. A document
    without words costs nothing and stays once."""
    last = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "source"), F.lit(1 << 52)) / float(1 << 52) < F.col("part")
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("whole") + last.cast("long")).cast("int")
    how_many = mix(docs, seed=seed, **how).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), copies.alias("_copies"))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    met = rows.join(how_many, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    return met.filter("_copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy")).select("row.*")
