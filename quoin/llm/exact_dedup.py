"""Exact deduplication over a log-structured merge index of text digests (DataFrame expressions only).

A batch's memtables (hash slices of its rows) are aggregated and flushed as runs: tables in buckets of the digest, sorted
by it. Compaction merges two runs at a time, bucket by bucket in the order that they are in, without a shuffle, and keeps
a digest's smallest identifier and its number of rows. Digests that the merged run holds more than once are hits: a filter
of them, sized by their number, picks the texts that could be meant in one scan, and those are compared byte by byte.

The index stays open for further batches. keep_id and group_size come from it, so they count all batches so far; an
identifier smaller than the one kept until then takes over. It remembers the tables that it was made from (not their
rows), and reads the texts of earlier batches again where a later one hits them.

Defined cases: a null text counts as empty; a null identifier never wins over a real one; of rows that repeat the
identifier that stays, and its text, one is kept, the one of the earliest batch; an empty table gives an empty result;
columns other than the identifier and the text are ignored; a very long text is one value that is hashed and compared whole.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.scratch import bucketed, stored

#: Runs of white space that are not already one single space.
UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: Bits of a filter for each of its digests, and the most that are sent to all executors (16 MB).
BITS_EACH, MOST_BITS = 16, 1 << 27


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), UNEVEN_SPACE, " ")


class DigestIndex:
    """Runs of (digest, keep_id, batch, n): the smallest identifier of a digest, the first batch that has it, and the
    number of rows. A bucket holds about `bucket_rows` rows of the first batch."""

    def __init__(self, memtables: int = 4, bucket_rows: int = 2_000_000):
        self.memtables, self.bucket_rows = memtables, bucket_rows
        self.buckets, self.batches = 0, 0
        self.runs: list[DataFrame] = []
        self.texts: list[DataFrame] = []

    def flush(self, rows: DataFrame, texts: DataFrame) -> None:
        """rows (digest, doc_id) of a batch: one sorted run for each memtable, beside the runs that are there. texts
        (digest, doc_id, sha, body) are read again for hits only."""
        if not self.buckets:
            self.buckets = max(8, math.ceil(rows.count() / self.bucket_rows))
        new = rows.withColumn("run", F.pmod(F.xxhash64("doc_id"), F.lit(self.memtables)).cast("int"))
        new = new.groupBy("run", "digest").agg(F.min("doc_id").alias("keep_id"), F.lit(self.batches).alias("batch"), F.count(F.lit(1)).alias("n"))
        written = self._written(new)
        self.runs += [written.filter(F.col("run") == k).drop("run") for k in range(self.memtables)]
        self.texts.append(texts)
        self.batches += 1

    def _written(self, rows: DataFrame) -> DataFrame:
        return bucketed(rows.repartition(self.buckets, "digest").sortWithinPartitions("run", "digest"), "runs", self.buckets, "digest", "run")

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        first = lambda r: F.when(r["digest"].isNotNull(), F.struct(r["keep_id"].isNull(), r["keep_id"], r["batch"]).cast(kind))
        kind = f"struct<none:boolean,keep_id:{dict(a.dtypes)['keep_id']},batch:int>"
        a, b = a.alias("a"), b.alias("b").hint("merge")
        one, two = ({c: F.col(f"{side}.{c}") for c in ("digest", "keep_id", "batch", "n")} for side in "ab")
        out = a.join(b, one["digest"] == two["digest"], "full").withColumn("_first", F.least(first(one), first(two)))
        n = F.coalesce(one["n"], F.lit(0)) + F.coalesce(two["n"], F.lit(0))
        return out.select(F.coalesce(one["digest"], two["digest"]).alias("digest"), "_first.keep_id", "_first.batch", n.alias("n"))

    def compact(self) -> DataFrame:
        """The runs merged two at a time until one is left."""
        while len(self.runs) > 1:
            pairs = [self._merged(*self.runs[i : i + 2]) for i in range(0, len(self.runs) - 1, 2)]
            new = [bucketed(p.withColumn("run", F.lit(0)), "compacted", self.buckets, "digest", "run").drop("run") for p in pairs]
            self.runs = new + self.runs[2 * len(pairs) :]
        return self.runs[0]


def passing(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """texts whose digest may be among hits (digest, stored): three bits of a word of 64, sent to all executors; with more
    hits than a filter of MOST_BITS can tell apart, an exact join in its place."""
    n = hits.count()
    if n * BITS_EACH > MOST_BITS:
        return texts.join(hits.select("digest"), "digest", "left_semi")
    words = max(1, n * BITS_EACH // 64)
    # The hash is a column of its own, and never null, so that nothing below makes the digest again.
    bit = lambda k: F.expr(f"shiftleft(1L, cast(shiftright(_h, {6 * k}) & 63 as int))")
    mask, word = bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)), F.coalesce(F.pmod(F.shiftright("_h", 18), F.lit(words)), F.lit(0).cast("long"))
    hashed = lambda df: df.withColumn("_h", F.xxhash64("digest")).withColumn("_word", word).withColumn("_mask", mask)
    bits = stored(hashed(hits).groupBy("_word").agg(F.bit_or("_mask").alias("_bits")), "filter")
    return hashed(texts).join(F.broadcast(bits), "_word").filter(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask")).select(*texts.columns)


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, digest_bytes: int = 32
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, after docs went into the index.
    `digest_bytes` shortens the index's key."""
    index = index or DigestIndex()
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("body"))
    texts = texts.withColumn("sha", F.unhex(F.sha2(F.col("body"), 256))).withColumn("digest", F.substring("sha", 1, digest_bytes))
    rows = stored(texts.select("doc_id", "sha", "digest", F.monotonically_increasing_id().alias("row")), "digests")
    index.flush(rows.select("digest", "doc_id"), texts)
    hits = index.compact().filter("n > 1")
    if index.batches > 1:
        hits = hits.join(rows.select("digest"), "digest", "left_semi")
    hits = stored(hits, "hits")
    texts = [t.withColumn("batch", F.lit(k)) for k, t in enumerate(index.texts)]
    maybe = passing(reduce(DataFrame.unionByName, texts), hits)
    same = maybe.select("digest", "sha", "body").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("bodies"), F.countDistinct("sha").alias("shas"))
    mixed = stored(same.filter("bodies > 1").join(hits.select("digest"), "digest", "left_semi"), "verified")
    if mixed.filter("bodies > shas").limit(1).count():
        raise ValueError("two different texts share a SHA-256 digest")
    out = rows.join(hits.select("digest", "keep_id", "batch", "n"), "digest", "left")
    if mixed.limit(1).count():
        # Different texts under one digest, which a shortened one can have: what the texts say goes before the index.
        own = maybe.join(mixed, "digest", "left_semi").groupBy("sha").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "batch")).alias("own"), F.count(F.lit(1)).alias("own_n"))
        told = F.col("own_n").isNotNull()
        out = out.join(own, "sha", "left").withColumn("n", F.coalesce("own_n", "n"))
        out = out.withColumn("keep_id", F.when(told, F.col("own.doc_id")).otherwise(F.col("keep_id"))).withColumn("batch", F.when(told, F.col("own.batch")).otherwise(F.col("batch")))
    now = stored(out.select("doc_id", "sha", "row", "n", "keep_id", "batch"), "kept")
    first = F.col("n").isNull() | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("batch") == index.batches - 1))
    # Rows that repeat the identifier that stays: the first of them.
    again = now.filter(F.col("n").isNotNull() & first).groupBy("sha").agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("rows"))
    again = stored(again.filter("rows > 1").select("sha", "first_row"), "repeated")
    if again.limit(1).count():
        now = now.join(again, "sha", "left")
        first = first & F.coalesce(F.col("row") == F.col("first_row"), F.lit(True))
    return now.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        first.alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AND row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)
"""
