"""Repeated passages by sparse suffix arrays.

Suffixes are kept at minimisers: the places whose hashed k-gram is the least of `window` neighbours, so equal passages
keep equal places. Any passage of `min_words` words has a kept place among its first `window` words, hence two copies of
it share at least `reach` = min_words - window + 1 words from that place on, the place's key. Places whose key another has
are sorted by what lies left of the key and again by what lies right of it; each is compared with its neighbours in the
order, and their match is extended left and right, word by word, with that one partner. A passage counts if it has
min_words words in all: `marks` has a bit for each passage of min_words words around the key that a neighbour has too.
Where the longest match to the left and that to the right have different partners, and so leave a passage undecided,
the passages of all places with that key are hashed whole and counted.

What is found: the words of all passages of min_words words that occur twice anywhere in the table, and no others; a
stretch is a run of such words. Words are runs between ASCII white space. Keys are equal if two 64-bit hashes of their
words are; words beyond the key are compared by 32 bits each, so a stretch can be wrong only next to `reach` words that
do repeat, once in 2**32.

Defined cases: null, empty and short texts have no passages; a repeated row repeats all its passages, and rows that share
identifier and text give them once; a null identifier is carried as null; a very long text is cut nowhere; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.llm.arrow import slices
from quoin.scratch import FEW_PROCESSES, stored
from quoin.session import ship

BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03
KNOWN_WORDS = 1 << 17


def _powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    inverse = np.uint64(pow(base, -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, np.uint64(base)))), dtype=np.uint64)
        down = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, inverse))), dtype=np.uint64)
    return up, down


class Hasher:
    """Word hashes, and hashes of runs of words by a rolling polynomial; tables grow with the longest text seen."""

    def __init__(self, base: int = BASE):
        self.known: dict[bytes, int] = {}
        self.base = base
        self.up, self.down = _powers(1 << 14, base)

    def words(self, text: str | None) -> np.ndarray:
        known = self.known
        if len(known) > KNOWN_WORDS:
            known.clear()
        parts = text.encode("utf-8", "surrogatepass").split() if text else []
        for w in parts:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w, 5) | 1
        return np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))

    def runs(self, words: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
        """A hash for each run of k words, or for those that begin `at`."""
        n = len(words)
        if n < k:
            return np.empty(0, np.uint64)
        if n > len(self.up):
            self.up, self.down = _powers(2 * n, self.base)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(words * self.up[:n], dtype=np.uint64)))
        x = (sums[k:] - sums[:-k]) * self.down[: n - k + 1] if at is None else (sums[at + k] - sums[at]) * self.down[at]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def kept_places(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the least of each `window` neighbouring k-grams; the first of equals."""
    if len(grams) < window:
        return np.empty(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(grams, window).argmin(axis=1) + np.arange(len(grams) - window + 1)
    return np.unique(least)


def _anchors(reach: int, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches, 128):
            owner, places, keys = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = hasher.words(text)
                at = kept_places(hasher.runs(words, gram), window)
                at = at[at <= len(words) - reach]
                owner.append(np.full(len(at), i))
                places.append(at)
                keys.append(hasher.runs(words, reach, at))
            at = pa.array(np.concatenate(owner)) if owner else pa.array([], pa.int64())
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(keys).view(np.int64))], names=["doc_id", "body", "place", "h"]
                )

    return run


def _contexts(reach: int, side: int):
    """For each kept place of a text: its key by two hashes, and the `side` words before it (nearest first) and after the
    key's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, second = Hasher(), Hasher(SECOND_BASE)
        for batch in slices(batches, 128):
            owner, places, keys, checks, left, right = [], [], [], [], [], []
            for i, (text, at) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                words, at = hasher.words(text), np.array(at, np.int64)
                none = np.zeros(side, np.uint32)
                short = np.concatenate((none, (words >> np.uint64(32)).astype(np.uint32) | np.uint32(1), none))
                owner.append(np.full(len(at), i))
                places.append(at)
                keys.append(hasher.runs(words, reach, at))
                checks.append(second.runs(words, reach, at))
                left.append(short[at[:, None] + (side - 1 - np.arange(side))])
                right.append(short[at[:, None] + side + reach + np.arange(side)])
            if owner:
                at, wide = pa.array(np.concatenate(owner)), pa.binary(4 * side)
                pack = lambda parts: pa.Array.from_buffers(wide, len(at), [None, pa.py_buffer(np.ascontiguousarray(np.concatenate(parts)).tobytes())]).cast(pa.binary())
                hashes = [pa.array(np.concatenate(h).view(np.int64)) for h in (keys, checks)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(places).astype(np.int32)), *hashes, pack(left), pack(right)], names=["doc_id", "body", "place", "h", "h2", "left", "right"]
                )

    return run


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading words rows of a and b have in common; 0 stands for no word."""
    same = (a == b) & (a != 0)
    return np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))


def _arrays(table: pa.Table, side: int) -> dict[str, np.ndarray]:
    """Keys, and contexts as rows of words, without a copy of each row."""

    def words(packed: pa.Array) -> np.ndarray:
        if not len(packed):
            return np.empty((0, side), np.uint32)
        start = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset]
        return np.frombuffer(packed.buffers()[2], np.uint8)[start : start + 4 * side * len(packed)].view(np.uint32).reshape(-1, side)

    columns = {c: pa.concat_arrays(table.column(c).chunks) for c in ("h", "h2", "left", "right")}
    return {c: x.to_numpy() if c in ("h", "h2") else words(x) for c, x in columns.items()}


def _pairs(rows: dict[str, np.ndarray], side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row but the first: how many words around the key it shares with the row before to the left and to the
    right, and the bits of the passages that they share: bit k stands for the one that begins k words before the key and
    ends `side` - k words after it."""
    same = (rows["h"][1:] == rows["h"][:-1]) & (rows["h2"][1:] == rows["h2"][:-1])
    left, right = (np.where(same, _shared(rows[c][1:], rows[c][:-1]), 0) for c in ("left", "right"))
    upto = lambda n: np.left_shift(np.int64(1), n.astype(np.int64)) - 1
    marks = upto(left + 1) & ~upto(np.maximum(0, side - right))
    return left, right, np.where(same, marks, 0)


OUT = ["doc_id", "body", "place", "marks", "left_n", "right_n"]


def _neighbours(by_left: bool, side: int):
    """Over one sorted partition: for each place and each of its neighbours the passages that they share, and the words on
    the sorted side; the first and last row are given with their contexts (`edge` 0 and 1), to be compared across partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, True
        context = ["h", "h2", "left", "right"]

        def given(table: pa.Table, marks: np.ndarray, near: np.ndarray, edge: int | None = None) -> pa.RecordBatch:
            n, none = table.num_rows, np.full(table.num_rows, -1)
            kinds = dict(zip(context, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True))
            more = [table.column(c) if edge is not None else pa.nulls(n, kinds[c]) for c in context]
            counts = [pa.array(x.astype(np.int32)) for x in ((near, none) if by_left else (none, near))]
            out = [*(table.column(c) for c in OUT[:3]), pa.array(marks.astype(np.int64)), *counts, *more, pa.array([edge] * n, pa.int32()), pa.array(np.full(n, part, np.int32))]
            return pa.table(out, names=[*OUT, *context, "edge", "part"]).combine_chunks().to_batches()[0]

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            if first:
                yield given(now.slice(0, 1), np.zeros(1), np.zeros(1), 0)
                first = False
            table = pa.concat_tables([held, now]) if held is not None else now
            left, right, marks = _pairs(_arrays(table, side), side)
            near, zero = left if by_left else right, np.zeros(1, np.int64)
            # The held row comes twice, each time with one of its neighbours.
            yield given(table, np.concatenate((zero, marks)) | np.concatenate((marks, zero)), np.maximum(np.concatenate((zero, near)), np.concatenate((near, zero))))
            held = table.slice(table.num_rows - 1)
        if held is not None:
            yield given(held, np.zeros(1), np.zeros(1), 1)

    return run


def _kept(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name, FEW_PROCESSES)


def _compared(rows: DataFrame, by: str, side: int) -> DataFrame:
    """(OUT): rows sorted over range partitions, neighbours compared, also across partitions."""
    spark, ids = rows.sparkSession, dict(rows.dtypes)["doc_id"]
    order = ["h", "h2", by, "right" if by == "left" else "left", "doc_id", "body", "place"]
    kind = f"doc_id {ids}, body bigint, place int, marks bigint, left_n int, right_n int"
    found = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours(by == "left", side), f"{kind}, h bigint, h2 bigint, left binary, right binary, edge int, part int")
    found = _kept(found, f"{by}-order")
    edges = found.filter("edge is not null").orderBy("part", "edge").collect()  # two rows for each partition
    met = []
    for a, b in zip(edges, edges[1:], strict=False):
        if a.part != b.part:
            both = pa.table({"h": [a.h, b.h], "h2": [a.h2, b.h2], "left": [bytes(a.left), bytes(b.left)], "right": [bytes(a.right), bytes(b.right)]})
            left, right, marks = (int(x[0]) for x in _pairs(_arrays(both, side), side))
            met += [(r.doc_id, r.body, r.place, marks, left if by == "left" else -1, -1 if by == "left" else right) for r in (a, b)]
    return found.filter("edge is null").select(*OUT).unionByName(spark.createDataFrame(met, kind))


def _passages(side: int):
    """For each place all passages of min_words words around its key, hashed: bit and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            fixed = zip(*(batch.column(c).to_pylist() for c in ("h", "h2", "left", "right")), strict=True)
            at, bit, hashed = [], [], []
            for i, (h, h2, left, right) in enumerate(fixed):
                key = h.to_bytes(8, "little", signed=True) + h2.to_bytes(8, "little", signed=True)
                for k in range(side + 1):
                    before, after = left[: 4 * k], right[: 4 * (side - k)]
                    if b"\0\0\0\0" not in (before[-4:], after[-4:]):  # no word there
                        at.append(i), bit.append(1 << k), hashed.append(xxhash.xxh3_128_digest(bytes([k]) + key + before + after))
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in OUT[:3]), pa.array(bit, pa.int64()), pa.array(hashed, pa.binary())], names=[*OUT[:3], "marks", "passage"])

    return run


def _undecided(side: int) -> Column:
    """The bits of passages that the longest matches to the left and to the right allow, but no single neighbour has."""
    upto = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1
    return upto(F.col("left_n") + 1).bitwiseAND(F.bitwise_not(upto(F.greatest(F.lit(0), side - F.col("right_n"))))).bitwiseAND(F.bitwise_not(F.col("marks")))


def _stretches(min_words: int, side: int):
    """A document's places with the bits of their passages, as runs of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.arange(side + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            # All documents of the batch at once: (document, first word) of each passage, sorted.
            found = batch.column(1)
            sizes, places = np.diff(found.offsets.to_numpy()), found.flatten()
            place, marks = (places.field(c).to_numpy().astype(np.int64) for c in ("place", "marks"))
            at, k = np.nonzero((marks[:, None] >> bits) & 1)
            starts = np.unique((np.repeat(np.arange(len(sizes)), sizes)[at] << 40) | (place[at] - k))
            new = np.flatnonzero(np.concatenate(([True], np.diff(starts) > min_words)))
            ends = starts[np.concatenate((new[1:] - 1, [len(starts) - 1]))] + min_words
            first, owner = starts[new] & ((1 << 40) - 1), starts[new] >> 40
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(first), pa.array(ends - starts[new])], names=["doc_id", "first_word", "n_words"])

    return run


def repeated_passages(docs: DataFrame, min_words: int = 50, window: int = 16, gram: int = 8) -> DataFrame:
    """doc_id, first_word (from 0), n_words: the stretches of each document's words that repeat elsewhere in the table."""
    reach, side = min_words - window + 1, window - 1
    if reach < gram + window or side > 62:
        raise ValueError("min_words must be at least 2 * window + gram - 1, and window at most 63")
    ship(docs.sparkSession)
    ids = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.xxhash64("text").alias("body"), "text")
    anchors = _kept(texts.mapInArrow(_anchors(reach, window, gram), f"doc_id {ids}, body bigint, place int, h bigint"), "anchors")
    # Stored, so that the join below has plain exchanges on both sides and AQE can split a passage that very many share.
    twice = _kept(anchors.groupBy("h").count().filter("count > 1").select("h"), "repeated")
    places = F.collect_set("place")
    mine = _kept(anchors.join(twice, "h", "left_semi").groupBy("doc_id", "body").agg(places.alias("places"), (F.count(F.lit(1)) / F.size(places)).alias("rows")), "candidates")
    mine = mine.withColumnRenamed("doc_id", "_id").withColumnRenamed("body", "_body")
    met = texts.join(mine, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body"))).select("doc_id", "body", "text", "places", "rows")
    if mine.filter("rows > 2").limit(1).count():
        # Two rows of those that share identifier and text say all: each has the other as its neighbour.
        often = met.filter("rows > 2").groupBy("doc_id", "body").agg(*[F.first(c).alias(c) for c in ("text", "places", "rows")])
        met = met.filter("rows <= 2").unionByName(often.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy"))
    kind = f"doc_id {ids}, body bigint, place int, h bigint, h2 bigint, left binary, right binary"
    rows = _kept(met.drop("rows").mapInArrow(_contexts(reach, side), kind), "contexts")
    found = _compared(rows, "left", side).unionByName(_compared(rows, "right", side))
    # By document first, so that the places of one need no second exchange.
    best = found.repartition("doc_id", "body").groupBy("doc_id", "body", "place").agg(F.bit_or("marks").alias("marks"), F.max("left_n").alias("left_n"), F.max("right_n").alias("right_n"))
    places = _kept(best, "places")
    open_ = _kept(places.filter(_undecided(side) != 0).select("doc_id", "body", "place"), "undecided")
    marked = places.select("doc_id", "body", "place", "marks")
    if open_.limit(1).count():
        same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["body"] == b["body"]) & (a["place"] == b["place"])
        keys = _kept(rows.join(open_, same(rows, open_), "left_semi").select("h", "h2").distinct(), "undecided-keys")
        hashed = _kept(rows.join(keys, ["h", "h2"], "left_semi").select(*rows.columns).mapInArrow(_passages(side), f"doc_id {ids}, body bigint, place int, marks bigint, passage binary"), "passages")
        more = hashed.groupBy("passage").count().filter("count > 1").select("passage")
        marked = marked.unionByName(hashed.join(more, "passage", "left_semi").select(*marked.columns))
    by_doc = marked.filter("marks <> 0").groupBy("doc_id", "body").agg(F.collect_list(F.struct("place", "marks")).alias("found"))
    return by_doc.select("doc_id", "found").mapInArrow(_stretches(min_words, side), f"doc_id {ids}, first_word bigint, n_words bigint")


def op6_suffix_array(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
