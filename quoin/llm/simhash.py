"""SimHash near-deduplication by meet-in-the-middle ball hashing.

Every distinct fingerprint stands for the ball of all variants within half the radius. Two fingerprints within the
radius share a variant midway, and two that share a variant are within the radius, so linking all fingerprints of a
variant to one of them keeps every component. Variants are dealt by a prefix of their bits: a fingerprint is sent once to
each prefix that its variants reach, with the flips that it has left, and the variants are made where they are compared.
A prefix with more than `most_variants` of them is dealt again by further bits, so no task gets a dense cluster whole.

One fingerprint misses pairs whose texts differ in a few words of a hundred, and a wider radius has too many variants. With
several `sketches` a text has as many fingerprints, of its different shingles hashed in as many ways, and texts are linked if
any two of a kind are within the radius.

Defined cases: a null, empty or wordless text has fingerprint zero and is linked like any other; repeated rows share
their fingerprint; a null identifier never becomes a component's name unless all are null; an empty table works; a very
long text is hashed whole, in pieces of 65,536 shingles; further columns are ignored by near_components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.llm.arrow import slices
from quoin.llm.components import components
from quoin.scratch import stored
from quoin.session import ship

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BITS = 64


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Bits set in over half the XXH64 (seed 42) of all shingles of `shingle` words, repeats included."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return 0
    flat = b" ".join(words)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    n, hashed = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    k = min(shingle, len(words))
    h = np.array([hashed(flat[starts[i] : starts[i + k] - 1], 42) for i in range(n)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def sketches_of(text: str | None, shingle: int, count: int) -> list[int]:
    """`count` fingerprints of the text's different shingles, from their XXH64 mixed with as many constants."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return [0] * count
    n, hashed = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    h = np.unique(np.array([hashed(b" ".join(words[i : i + shingle]), 42) for i in range(n)], np.uint64))
    out = []
    for k in range(count):
        counts = np.zeros(BITS, np.int64)
        for i in range(0, len(h), 1 << 16):
            x = h[i : i + (1 << 16)] + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            counts += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0]))
    return out


def _names(sketches: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, sketches))]


def fingerprints(docs: DataFrame, shingle: int = 4, also: list[str] = [], sketches: int = 1) -> DataFrame:  # noqa: B006
    """doc_id, fp: the fingerprint's 64 bits as a long; with more sketches fp1, fp2, ...; and the columns `also` as they are."""
    names = _names(sketches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            found = [sketches_of(t, shingle, sketches) for t in texts] if sketches > 1 else [[fingerprint(t, shingle)] for t in texts]
            fps = np.array(found, np.uint64).reshape(len(texts), sketches).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(fps[:, k]) for k in range(sketches)), *batch.columns[2:]], names=["doc_id", *names, *also])

    ship(docs.sparkSession)
    kinds = dict(docs.dtypes)
    return docs.select("doc_id", "text", *also).mapInArrow(run, ", ".join([f"doc_id {kinds['doc_id']}", *(f"{c} bigint" for c in names), *(f"{c} {kinds[c]}" for c in also)]))


def flips(bits: range, most: int) -> list[tuple[int, int]]:
    """(mask, number of bits) of all ways to flip up to `most` of `bits`."""
    return [(sum(1 << b for b in which), k) for k in range(most + 1) for which in combinations(bits, k)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _routed(rows: DataFrame, done: int, more: int, most: int) -> DataFrame:
    """rows (fp, prefix, spare) with `done` leading bits of a variant fixed in prefix: the same with `more` bits."""
    top = range(BITS - done - more, BITS - done)
    ways = F.array(*[F.struct(F.lit(_signed(m)).alias("mask"), F.lit(k).alias("used")) for m, k in flips(top, most)])
    keep = _signed(((1 << (done + more)) - 1) << (BITS - done - more))
    own = F.col("fp").bitwiseXOR(F.col("way.mask"))
    part = _signed(((1 << more) - 1) << (BITS - done - more)) if done else keep
    prefix = F.col("prefix").bitwiseOR(own.bitwiseAND(F.lit(part)))
    out = rows.withColumn("way", F.explode(F.filter(ways, lambda w: w["used"] <= F.col("spare"))))
    return out.select("fp", prefix.alias("prefix"), (F.col("spare") - F.col("way.used")).alias("spare"))


def _weight(done: int) -> Column:
    n = BITS - done
    return F.when(F.col("spare") == 2, F.lit(1 + n + n * (n - 1) // 2)).when(F.col("spare") == 1, F.lit(1 + n)).otherwise(F.lit(1))


def _linked(done: int, radius: int):
    """For one bucket: make the variants with its prefix, link all fingerprints of a variant to the smallest of them."""
    masks = {k: np.array([m for m, _ in flips(range(BITS - done), k)], np.uint64) for k in range(radius // 2 + 1)}

    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        prefix = table.column("prefix").to_numpy().view(np.uint64)
        spare = table.column("spare").to_numpy()
        keep = np.uint64(((1 << done) - 1) << (BITS - done)) if done else np.uint64(0)
        variants, owner = [], []
        for k, mask in masks.items():
            at = np.flatnonzero(spare == k)
            base = (fp[at] & ~keep) | prefix[at]
            variants.append((base[:, None] ^ mask[None, :]).ravel())
            owner.append(np.repeat(at.astype(np.int32), len(mask)))
        v, o = np.concatenate(variants), np.concatenate(owner)
        variants = owner = None
        order = np.argsort(v)
        v, o = v[order], o[order]
        order = None
        same = v[1:] == v[:-1]
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        if same.any():
            shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            v, o = v[shared], o[shared]  # few, but for a dense cluster
            new = np.concatenate(([True], v[1:] != v[:-1]))
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            pairs = np.unique(np.stack([fp[o[first]], fp[o]], axis=1)[~new], axis=0)
            near = np.bitwise_count(pairs[:, 0] ^ pairs[:, 1])
            pairs = pairs[(near <= radius) & (near > 0)]
            a, b = _forest(pairs)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _forest(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as keep the components of the bucket: each fingerprint with its root."""
    nodes, flat = np.unique(pairs, return_inverse=True)
    flat, root = flat.reshape(-1, 2), np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[flat[:, 0]], root[flat[:, 1]])
        np.minimum.at(root, root[flat[:, 0]], low)
        np.minimum.at(root, root[flat[:, 1]], low)
        root = root[root]
        if (root == before).all():
            break
    off = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[off].view(np.int64), nodes[root[off]].view(np.int64)


def ball_links(fps: DataFrame, radius: int = 4, most_variants: int = 1_000_000, step: int = 6) -> DataFrame:
    """fps (fp), distinct. Gives links (a, b) whose components are those of all pairs within `radius` bits."""
    ship(fps.sparkSession)
    half = radius // 2
    ball = sum(1 for _ in flips(range(BITS), half))
    n = fps.count()
    done = 0
    while done < 24 and n * ball > most_variants << done:
        done += 1
    start = fps.select("fp", F.lit(0).cast("long").alias("prefix"), F.lit(half).alias("spare"))
    rows = _routed(start, 0, done, half) if done else start
    links = None
    while True:
        rows = stored(rows, "routed")
        if done + step <= BITS:
            weights = rows.groupBy("prefix").agg(F.sum(_weight(done)).alias("weight"))
            dense = stored(weights.filter(F.col("weight") > 2 * most_variants).select("prefix"), "dense")
            more = rows.join(dense, "prefix", "left_semi").select("fp", "prefix", "spare")
            here = rows.join(dense, "prefix", "left_anti")
        else:
            more, here = None, rows
        one = stored(here.groupBy("prefix").applyInArrow(_linked(done, radius), "a bigint, b bigint"), "links")
        links = one if links is None else links.unionByName(one)
        if more is None or not dense.limit(1).count():
            return links
        rows, done = _routed(more, done, step, half), done + step


def near_components(docs: DataFrame, radius: int = 4, shingle: int = 4, also: list[str] = [], sketches: int = 1, **how) -> DataFrame:  # noqa: B006
    """doc_id, fp, component_id (the smallest doc_id of the component), root (the component's name), links of equal
    fingerprints included; and the columns `also` as they are."""
    names = _names(sketches)
    # A class is what documents with the same fingerprints are; with one sketch it is the fingerprint itself.
    own = F.col("fp") if sketches == 1 else F.xxhash64(*names)
    rows = stored(fingerprints(docs, shingle, also, sketches).withColumn("class", own), "fingerprints")
    classes = stored(rows.groupBy("class", *names).agg(F.min("doc_id").alias("first_id")), "distinct")
    edges = []
    for c in names:
        hubs = classes.select(F.col(c).alias("fp"), "class").groupBy("fp").agg(F.min("class").alias("hub")) if sketches > 1 else None
        links = ball_links(classes.select("fp") if hubs is None else (hubs := stored(hubs, "hubs")).select("fp"), radius, **how)
        if hubs is not None:
            edges.append(classes.join(hubs, classes[c] == hubs["fp"]).select(F.col("class").alias("a"), F.col("hub").alias("b")).filter("a <> b"))
            for side in ("a", "b"):
                links = links.join(hubs.withColumnsRenamed({"fp": side, "hub": f"_{side}"}), side)
            links = links.select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        edges.append(links)
    roots = components(reduce(DataFrame.unionByName, edges))
    named = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = stored(named.join(least, "root").select("class", "component_id", "root"), "components")
    return rows.join(by_class, "class").select("doc_id", "fp", "component_id", "root", *also)


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each component: that of the smallest identifier, a null one last; of rows that share it, the
    one whose fingerprint and text hash come first; of rows that repeat identifier and text, one by the hash of all its
    columns. Other columns, whatever they are called, stay as they are."""
    key = F.xxhash64("text").alias("h")
    found = stored(near_components(docs.select("doc_id", "text", key), also=["h"], **how), "near")
    # The component's root comes of fingerprints: null and repeated identifiers are told apart by it.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "h"))
    kept = found.groupBy("root").agg(first.alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.h").alias("_h"))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", key)
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("h").eqNullSafe(F.col("_h"))).select("row", "doc_id", "h")
    twice = stored(found.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")), "repeated")
    if not twice.limit(1).count():
        return rows.select("row.*")
    again = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("h").eqNullSafe(F.col("_h"))
    one = rows.join(twice, again, "left_semi").groupBy("doc_id", "h").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rows.join(twice, again, "left_anti").select("row").unionByName(one.select("row")).select("row.*")
