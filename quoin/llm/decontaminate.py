"""Benchmark decontamination with an Aho-Corasick automaton over the normalised items (questions and answers).

Words are numbered, a window of `width` consecutive item words is a key of the automaton, and each document is read once
as its sequence of word numbers. Normalising changes no byte's place (bytes outside words become spaces, A-Z become
a-z), so a word's place in the normalised text is its place in the original.

Benchmark windows go to the executors in blocks of at most `block_windows`, so what is sent at once is bounded; a larger
benchmark takes one scan for each block. Items are cut by a Spark job; the driver holds one block at a time. A document's
hits of all blocks are merged before their share is taken.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item has no windows; an item with
fewer than `width` words is one window; rows with one item_id are one item; an item without an identifier marks words
but is not listed; doc_id may have any type; repeated rows are judged one by one; a very long text is read whole; an empty
table on either side works; further columns are ignored by the report and kept by clean_documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.llm.arrow import slices
from quoin.scratch import stored
from quoin.session import ship

#: Byte by byte: A-Z become a-z, letters, digits and all bytes from 0x80 stay, all others become spaces.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _scanned(kind: str) -> str:
    return f"doc_id {kind}, n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(PLAIN).split() if text else []


def windows_of(words: list[bytes], width: int) -> Iterator[tuple[bytes, ...]]:
    if words:
        yield from (tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def blocks(items: Iterator, width: int, block_windows: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items, in lists of at most `block_windows` windows; a longer item is cut with an overlap, losing no window."""
    block, n = [], 0
    for row in items:
        words = words_of(row.text)
        for i in range(0, max(1, len(words) - width + 1), block_windows):
            part = words[i : i + block_windows + width - 1]
            more = max(1, len(part) - width + 1)
            if n + more > block_windows and block:
                yield block
                block, n = [], 0
            block.append((None if row.item_id is None else str(row.item_id), part))
            n += more
    if block:
        yield block


class Item(NamedTuple):
    item_id: object
    text: str | None


def _cut(width: int, block_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = (Item(*row) for batch in slices(batches) for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        base = TaskContext.get().partitionId() << 33
        for k, block in enumerate(blocks(items, width, block_windows)):
            windows = [max(1, len(words) - width + 1) for _, words in block]
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + k] * len(block), pa.int64()), pa.array([name for name, _ in block], pa.string()), pa.array([b" ".join(words) for _, words in block], pa.binary()), pa.array(windows, pa.int64())],
                names=["block", "name", "words", "windows"],
            )

    return run


def benchmark_blocks(benchmark: DataFrame, width: int, block_windows: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The benchmark as blocks() makes them of each partition, small ones that follow each other taken together. The driver
    gets a row for each block of a partition, and the words of one block at a time."""
    cut = stored(benchmark.select("item_id", "text").mapInArrow(_cut(width, block_windows), "block bigint, name string, words binary, windows bigint"), "items")
    sizes = [(r.block, r.n) for r in cut.groupBy("block").agg(F.sum("windows").alias("n")).orderBy("block").collect()]
    at = 0
    while at < len(sizes):
        end, n = at + 1, sizes[at][1]
        while end < len(sizes) and n + sizes[end][1] <= block_windows:
            end, n = end + 1, n + sizes[end][1]
        rows = cut.filter(F.col("block").between(sizes[at][0], sizes[end - 1][0])).select("name", "words").collect()
        yield [(r.name, bytes(r.words).split()) for r in rows]
        at = end


def automaton(block: list[tuple[str | None, list[bytes]]], width: int):
    """Word numbers, and the automaton: window -> (number of words, names of its items)."""
    number: dict[bytes, int] = {}
    found: dict[tuple[int, ...], set] = {}
    for name, words in block:
        for window in windows_of(words, width):
            key = tuple(number.setdefault(w, len(number) + 1) for w in window)
            found.setdefault(key, set()).add(name)
    out = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, names in found.items():
        out.add_word(key, (len(key), tuple(n for n in names if n is not None)))
    out.make_automaton()
    return number, out if found else None


#: How many automata this process has built.
BUILT = 0


def _machine(block, width: int):
    """The automaton of a block that was sent to all workers: built once in a worker process, whatever the number of its tasks."""
    global BUILT
    made = block.__dict__.get("_quoin_machine")
    if made is None or made[0] != width:
        made = block._quoin_machine = (width, *automaton(block.value, width))
        BUILT += 1
    return made[1:]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(block, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, machine = _machine(block, width)
        for batch in slices(batches):
            counts, spans, items = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                hits, names = [], set()
                if machine is not None and words:
                    numbers = tuple(number.get(w, 0) for w in words)
                    for end, (n, who) in machine.iter(numbers):
                        hits.append((end - n + 1, end))
                        names.update(who)
                counts.append(len(words))
                spans.append([{"first": a, "last": b} for a, b in merged(hits)])
                items.append(sorted(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "items"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_windows: int = 200_000) -> DataFrame:
    """doc_id, n_words, spans (first and last word of each hit stretch, from 0), items (their item_ids, sorted)."""
    spark = docs.sparkSession
    ship(spark)
    texts, kind = docs.select("doc_id", "text"), dict(docs.dtypes)["doc_id"]
    parts = benchmark_blocks(benchmark, width, block_windows)
    first, second = next(parts, []), next(parts, None)
    if second is None:
        return texts.mapInArrow(_scan(spark.sparkContext.broadcast(first), width), _scanned(kind))
    # Several blocks, a scan for each over rows that were numbered once; the hits of a row meet by its number.
    numbered = stored(texts.select(F.monotonically_increasing_id().alias("doc_id"), F.col("doc_id").alias("_name"), "text"), "numbered")
    texts = numbered.select("doc_id", "text")
    met = _hits(texts, chain([first, second], parts), width).drop("n_words")
    plain = texts.mapInArrow(_scan(spark.sparkContext.broadcast([]), width), _scanned("bigint")).select("doc_id", "n_words")
    out = numbered.select("doc_id", "_name").join(plain, "doc_id").join(met, "doc_id", "left")
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    return out.select(F.col("_name").alias("doc_id"), "n_words", F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _hits(texts: DataFrame, parts: Iterator, width: int) -> DataFrame:
    """The rows of texts (doc_id unique, text) that any block hits: a scan for each block, hits merged by doc_id."""
    spark, hits = texts.sparkSession, None
    for block in parts:
        one = stored(texts.mapInArrow(_scan(spark.sparkContext.broadcast(block), width), _scanned("bigint")).filter("size(spans) > 0"), "hits")
        hits = one if hits is None else hits.unionByName(one)
    met = hits.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return met.mapInArrow(_met, _scanned("bigint"))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row's spans from several blocks, joined where they touch."""
    for batch in batches:
        spans = [[{"first": a, "last": b} for a, b in merged([(s["first"], s["last"]) for s in row])] for row in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, SPANS), batch.column(3)], names=batch.schema.names)


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word stretches as (start, end) offsets in the UTF-8 bytes of the original text."""
    flat = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(PLAIN), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flat, [False])).astype(np.int8)))
    return [(int(edges[2 * a]), int(edges[2 * b + 1])) for a, b in spans]


def n_hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def contamination_report(docs: DataFrame, benchmark: DataFrame, width: int = 10, **how) -> DataFrame:
    found, n_hit = contamination(docs, benchmark, width, **how), n_hit_words()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _clean(block, width: int, most_hit: float):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        number, machine = _machine(block, width)

        def share(text: str | None) -> float:
            words = words_of(text)
            if machine is None or not words:
                return 0.0
            hits = merged([(end - n + 1, end) for end, (n, _) in machine.iter(tuple(number.get(w, 0) for w in words))])
            return sum(b - a + 1 for a, b in hits) / len(words)

        for texts in batches:
            yield pd.Series([share(t) <= most_hit for t in texts], dtype=bool)

    return clean


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = 10, most_hit: float = 0.0, block_windows: int = 200_000) -> DataFrame:
    """The documents of which the benchmark hits at most the share `most_hit` of words, all columns as they were. Only
    texts go to Python workers."""
    spark = docs.sparkSession
    ship(spark)
    parts = benchmark_blocks(benchmark, width, block_windows)
    first, second = next(parts, []), next(parts, None)
    if second is None:
        return docs.filter(_clean(spark.sparkContext.broadcast(first), width, most_hit)(F.col("text")))
    numbered = stored(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("doc_id")), "numbered")
    hits = _hits(numbered.select("doc_id", F.col("row.text").alias("text")), chain([first, second], parts), width)
    return numbered.join(hits.filter(n_hit_words() / F.col("n_words") > most_hit), "doc_id", "left_anti").select("row.*")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"regexp_extract_all(regexp_replace(lower_az, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM (SELECT doc_id, {_LOWER} AS lower_az FROM documents)),
b AS (SELECT item_id, {_WORDS} AS w FROM (SELECT item_id, {_LOWER} AS lower_az FROM benchmark)),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
