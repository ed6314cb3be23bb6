"""Language-model scores of texts by a hashed maximum-entropy model.

The next word's probability is factored by classes: P(class | history) * P(word | class, history). Frequent words fall into
classes of WIDE words by frequency; all others into classes by their ending. Features of the history are the word before, the
one before that (a skip) and both together. Every unit (a frequent word or a class of rare ones) at either place has a row of
weights of its own for the classes and, together with a class, one for the words in it; only pairs of units, which are too many
for that, are hashed to rows. Weights multiply what plain counts say (so a model without weights is the base score); within
a class of rare words the counts alone decide. Every class of rare words has room for one unseen word, as the base has.

All training texts are counted, and all of them are used in training. What a gradient needs of a text is how often each class
follows each two units, and these contexts are counted once over the corpus: 1073 x 1073 x 64 numbers at most. Weights start
from what the features are seen with; each update then goes over all contexts in tasks that add up what the model expects, the
sums meet by a shuffle of weight rows, and the driver holds the weights alone (10 MB), whatever the size of the corpus.
Words are encoded once, as numbers of two bytes; counts of the LISTED most frequent words go to the workers, those of all
others meet the documents in a join.

Defined cases: a null text is empty, and an empty text is the end of a text alone, which is counted as a token; a document
without an identifier is learned from and not held out; without any training text the model is the base (0 for each token);
repeated rows count as often and get the same score; an empty table gives an empty result; very long texts are read in pieces;
further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from copy import copy
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.llm.arrow import pieces, slices
from quoin.scratch import stored
from quoin.session import ship

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words in a class of frequent words, classes of frequent and of rare words.
WIDE, FREQUENT, RARE = 64, 16, 48
CLASSES = FREQUENT + RARE
#: A token's unit: a frequent word's number, or WORDS + a class of rare words; BEFORE stands in front of a text.
WORDS = WIDE * FREQUENT
BEFORE = WORDS + RARE
#: Most words whose counts are sent to the workers; the end of a text among words.
LISTED, END = 1 << 18, b"\n"
#: Rows of weights for classes, and for words: in each class of frequent words one for each unit before and for each one before
#: that; words that are scored as one array, and counts a worker holds.
CLASS_ROWS, WORD_ROWS, CHUNK, HELD = 1 << 12, 2 * (BEFORE + 1) * FREQUENT, 1 << 14, 400_000
#: Fixed point in which gradients are added up, so that their order doesn't matter.
FINE = 1 << 16
#: Words for each task of a counting pass, and contexts for each task of an update.
TASK_WORDS, TASK_CONTEXTS = 1 << 22, 1 << 20
#: The least probability that is told from none.
TINY = np.float32(1e-30)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 1, F.lit(False))


# --- counts -----------------------------------------------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        words = list(held)
        for i in range(0, len(words), 50_000):
            some = words[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array([held[w] for w in some], pa.int64())], ["word", "c"])
        held.clear()

    for batch in slices(batches):
        for text in batch.column(0).to_pylist():
            for piece in pieces(text.translate(LOWER)):
                held.update(piece.split())
            held[END] += 1
        if len(held) > HELD:
            yield from out()
    yield from out()


def word_counts(texts: DataFrame) -> DataFrame:
    """word (bytes), c: all words of the column text, and the ends of texts."""
    return texts.select(F.col("text").cast("binary")).mapInArrow(_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int = LISTED) -> DataFrame:
    """The words of greatest counts, as many as have counts above the least one that keeps them below `most`."""
    level = F.floor(F.log2("c") * 8)
    levels = counts.groupBy(level.alias("level")).count().orderBy(F.col("level").desc()).collect()
    seen, least = 0, None
    for x in levels:
        seen += x["count"]
        if seen > most:
            break
        least = x["level"]
    return counts.filter(level >= F.lit(least)) if least is not None else counts.limit(0)


# --- the model, in Python workers and on the driver -------------------------------------------------------------------------


class Model:
    """Listed words and their counts, sizes of classes, and weights."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, distinct: int, rare: dict[int, float]):
        """words in order of falling counts; rare: for a class of rare words the sum of counts + 0.5 over all its words."""
        self.total, self.words = total, words
        self.norm = float(np.log10(total + 0.5 * (distinct + 1)))
        c = np.array(counts, float) + 0.5
        # The last stands for words that are not listed; a frequent word has its count in its share already.
        self.logs = np.log10(np.append(c, 1.0))
        self.rare_logs = np.where(np.arange(len(c) + 1) < WORDS, 0.0, self.logs)
        mass = np.full((FREQUENT, WIDE), 1e-12)
        mass.ravel()[: min(WORDS, len(words))] = c[:WORDS]
        self.rest = np.array([rare.get(k, 0.0) + 0.5 for k in range(RARE)])  # with the unseen word's room
        sizes = np.append(mass.sum(axis=1), self.rest)
        self.word_prior, self.class_prior = np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32), np.log(sizes / sizes.sum()).astype(np.float32)
        self.units = np.append(np.array([k if k < WORDS else WORDS + ending(w) for k, w in enumerate(words)], np.int16), np.int16(-1))
        self.for_classes, self.for_words = np.zeros((CLASS_ROWS, CLASSES), np.float32), np.zeros((WORD_ROWS, WIDE), np.float32)

    def numbers(self) -> dict[bytes, int]:
        return {w: k for k, w in enumerate(self.words)}

    def without_words(self) -> Model:
        """What scoring and training need: the words' numbers are no longer asked for, and stay on the driver no longer."""
        out = copy(self)
        out.words, out.logs, out.rare_logs, out.units = [], self.logs[:0], self.rare_logs[:0], self.units[:0]
        return out

    def features(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows for classes of the word before, the one before that, and both."""
        both = (one * np.int64(1_000_003) + two) * np.int64(0x9E3779B1)
        plain = BEFORE + 1
        return one, plain + two, 2 * plain + (both >> 15) % (CLASS_ROWS - 2 * plain)

    def word_features(self, kind: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows for words of a class: it with the word before, and it with the one before that."""
        plain = BEFORE + 1
        return 2 * plain * kind + one, 2 * plain * kind + plain + two

    def class_shares(self, rows: tuple[np.ndarray, ...]) -> np.ndarray:
        return _shares(sum((self.for_classes[r] for r in rows[1:]), self.for_classes[rows[0]] + self.class_prior))

    def word_shares(self, kind: np.ndarray, rows: tuple[np.ndarray, ...]) -> np.ndarray:
        return _shares(self.for_words[rows[0]] + self.for_words[rows[1]] + self.word_prior[kind])

    def parts(self, units: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple:
        """(class, class rows, places of frequent words, their place in the class, word rows)."""
        units, one, two = units.astype(np.int64), one.astype(np.int64), two.astype(np.int64)
        common = np.flatnonzero(units < WORDS)
        kind = np.where(units < WORDS, units // WIDE, units - WORDS + FREQUENT)
        return kind, self.features(one, two), common, units[common] % WIDE, self.word_features(kind[common], one[common], two[common])

    def log10(self, units: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """For each token the class's log probability, and with it the word's; of a rare word, all but log10(c + 0.5)."""
        kind, rows, common, at, word_rows = self.parts(units, one, two)
        p = self.class_shares(rows)
        out = np.log10(np.maximum(p[np.arange(len(units)), kind], TINY), dtype=float)
        q = self.word_shares(kind[common], word_rows)
        out[common] += np.log10(np.maximum(q[np.arange(len(common)), at], TINY))
        rare = np.flatnonzero(units >= WORDS)
        out[rare] -= np.log10(self.rest)[units[rare] - WORDS]
        return out


def ending(word: bytes) -> int:
    """A word's class among rare ones: its last two bytes, and whether it has longer characters."""
    half = RARE // 2
    return zlib.crc32(word[-2:]) % half + half * (not word.isascii())


def _shares(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _history(units: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The units one and two before each token, where texts that begin at `starts` lie one after another."""
    one, two = np.empty_like(units), np.empty_like(units)
    one[1:], two[2:] = units[:-1], units[:-2]
    one[starts] = two[starts] = BEFORE
    second = starts + 1
    two[second[second < len(units)]] = BEFORE
    return one, two


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(units of all texts of the batch, offsets) from its binary column `units`."""
    column = batch.column(batch.schema.get_field_index("units"))
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.int16), np.cumsum([0, *(n // 2 for n in pc.binary_length(column).to_pylist())])


# --- encoding ---------------------------------------------------------------------------------------------------------------

ENCODED = "n_tokens long, n_known long, known_log double, listed_log double, units binary, rare array<struct<word:binary,tf:long>>"


def encoded(texts: DataFrame, shared: Broadcast) -> DataFrame:
    """texts' other columns with ENCODED: units of all tokens, what the listed words add to the base and those of rare classes
    to the score, and the words that are not listed."""
    rest = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        find, none = model.numbers().get, len(model.words)
        for batch in slices(batches, 64):
            n, known, logs, listed, units, words, counts, ends = [], [], [], [], [], [], [], [0]
            for text in batch.column(len(rest)).to_pylist():
                parts, rare, log, rare_log, missed = [], Counter(), 0.0, 0.0, 0
                for piece in (*pieces(text.translate(LOWER)), None):
                    some = [END] if piece is None else piece.split()
                    at = np.fromiter(map(find, some, repeat(none)), np.int64, len(some))
                    own, others = model.units[at], np.flatnonzero(at == none).tolist()
                    for i in others:
                        own[i] = WORDS + ending(some[i])
                    rare.update([some[i] for i in others])
                    parts.append(own.tobytes())
                    log, rare_log, missed = log + float(model.logs[at].sum()), rare_log + float(model.rare_logs[at].sum()), missed + len(others)
                units.append(b"".join(parts))
                n.append(len(units[-1]) // 2)
                known.append(n[-1] - missed)
                logs.append(log)
                listed.append(rare_log)
                words += rare.keys()
                counts += rare.values()
                ends.append(len(words))
            rare = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], ["word", "tf"])
            columns = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.array(listed, pa.float64()), pa.array(units, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *columns], [*rest, "n_tokens", "n_known", "known_log", "listed_log", "units", "rare"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*rest).schema.fields)
    return texts.select(*rest, F.coalesce("text", F.lit("")).cast("binary")).mapInArrow(run, f"{kinds}, {ENCODED}")


# --- training ---------------------------------------------------------------------------------------------------------------


PACKED = "part int, at int, sums binary"


def _by_row(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Adds values to total's rows."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else rows
    if len(rows):
        total[rows[first]] += np.add.reduceat(values[order], first, axis=0)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in slices(batches, 64):
        units, ends = _texts(batch)
        one, two = _history(units, ends[:-1])
        for i in range(0, len(units), CHUNK):
            yield units[i : i + CHUNK], one[i : i + CHUNK], two[i : i + CHUNK]


def _packed(totals: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows of a task's sums that are not zero: part (place in totals), at, sums."""
    for k, t in enumerate(totals):
        some = np.flatnonzero(t.any(axis=1))
        for i in range(0, len(some), 1024):
            part = some[i : i + 1024]
            numbers = np.rint(t[part] * FINE).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(part), pa.int32()), pa.array(part, pa.int32()), pa.array([x.tobytes() for x in numbers], pa.binary())], ["part", "at", "sums"])


def _added(tasks: DataFrame, shapes: list[tuple[int, int]]) -> list[np.ndarray]:
    """Sums of _packed rows over all tasks. A row of weights meets in one task, which adds up as it reads; what comes back is
    a sum for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, at, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(sums, np.int64)
                held[k, at] = held[k, at] + x if (k, at) in held else x
        keys = list(held)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([a for _, a in keys], pa.int32()), pa.array([held[k].tobytes() for k in keys], pa.binary())], ["part", "at", "sums"])

    totals = [np.zeros(shape) for shape in shapes]
    for batch in tasks.repartition("part", "at").mapInArrow(run, PACKED).toArrow().to_batches():
        for k, at, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            totals[k][at] = np.frombuffer(sums, np.int64) / FINE
    return totals


def contexts_of(texts: DataFrame) -> DataFrame:
    """at, n of texts (units): how often each class of word follows each two units; at is (one, two, class) as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            at, n = np.unique(np.concatenate([np.empty(0, np.int32), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n, pa.int64())], ["at", "n"])

        for units, one, two in _tokens(batches):
            kind = np.where(units < WORDS, units // WIDE, units - WORDS + FREQUENT).astype(np.int32)
            held.append((one.astype(np.int32) * (BEFORE + 1) + two) * CLASSES + kind)
            size += len(units)
            if size >= TASK_WORDS:
                yield out()
                size = 0
        yield out()

    return texts.select("units").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))


def _seen_words(texts: DataFrame, shared: Broadcast) -> np.ndarray:
    """How often each row of weights for words is seen with each word of its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = shared.value, np.zeros((WORD_ROWS, WIDE))
        for units, one, two in _tokens(batches):
            common = np.flatnonzero(units < WORDS)
            units, one, two = (x[common].astype(np.int64) for x in (units, one, two))
            for r in model.word_features(units // WIDE, one, two):
                np.add.at(total.ravel(), r * WIDE + units % WIDE, 1.0)
        yield from _packed([total])

    return _added(texts.select("units").mapInArrow(run, PACKED), [(WORD_ROWS, WIDE)])[0]


def _expected(contexts: DataFrame, shared: Broadcast) -> list[np.ndarray]:
    """Over all contexts (at, n), which lie together by (one, two): how often each row of weights is seen with each class, and
    how often the model expects it with each class, and with each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        totals = [np.zeros((CLASS_ROWS, CLASSES)), np.zeros((CLASS_ROWS, CLASSES)), np.zeros((WORD_ROWS, WIDE))]
        for batch in batches:
            at, n = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy().astype(float)
            pair, place = np.unique(at // CLASSES, return_inverse=True)
            kind, one, two = at % CLASSES, pair // (BEFORE + 1), pair % (BEFORE + 1)
            rows = model.features(one, two)
            p = model.class_shares(rows) * np.bincount(place, weights=n)[:, None]
            for r in rows:
                np.add.at(totals[0].ravel(), r[place] * CLASSES + kind, n)
                _by_row(totals[1], r, p)
            common = np.flatnonzero(kind < FREQUENT)
            kind, place = kind[common], place[common]
            rows = model.word_features(kind, one[place], two[place])
            q = model.word_shares(kind, rows) * n[common, None]
            for r in rows:
                _by_row(totals[2], r, q)
        yield from _packed(totals)

    return _added(contexts.mapInArrow(run, PACKED), [(CLASS_ROWS, CLASSES), (CLASS_ROWS, CLASSES), (WORD_ROWS, WIDE)])


def _priors(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """What a row of weights would see without any feature: shares of classes, and of the words in the row's class."""
    return np.exp(model.class_prior.astype(float))[None], np.repeat(np.exp(model.word_prior.astype(float)), WORD_ROWS // FREQUENT, axis=0)


def train(docs: DataFrame, model: Model, updates: int = 3, trust: float = 20.0, rate: float = 0.5) -> Model:
    """docs: ENCODED training texts. The first weights say how much likelier a class or word is with the feature than without,
    drawn towards no difference by `trust` sightings, and shared among the features that hold at once. In each update a weight
    grows by how often its feature is seen beyond what the model expects, as the logarithm of the ratio."""
    spark = docs.sparkSession
    n = docs.agg(F.sum("n_tokens")).first()[0]
    if not n:
        return model
    docs = docs.coalesce(max(1, -(-n // TASK_WORDS)))  # so that what is shuffled stays small beside the text
    contexts = stored(contexts_of(docs), "contexts")
    contexts = contexts.repartitionByRange(max(1, -(-contexts.count() // TASK_CONTEXTS)), "at").sortWithinPartitions("at")
    contexts = stored(contexts, "contexts")

    def with_model(work: Callable[[Broadcast], object]) -> object:
        shared = spark.sparkContext.broadcast(model)
        out = work(shared)
        shared.destroy()
        return out

    words = with_model(lambda shared: _seen_words(docs, shared))
    classes = with_model(lambda shared: _expected(contexts, shared))[0]
    weights, seen, priors = (model.for_classes, model.for_words), (classes, words), [trust * p for p in _priors(model)]
    for w, s, p in zip(weights, seen, priors, strict=True):
        w[:] = np.log((s + p) / (p / trust * (s.sum(axis=1, keepdims=True) + trust))) / 2
    for _ in range(updates):
        expected = with_model(lambda shared: _expected(contexts, shared))[1:]
        for w, s, e, p in zip(weights, seen, expected, priors, strict=True):
            w += (rate * np.log((s + p) / (e + p))).astype(np.float32)
    return model


# --- scores -----------------------------------------------------------------------------------------------------------------


def fitted(texts: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """texts (learn boolean, text, ...): the model of those to learn from, all texts ENCODED with row, and the counts of the
    training words that are not listed."""
    spark = texts.sparkSession
    ship(spark)
    counts = stored(word_counts(texts.filter("learn").select(F.coalesce("text", F.lit("")).alias("text"))), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    found = frequent_words(counts).toArrow().sort_by([("c", "descending"), ("word", "ascending")])
    words, seen = found.column("word").to_pylist(), found.column("c").to_pylist()
    others = counts.filter(F.col("c") < seen[-1]) if words else counts

    @F.pandas_udf("int")
    def endings(found: pd.Series) -> pd.Series:
        return found.map(ending)

    rare = Counter({r["k"]: r["m"] for r in others.groupBy(endings("word").alias("k")).agg(F.sum(F.col("c") + F.lit(0.5)).alias("m")).collect()})
    for w, c in zip(words[WORDS:], seen[WORDS:], strict=True):
        rare[ending(w)] += c + 0.5
    model = Model(words, seen, total, distinct, rare)
    shared = spark.sparkContext.broadcast(model)
    docs = stored(encoded(texts.withColumn("row", F.monotonically_increasing_id()).select(*[c for c in texts.columns if c != "text"], "row", "text"), shared), "encoded")
    shared.destroy()
    return train(docs.filter("learn"), model.without_words()), docs, others


def scored(docs: DataFrame, model: Model, others: DataFrame) -> DataFrame:
    """ENCODED texts' own columns with n_tokens, n_known, train_tokens, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keys = [c for c in docs.columns if c not in ("row", "n_tokens", "n_known", "known_log", "listed_log", "units", "rare")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, 64):
            units, ends = _texts(batch)
            one, two = _history(units, ends[:-1])
            logs = np.concatenate([m.log10(units[i : i + CHUNK], one[i : i + CHUNK], two[i : i + CHUNK]) for i in range(0, len(units), CHUNK)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.add.reduceat(logs, ends[:-1]), pa.float64())], [*batch.schema.names[:-1], "model_log"])

    own = docs.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf")
    met = own.join(others, "word", "left").groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("rare_log"), F.sum(F.when(F.col("c").isNotNull(), F.col("tf"))).alias("rare_known")
    )
    rows = docs.select(*keys, "row", "n_tokens", "n_known", "known_log", "listed_log", "units")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("units").schema.fields)
    out = rows.mapInArrow(run, f"{kinds}, model_log double").join(met, F.col("row") == F.col("_row"), "left")
    rare = F.coalesce("rare_log", F.lit(0.0))
    base = F.col("known_log") + rare - F.col("n_tokens") * F.lit(model.norm)
    return out.select(
        *keys, "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("model_log") + F.col("listed_log") + rare if model.total else base).alias("score"),
    )


def op11_language_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = held_out(F.col("doc_id"))
    model, texts, others = fitted(docs.select("doc_id", held.alias("held_out"), (~held).alias("learn"), "text"))
    return scored(texts, model, others).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
