"""Audit of how the sources of a language diverge in their words, by count cells.

Each language keeps the terms that `min_docs` of its documents have. A group is a (language, source); a term's share in it,
or in the language, is a whole number (`share`). Terms of a group with the same (count in the group, count in the language)
have the same shares and so form a cell: the difference is evaluated once a cell, cells are ranked by the terms before them,
cells of equal value are merged, and only the terms of the cells that reach the first `top` ranks are written out, in UTF-8
order. Pairs of sources are summed over blocks of terms and blocks of sources, so that no task holds a language.

Defined cases: null text, lang and source are read as empty ones; a text without a term counts as a document; a group
without kept terms has shares of count 0, and in a language without kept terms every difference is 0; a language with one
source has no pairs; repeated rows are documents of their own; equal values are ranked by the item's UTF-8 bytes; a very
long text is cut into pieces between words, which are counted one by one; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.llm.arrow import pieces, slices
from quoin.scratch import stored
from quoin.session import ship

#: Shares are counted in this many parts, and each count is raised by this much.
PARTS, RAISED = 1_000_000_000, 5
#: Bytes as they are counted: letters lower-cased, bytes of longer characters as they are, all else a border.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: How many counts a worker holds before it hands them on.
HELD = 400_000
COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COUNTS of the rows (lang, source, text as bytes), added up as far as memory allows."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms, size = list(n), len(n)
            for i in range(0, size, 50_000):
                some = terms[i : i + 50_000]
                texts = pa.array(some, pa.binary()).cast(pa.string())
                columns = [pa.array([lang] * len(some)), pa.array([source] * len(some)), texts, pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in slices(batches):
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            met: set[bytes] = set()
            for piece in pieces(text.translate(LETTERS)):
                words = piece.split()
                n.update(words)
                met.update(words)
            docs.update(met)
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from out()
    yield from out()


def kept_terms(docs: DataFrame, min_docs: int = 30) -> DataFrame:
    """lang, source, term, n, lang_n: the occurrences of each kept term in each group that has it, and in the language."""
    ship(docs.sparkSession)
    counts = docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(_counted, COUNTS)
    # Dealt once by term; the sums over groups and over the language keep to that.
    rows = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    rows = rows.withColumn("lang_n", F.sum("n").over(term)).withColumn("_docs", F.sum("docs").over(term))
    return rows.filter(F.col("_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n")


def share(n: str, total: str, terms: str) -> str:
    """SQL of a share: 1 plus the whole part of PARTS * (n + RAISED) / (total + RAISED * terms), with numbers that don't
    overflow; 0 where there are no terms."""
    return f"if({terms} = 0, 0, 1 + (cast({PARTS} as decimal(10,0)) * cast({n} + {RAISED} as decimal(20,0))) div cast(nullif({total} + {RAISED} * {terms}, 0) as decimal(20,0)))"


def sized_groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total (occurrences of kept terms), lang_total, terms: every occurring group, also those without terms."""
    terms = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    rows = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(terms, "lang", "left")
    return rows.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "lang_total", "terms")])


def term_ranks(kept: DataFrame, groups: DataFrame, top: int = 50) -> DataFrame:
    """lang, source, item, value, rank: the terms that a group has more of than its language, the `top` greatest first."""
    group, cell = ["lang", "source"], ["lang", "source", "n", "lang_n"]
    cells = kept.groupBy(*cell).agg(F.count(F.lit(1)).alias("many")).join(groups, group)
    value = F.expr(f"{share('n', 'total', 'terms')} - {share('lang_n', 'lang_total', 'terms')}")
    cells = cells.select(*cell, "many", value.alias("value")).filter("value > 0")
    merged = cells.groupBy(*group, "value").agg(F.sum("many").alias("many"))
    down = Window.partitionBy(*group).orderBy(F.col("value").desc())
    # A value has a term at least, so no more than `top` values can count; what lies before them is added up after that.
    merged = merged.withColumn("_at", F.row_number().over(down)).filter(F.col("_at") <= top)
    before = F.coalesce(F.sum("many").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = cells.join(merged.select(*group, "value", before.alias("before")).filter(F.col("before") < top), [*group, "value"])
    rows = kept.join(reached.select(*cell, "value", "before"), cell)
    alike = Window.partitionBy(*group, "value").orderBy("term")
    rows = rows.withColumn("_at", F.row_number().over(alike)).filter(F.col("_at") <= top).withColumn("rank", F.col("before") + F.col("_at"))
    return rows.filter(F.col("rank") <= top).select(*group, F.col("term").alias("item"), "value", "rank")


def _differences(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of differences over the terms of one block, for the pairs of sources of two blocks of sources (or of one), less
    what they would be if neither source had any of the terms. Rows without a term give each source's share of count 0."""
    i, j = rows["i"].iloc[0], rows["j"].iloc[0]
    none = rows[rows["term"].isna()].sort_values(["side", "at"])
    place = {at: k for k, at in enumerate(none["at"])}
    base, has = none["p"].to_numpy(np.int64), rows[rows["term"].notna()]
    column, terms = pd.factorize(has["term"])
    shares = np.repeat(base[:, None], len(terms), axis=1)
    shares[[place[a] for a in has["at"]], column] = has["p"].to_numpy(np.int64)
    side = none["side"].to_numpy()
    first, second = np.flatnonzero(side == i), np.flatnonzero(side == j)
    out = []
    for k, a in enumerate(first):
        b = second[k + 1 :] if i == j else second
        more = np.abs(shares[b] - shares[a]).sum(axis=1) - len(terms) * np.abs(base[b] - base[a])
        out.append(pd.DataFrame({"a": none["source"].iloc[a], "b": none["source"].iloc[b].to_numpy(), "more": more}))
    return pd.concat(out).assign(lang=rows["lang"].iloc[0])[["lang", "a", "b", "more"]] if out else pd.DataFrame({"lang": [], "a": [], "b": [], "more": []})


def pair_ranks(kept: DataFrame, groups: DataFrame, block_terms: int = 2048, block_sources: int = 256) -> DataFrame:
    """lang, source, item, value, rank: the other sources of the language by the sum of differences over all kept terms."""
    ship(kept.sparkSession)
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    sides = F.floor((F.max("at").over(Window.partitionBy("lang")) + block_sources) / block_sources)
    numbered = groups.withColumn("at", at).withColumn("side", F.floor(F.col("at") / block_sources)).withColumn("sides", sides)
    numbered = stored(numbered.withColumn("blocks", F.greatest(F.ceil(F.col("terms") / block_terms), F.lit(1))), "groups")
    known = ["lang", "source", "at", "side", "sides"]
    has = kept.join(numbered, ["lang", "source"]).select(*known, F.pmod(F.xxhash64("term"), "blocks").alias("block"), "term", F.expr(share("n", "total", "terms")).alias("p"))
    none = numbered.select(*known, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("string").alias("term"), F.expr(share("0", "total", "terms")).alias("p"))
    rows = has.unionByName(none).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)))
    rows = rows.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other"))
    found = rows.groupBy("lang", "block", "i", "j").applyInPandas(_differences, "lang string, a string, b string, more long")
    base = numbered.select("lang", "source", "terms", F.expr(share("0", "total", "terms")).alias("p"))
    sums = found.groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))
    for side in ("a", "b"):
        sums = sums.join(base.select("lang", F.col("source").alias(side), F.col("p").alias(f"p_{side}"), *(["terms"] if side == "a" else [])), ["lang", side])
    sums = sums.withColumn("value", F.col("more") + F.col("terms") * F.abs(F.col("p_a") - F.col("p_b")))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    rows = sums.select("lang", "value", both.alias("_pair")).select("lang", "_pair.*", "value")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))


def divergence(docs: DataFrame, min_docs: int = 30, top: int = 50) -> DataFrame:
    """docs (lang, source, text): lang, source, part ('pair' or 'term'), item, value, rank."""
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = stored(kept_terms(docs, min_docs), "terms")
    groups = stored(sized_groups(docs, kept), "groups")
    parts = [found.withColumn("part", F.lit(part)) for part, found in (("pair", pair_ranks(kept, groups)), ("term", term_ranks(kept, groups, top)))]
    names = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")]
    return parts[0].select(*names).unionByName(parts[1].select(*names))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "source", "text"))


_SHARE = "1 + 1000000000::HUGEINT * ({n} + 5) // ({total} + 5 * v)"
OP12_SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
tok AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM tok GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
held AS (SELECT lang, source, term, count(*) AS n FROM tok GROUP BY 1, 2, 3),
c AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(h.n, 0) AS n FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
sized AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(lang_n) OVER (PARTITION BY lang, source) AS lang_total, count(*) OVER (PARTITION BY lang, source) AS v FROM c),
p AS MATERIALIZED (SELECT lang, source, term, n, {_SHARE.format(n="n", total="total")} AS p, {_SHARE.format(n="lang_n", total="lang_total")} AS q FROM sized),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(any_value(f), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3) s
    ON s.lang = a.lang AND s.a = a.source AND s.b = b.source GROUP BY 1, 2, 3),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', term, p - q, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
