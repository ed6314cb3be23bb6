"""Collecting input documents: filters, resumption, deduplication, round robin, category walks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.operators.components import components
from quoin.operators.numbering import number_rows, rank_within
from quoin.scratch import drop, stored
from quoin.session import ship

# Image types that are accepted, and those taken as thumbnails only.
ALLOWED_MIMES = ["image/jpeg", "image/png", "image/tiff", "image/webp"]
THUMB_ONLY_MIMES = ["image/tiff", "image/webp"]
#: Pages of a catalogue that are asked for at the utmost. Fixed value.
MAX_PAGES = 1000


def round_robin(items: DataFrame, source: str, order: str, source_order: str | None = None) -> DataFrame:
    """items with turn: all firsts of the sources, then all seconds; a source that has run out leaves. Sorting by
    (turn, source_order) gives the sequence."""
    return rank_within(items, source, [order, *([source_order] if source_order else [])], "turn")


def _blank(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit("")) == ""


def first_by_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; rows with a blank or null key all stay. A key's rows are reduced where they lie first, so a
    key that most rows have is never gathered."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    first = rows.filter(~_blank(key)).groupBy(F.col(key).alias("_key")).agg(F.min_by(whole, F.struct(*order)).alias("_row")).select("_row.*")
    return first.unionByName(rows.filter(_blank(key)))


def _rounds(left: DataFrame, most: int | None = None) -> tuple[list[DataFrame], DataFrame | None]:
    """(tables of `o` that stay, rows that are not settled yet, or None) of rows (o, a, b). In each round a row that is first
    under both its keys is kept and all rows with its keys are settled; the first row left is always such a row."""
    left, kept = stored(left, "left"), []
    while left.limit(1).count():
        if most is not None and len(kept) == most:
            return kept, left
        first_a, first_b = (left.groupBy(k).agg(F.min("o").alias("o")) for k in "ab")
        new = stored(left.join(first_a, ["a", "o"], "left_semi").join(first_b, ["b", "o"], "left_semi").select(*left.columns), "kept")
        kept.append(new.select("o"))
        settled, left = left, stored(left.join(new.select("a"), "a", "left_anti").join(new.select("b"), "b", "left_anti").select(*new.columns), "left")
        drop(settled)
    return kept, None


def first_by_two_keys(rows: DataFrame, keys: tuple[str, str], order: str, rounds: int = 3, most: int = 100_000) -> DataFrame:
    """Rows in order (unique), each kept unless a kept one before has its first or its second key; a blank or null key never
    counts. A few rounds settle what shares keys with a first row. What is left are long chains: they fall into components of
    shared keys, each of which is gone through in order by one task that holds its keys; a component of over `most` rows is
    settled in rounds after all."""
    own = lambda k, n: F.when(_blank(k), F.concat(F.lit("o"), F.col(order).cast("string"))).otherwise(F.concat(F.lit("k"), F.col(k).cast("string"))).alias(n)
    kept, left = _rounds(rows.select(F.col(order).alias("o"), *[own(k, n) for n, k in zip("ab", keys, strict=True)]), rounds)
    if left is not None:
        kept.append(_by_component(left, most))
    found = reduce(lambda x, y: x.unionByName(y), kept) if kept else rows.select(F.col(order).alias("o")).limit(0)
    return rows.join(found.withColumnRenamed("o", order), order, "left_semi").select(*rows.columns)


def _by_component(rows: DataFrame, most: int) -> DataFrame:
    """The `o` that stay of rows (o, a, b), component by component."""
    ship(rows.sparkSession)
    narrow, edges = rows.withColumn("node", F.xxhash64("o")), []
    for k in "ab":
        # Rows of a key hang on one of them, so a key that many rows have makes a row each.
        hubs = narrow.groupBy(k).agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        edges.append(narrow.join(hubs, k).select(F.col("node").alias("a"), F.col("hub").alias("b")))
    roots = components(edges[0].unionByName(edges[1]))
    met = stored(narrow.join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), "o", "a", "b"), "components")
    large = stored(met.groupBy("root").count().filter(F.col("count") > most).select("root"), "large")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, (set(), set())
        for batch in batches:
            keep, columns = [], [batch.column(k).to_pylist() for k in (0, 2, 3)]
            for k, (root, a, b) in enumerate(zip(*columns, strict=True)):
                if root != now:
                    now, seen = root, (set(), set())
                if a not in seen[0] and b not in seen[1]:
                    seen[0].add(a)
                    seen[1].add(b)
                    keep.append(k)
            if keep:
                yield batch.take(pa.array(keep)).select([1])

    small = met.join(large, "root", "left_anti").select("root", "o", "a", "b").repartition("root").sortWithinPartitions("root", "o")
    kept = [small.mapInArrow(fold, f"o {rows.schema['o'].dataType.simpleString()}")]
    kept += _rounds(met.join(large, "root", "left_semi").select("o", "a", "b"))[0] if large.limit(1).count() else []
    return reduce(lambda x, y: x.unionByName(y), kept)


def without_seen(rows: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """rows of which none of the keys is among the seen ones."""
    for k in keys:
        rows = rows.join(seen.select(k).filter(F.col(k).isNotNull()).distinct(), k, "left_anti").select(*rows.columns)
    return rows


def accepted(width: Column, mime: Column, license_: Column, year: Column, min_width: int = 600, license_regex: str | None = None, min_year: int = 0) -> Column:
    """Type allowed, wide enough, licence matching (anywhere, any case), not too old; an unknown year passes."""
    ok = mime.isin(ALLOWED_MIMES) & (F.coalesce(width, F.lit(0)) >= min_width)
    if license_regex:
        ok &= license_.rlike(f"(?i){license_regex}")
    if min_year:
        ok &= year.isNull() | (year >= min_year)
    return ok


def use_thumbnail(mime: Column, width: Column, max_width: int = 2000) -> Column:
    return mime.isin(THUMB_ONLY_MIMES) | (F.coalesce(width, F.lit(0)) > max_width)


def year_between(year: Column, low: int, high: int) -> Column:
    return year.isNotNull() & year.between(low, high)


def walk(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node, level): nodes within `depth` steps of a root, each once, at its least level. edges (parent, child), roots
    (node). Each level is the last one's children without nodes met before."""
    found = roots.select("node", F.lit(0).alias("level")).distinct()
    front = found
    for level in range(1, depth + 1):
        front = front.join(edges, front["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct()
        front = stored(front.join(found.select("node"), "node", "left_anti").withColumn("level", F.lit(level)), "level")
        found = found.unionByName(front)
    return found


def in_source_order(sources: list[DataFrame], order: str) -> DataFrame:
    """The rows of all sources, those of the first before those of the second and so on: with src_ord (place of the source)
    and ord (a struct that sorts them), to be deduplicated in this order."""
    rows = [s.withColumn("src_ord", F.lit(k)) for k, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).withColumn("ord", F.struct("src_ord", order))


def first_new(rows: DataFrame, order: list[str], limit: int, seen: DataFrame | None = None) -> DataFrame:
    """The first rows in `order` (which tells them apart), as many as `limit` leaves over after those seen before; a limit
    of 0 is none. Rows are numbered over range partitions, so the limit may be large."""
    if not limit:
        return rows
    left = limit - (seen.count() if seen is not None else 0)
    return number_rows(rows, order, 1, "_n").filter(F.col("_n") <= left).drop("_n")


def listed_pages(pages: DataFrame, source: str, page: str, n_rows: Column, has_next: Column, most: int = MAX_PAGES) -> DataFrame:
    """Catalogue pages (counted from 0) up to the first empty one (without it) or the first without a link to the next (with
    it), and `most` of a catalogue at the utmost."""
    pages = pages.filter(F.col(page) < most)
    stop = F.least(F.when(n_rows == 0, F.col(page)), F.when(~has_next, F.col(page) + 1))
    stops = pages.groupBy(F.col(source).alias("_source")).agg(F.min(stop).alias("_stop"))
    met = pages.join(stops, F.col(source).eqNullSafe(F.col("_source")))
    return met.filter(F.col("_stop").isNull() | (F.col(page) < F.col("_stop"))).select(*pages.columns)
