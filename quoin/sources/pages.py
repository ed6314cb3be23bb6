"""Pages of documents: the contract of page readers, whose codecs are theirs, and the table of pages that comes of them.

A page reader is a function over the bytes of a document -> iterator of pages, each a dict with any of image (pixels,
height x width x channels), text, and chars. It runs in Python workers and gives pages one by one, so a long document is never
held whole. A reader that can tell how many pages a document has, and begin anywhere (RangeReader), gets long documents in
ranges of pages, which lie in different tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.operators.pixels import IMAGE
from quoin.scratch import stored
from quoin.session import ship

#: Dots an inch at which pages are rendered, and points an inch of a page. Fixed values.
RENDER_DPI, POINTS = 200, 72
PAGES = f"doc_ord bigint, page int, image {IMAGE}, text string, error string"

#: Pages of a document that one task reads at the utmost, if its reader can begin anywhere.
RANGE_PAGES = 64
#: Tasks that read ranges at the utmost.
MOST_TASKS = 20_000

#: read(content, dpi): the pages of one document.
PageReader = Callable[[bytes, int], Iterator[dict]]


class RangeReader(Protocol):
    """A reader that can begin anywhere: how many pages a document has, and those from `first` up to before `stop`."""

    def count(self, content: bytes) -> int: ...

    def read(self, content: bytes, dpi: int, first: int, stop: int) -> Iterator[dict]: ...


def _row(doc: int, page: int, got: dict | Exception) -> dict:
    row = {"doc_ord": doc, "page": page, "image": None, "text": None, "error": None}
    if isinstance(got, Exception):
        return row | {"error": f"{type(got).__name__}: {got}"}
    if got.get("image") is not None:
        image = np.atleast_3d(np.asarray(got["image"], np.uint8))
        row["image"] = {"height": image.shape[0], "width": image.shape[1], "channels": image.shape[2], "data": image.tobytes()}
    return row | {"text": got.get("text")}


def pages_of(doc: int, content: bytes, read: PageReader | RangeReader, dpi: int = RENDER_DPI, first: int = 0, stop: int | None = None) -> Iterator[dict]:
    """Rows of PAGES of one document, or of a range of its pages. A page that fails is a row with its error: a reader that
    yields an exception goes on with the next page; one that raises ends the document, or the range, there. It is closed page
    by page and at the end."""
    page = first
    try:
        for got in read.read(content, dpi, first, stop) if hasattr(read, "count") else read(content, dpi):
            yield _row(doc, page, got)
            page += 1
    except Exception as e:  # a document that fails never fails the run
        yield _row(doc, page, e)


def _made(readers: dict[str, Callable[[], PageReader | RangeReader]]) -> Callable[[str], PageReader | RangeReader]:
    """Gives a kind's reader, made when it is needed first; in a worker."""
    made: dict[str, PageReader | RangeReader] = {}

    def reader(kind: str) -> PageReader | RangeReader:
        if kind not in readers:
            raise LookupError(f"no reader of {kind}")
        if kind not in made:
            made[kind] = readers[kind]()
        return made[kind]

    return reader


def page_ranges(documents: DataFrame, readers: dict[str, Callable[[], PageReader | RangeReader]], most: int = RANGE_PAGES) -> DataFrame:
    """doc_ord, first, stop, ranges: the ranges of pages, of about equal length and `most` at the utmost, of each document
    that can be read in ranges and has more than one; other documents have no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _made(readers)
        for b in batches:
            counts = []
            for kind, content in zip(b.kind, b.content, strict=True):
                try:
                    counts.append(reader(kind).count(bytes(content)))
                except Exception:  # told by the reading itself
                    counts.append(0)
            yield pd.DataFrame({"doc_ord": b.doc_ord, "n": counts})

    counted = documents.select("doc_ord", "kind", "content").mapInPandas(run, "doc_ord bigint, n bigint").withColumn("ranges", F.ceil(F.col("n") / most)).filter("ranges > 1")
    at = lambda k: F.floor(F.col("n") * k / F.col("ranges")).cast("int")
    return counted.select("doc_ord", "n", "ranges", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ranges") - 1)).alias("k")).select("doc_ord", at(F.col("k")).alias("first"), at(F.col("k") + 1).alias("stop"), "ranges")


def read_pages(documents: DataFrame, readers: dict[str, Callable[[], PageReader | RangeReader]], dpi: int = RENDER_DPI, batch: int = 8, most: int = RANGE_PAGES) -> DataFrame:
    """documents (doc_ord, kind, content) as pages (PAGES). readers: for each kind what makes its reader, once a task; a kind
    without one gives a row with an error. An image is a document of one page, a PDF is rendered page by page. Long documents
    are counted first and dealt out by range, each range with the document's bytes; all others are read where they lie."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _made(readers)

        def rows(b: pd.DataFrame) -> Iterator[dict]:
            for doc, kind, content, first, stop in zip(b.doc_ord, b.kind, b.content, b["first"], b["stop"], strict=True):
                content = bytes(content)
                try:
                    read = reader(kind)
                    stop = read.count(content) if stop < 0 and hasattr(read, "count") else stop
                except Exception as e:  # a document that fails never fails the run
                    yield _row(doc, 0, e)
                    continue
                yield from pages_of(doc, content, read, dpi, first, stop)

        for b in batches:
            source = rows(b)
            while some := list(islice(source, batch)):
                yield pd.DataFrame(some)

    ranges = stored(page_ranges(documents, readers, most), "ranges")
    whole = documents.join(ranges.select("doc_ord").distinct(), "doc_ord", "left_anti").select("doc_ord", "kind", "content", F.lit(0).alias("first"), F.lit(-1).alias("stop"))
    n = ranges.count()
    if not n:
        return whole.mapInPandas(run, PAGES)
    # A task for each range: what it reads is long, and the rows that move are few.
    dealt = documents.join(ranges, "doc_ord").select("doc_ord", "kind", "content", "first", "stop").repartitionByRange(min(n, MOST_TASKS), "doc_ord", "first")
    return whole.mapInPandas(run, PAGES).unionByName(dealt.mapInPandas(run, PAGES))


def split_errors(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages that were read, errors by document: doc_ord, error, n)."""
    bad = pages.filter("error is not null").groupBy("doc_ord", "error").agg(F.count(F.lit(1)).alias("n"))
    return pages.filter("error is null").drop("error"), bad
