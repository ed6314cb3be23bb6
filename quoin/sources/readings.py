"""Readings from outside: the contract of recognisers, and tables that detectors and text layers give.

A reading source is any callable (DataFrame of crops) -> DataFrame of readings, run with Arrow batches; model weights are
its own affair. A failed call gives ('', 0.0) for each of its crops, and so does an answer of the wrong length.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions.geometry import big_enough, clamped_bbox, parse_polygon, polygon_bbox
from quoin.functions.text import restore_hyphens, strip

#: Kinds of failure with a reason of their own.
REASONS = {"timeout": "the model did not answer in time", "connect": "no connection to the model", "format": "unexpected form of the answer"}
# Font flags, and what bold and italic fonts are called.
FORCE_BOLD, ITALIC = 1 << 18, 1 << 6
BOLD_NAME, ITALIC_NAME = "(?i)bold|black|heavy|semibold|demi", "(?i)italic|oblique"


class ReadingSource(Protocol):
    """engine, engine_ord, and read(crops) -> readings (crops' key columns, engine_ord, engine, text, score)."""

    engine: str
    engine_ord: int

    def read(self, crops: DataFrame) -> DataFrame: ...


class BatchSource:
    """A reading source from a function over a list of images -> [(text, score)]; `load` makes it once a task."""

    def __init__(self, engine: str, engine_ord: int, load: Callable[[], Callable[[list], list[tuple[str, float]]]], image: str = "image", batch: int = 16):
        self.engine, self.engine_ord, self.load, self.image, self.batch = engine, engine_ord, load, image, batch

    def read(self, crops: DataFrame) -> DataFrame:
        rest = [c for c in crops.columns if c != self.image]
        load, image, size, engine, ordinal = self.load, self.image, self.batch, self.engine, self.engine_ord

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            recognise = load()
            for b in batches:
                out = []
                for i in range(0, len(b), size):
                    part = b[image].iloc[i : i + size].tolist()
                    try:
                        got = list(recognise(part))
                    except Exception:  # an engine that fails never fails the run
                        got = []
                    out += got if len(got) == len(part) else [("", 0.0)] * len(part)
                yield b[rest].assign(engine_ord=ordinal, engine=engine, text=[t for t, _ in out], score=[float(s) for _, s in out])

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in crops.select(*rest).schema.fields)
        return crops.mapInPandas(run, f"{kinds}, engine_ord int, engine string, text string, score double")


class BoxSource:
    """A line detector from a function over one page image -> polygons [[x, y], ...]; `load` makes it once a task. A page on
    which it fails has no boxes."""

    def __init__(self, engine: str, load: Callable[[], Callable[[dict], list]], image: str = "image"):
        self.engine, self.load, self.image = engine, load, image

    def detect(self, pages: DataFrame) -> DataFrame:
        """pages' other columns with line_no (in the detector's order) and polygon (JSON)."""
        rest = [c for c in pages.columns if c != self.image]
        load, image = self.load, self.image

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            find = load()
            for b in batches:
                at, numbers, polygons = [], [], []
                for k, im in enumerate(b[image]):
                    try:
                        found = [json.dumps(np.asarray(p, float).tolist()) for p in find(im)]
                    except Exception:  # a detector that fails never fails the run
                        found = []
                    at += [k] * len(found)
                    numbers += range(len(found))
                    polygons += found
                yield b[rest].iloc[at].reset_index(drop=True).assign(line_no=numbers, polygon=pd.Series(polygons, dtype=object))

        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*rest).schema.fields)
        return pages.mapInPandas(run, f"{kinds}, line_no int, polygon string")


def detected_boxes(found: DataFrame, width: Column, height: Column, polygon: str = "polygon") -> tuple[DataFrame, DataFrame]:
    """(lines with box: whole pixels around the polygon, held to the page, those of more than 10 pixels a side; errors: the
    other columns and error of each polygon that is none)."""
    rest = [F.col(c) for c in found.columns if c != polygon]
    rows = found.select(*rest, parse_polygon(F.col(polygon)).alias("_p"))
    good = rows.filter("_p.error is null").select(*rest, clamped_bbox(polygon_bbox(F.col("_p.poly")), width, height).alias("box"))
    good = good.filter(big_enough(F.col("box.x1") - F.col("box.x0"), F.col("box.y1") - F.col("box.y0")))
    return good, rows.filter("_p.error is not null").select(*rest, F.col("_p.error").alias("error"))


def word_lines(words: DataFrame, page: list[str]) -> DataFrame:
    """Line boxes from a word table (page.., i, block, par, line, text, conf, left, top, width, height): words without
    confidence or text don't count; ord is the place of the line's first word."""
    rows = words.filter((F.col("conf") != -1) & (strip(F.col("text")) != ""))
    return rows.groupBy(*page, "block", "par", "line").agg(
        F.min("i").alias("ord"), F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1")
    )


def word_reading(words: DataFrame, line: list[str], lines: DataFrame | None = None) -> DataFrame:
    """line.., text, score: a line's words joined, and their mean confidence over 100; ('', 0.0) without words."""
    rows = words.filter((F.col("conf") != -1) & (strip(F.col("text")) != ""))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda w: w["text"]), " ")
    out = rows.groupBy(*line).agg(text.alias("text"), (F.avg("conf") / 100.0).alias("score"))
    if lines is None:
        return out
    return lines.select(*line).join(out, line, "left").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("score", F.coalesce("score", F.lit(0.0)))


def font_style(name: Column, size: Column, weight: Column, flags: Column) -> Column:
    """struct(font_name, font_size, bold, italic): the subset prefix goes; name, weight or flag make a font bold."""
    bare = F.regexp_replace(name, r"^[A-Z]{6}\+", "")
    bold = bare.rlike(BOLD_NAME) | (weight >= 600) | (flags.bitwiseAND(F.lit(FORCE_BOLD)) != 0)
    italic = bare.rlike(ITALIC_NAME) | (flags.bitwiseAND(F.lit(ITALIC)) != 0)
    return F.struct(bare.alias("font_name"), F.round(size, 2).alias("font_size"), bold.alias("bold"), italic.alias("italic"))


def text_layer_lines(chars: DataFrame, page: list[str]) -> DataFrame:
    """Lines of a text layer from its characters (page.., obj, i, ch, x0, y0, x1, y1[, style]): page.., ord, text and the
    box around the ink; objects without ink fall away. ord is the first character's place; the style is that of the first
    inked character."""
    ink = strip(F.col("ch")) != ""
    side = lambda f, c: f(F.when(ink, F.col(c))).alias(c)
    style = [F.min_by(F.when(ink, F.col("style")), F.when(ink, F.col("i"))).alias("style")] if "style" in chars.columns else []
    letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "ch"))), lambda c: c["ch"]), "")
    out = chars.groupBy(*page, "obj").agg(F.min("i").alias("ord"), strip(restore_hyphens(letters)).alias("text"), side(F.min, "x0"), side(F.min, "y0"), side(F.max, "x1"), side(F.max, "y1"), *style)
    return out.filter("text <> ''")


def page_words(pages: DataFrame, text: str = "text") -> DataFrame:
    """pages' other columns with pos and word."""
    rest = [c for c in pages.columns if c != text]
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return pages.select(*rest, F.posexplode(words).alias("pos", "word"))


def error_reason(kind: Column, status: Column) -> Column:
    """Short reason of a failed model call, without the address of the service; an unknown kind is its own reason."""
    named = F.element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), kind)
    return F.when(kind == "status", F.concat(F.lit("HTTP "), status.cast("string"))).otherwise(F.coalesce(named, kind))


class CallFailed(Exception):
    """A call that came back with a status other than success."""

    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def failure_of(error: Exception) -> tuple[str, int | None]:
    """(kind, status) of what a call raised, for error_reason."""
    if isinstance(error, CallFailed):
        return "status", error.status
    for kind, classes in (("timeout", TimeoutError), ("connect", ConnectionError), ("format", (LookupError, TypeError, ValueError))):
        if isinstance(error, classes):
            return kind, None
    return type(error).__name__, None


def answer(call: Callable[[], str], tries: int = 2) -> tuple[str, str | None, int | None]:
    """(text, kind, status) of one model call, never an exception: without connection, or if the service is at fault (status
    500 and above), it is made once more; whatever else fails gives an empty text at once."""
    kind, status = None, None
    for _ in range(tries):
        try:
            return call() or "", None, None
        except Exception as e:  # a call that fails never fails the run
            kind, status = failure_of(e)
        if not (kind == "connect" or kind == "status" and status >= 500):
            break
    return "", kind, status
