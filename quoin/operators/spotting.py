"""Parsers of page-spotting answers: raw text to boxes and lines, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoin.functions.geometry import permille_to_px, rect_box
from quoin.functions.text import region_lines, strip

# The answer grammars of the two native engines.
TEXT_BLOCK = r"(?s)<\|TEXT_START\|>(.*?)<\|TEXT_END\|>"
LOC_BLOCK = r"(?s)<\|LOC_BEGIN\|>(.*?)<\|LOC_END\|>"
LOC = r"<\|LOC_([0-9]+)\|>"
MARKS = r"<\|(?:TEXT_START|TEXT_END|LOC_BEGIN|LOC_END)\|>"
SPOT = r"([^\n]+?)\s*\(\s*([0-9]+)\s*,\s*([0-9]+)\s*\)\s*,\s*\(\s*([0-9]+)\s*,\s*([0-9]+)\s*\)"
NATIVE = {"paddleocr_vl", "hunyuan_ocr"}
LAYOUT = {"glm_ocr", "dots_ocr", "unlimited_ocr"}


def _all(text: Column, pattern: str, k: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(k))


def _line(text: Column, values: Column, width: Column, height: Column) -> Column:
    """Line from eight alternating x and y in thousandths."""
    xs = F.transform(F.filter(values, lambda v, i: i % 2 == 0), lambda v: permille_to_px(v, width))
    ys = F.transform(F.filter(values, lambda v, i: i % 2 == 1), lambda v: permille_to_px(v, height))
    return F.struct(strip(text).alias("text"), rect_box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)).alias("box"))


def parse_paddle(raw: Column, width: Column, height: Column) -> Column:
    """array of (text, box). Text and location blocks meet by position, up to the shorter list; a block of under eight
    numbers falls away. If none is left, each eight locations close the text before them."""
    raw = F.coalesce(raw, F.lit(""))
    n = F.least(F.size(_all(raw, TEXT_BLOCK)), F.size(_all(raw, LOC_BLOCK)))
    numbers = lambda s: F.transform(_all(s, LOC), lambda v: v.try_cast("double"))
    pairs = F.zip_with(F.slice(_all(raw, TEXT_BLOCK), F.lit(1), n), F.slice(_all(raw, LOC_BLOCK), F.lit(1), n), lambda t, b: F.struct(t.alias("t"), F.slice(numbers(b), 1, 8).alias("v")))
    pairs = F.filter(pairs, lambda p: F.size(p["v"]) == 8)
    # Eight locations with whatever stands between them; the text is what stands before the first.
    part = r"(?s)(.*?)(<\|LOC_[0-9]+\|>(?:.*?<\|LOC_[0-9]+\|>){7})"
    plain = F.zip_with(_all(raw, part, 1), _all(raw, part, 2), lambda t, b: F.struct(F.regexp_replace(t, MARKS, "").alias("t"), numbers(b).alias("v")))
    lines = F.transform(F.when(F.size(pairs) > 0, pairs).otherwise(plain), lambda p: _line(p["t"], p["v"], width, height))
    return F.filter(lines, lambda x: x["text"] != "")


def parse_hunyuan(raw: Column, width: Column, height: Column) -> Column:
    """array of (text, box) from `text(x1,y1),(x2,y2)`."""
    raw = F.coalesce(raw, F.lit(""))
    found = F.arrays_zip(*[_all(raw, SPOT, k).alias(f"f{k}") for k in range(1, 6)])
    px = lambda v, axis: permille_to_px(v.try_cast("double"), axis)
    lines = F.transform(found, lambda m: F.struct(
        strip(m["f1"]).alias("text"), rect_box(px(m["f2"], width), px(m["f3"], height), px(m["f4"], width), px(m["f5"], height)).alias("box")))
    return F.filter(lines, lambda x: x["text"] != "")


def parse(engine: Column, raw: Column, width: Column, height: Column) -> Column:
    """By engine: boxed lines of the native engines, lines without box of the layout engines, none of others."""
    kind = "array<struct<text:string,box:struct<x0:int,y0:int,x1:int,y1:int>>>"
    bare = F.transform(region_lines(raw), lambda t: F.struct(t.alias("text"), F.lit(None).cast("struct<x0:int,y0:int,x1:int,y1:int>").alias("box")))
    return (
        F.when(engine == "paddleocr_vl", parse_paddle(raw, width, height).cast(kind)).when(engine == "hunyuan_ocr", parse_hunyuan(raw, width, height).cast(kind))
        .when(engine.isin(*LAYOUT), bare.cast(kind)).otherwise(F.array().cast(kind))
    )
