"""Boxes and polygons. A box is struct(x0, y0, x1, y1), a polygon an array of struct(x, y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_CROP_PIXELS = 10
MAX_PAGE_SIDE = 2048
UPSCALE_BELOW = 1500


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def polygon_bbox(poly: Column) -> Column:
    """Smallest upright box around all vertices."""
    xs, ys = F.transform(poly, lambda p: p["x"]), F.transform(poly, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def parse_polygon(raw: Column) -> Column:
    """A detector's polygon, JSON [[x, y], ...], as struct(poly, error): either the points or why they are none."""
    points = F.from_json(raw, "array<array<double>>")
    bad = F.exists(points, lambda p: p.isNull() | (F.size(p) != 2) | F.exists(p, lambda v: v.isNull()))
    error = F.when(points.isNull(), "no list of points").when(F.size(points) < 3, "fewer than three points").when(bad, "a point without two numbers")
    poly = F.transform(points, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return F.struct(F.when(error.isNull(), poly).alias("poly"), error.alias("error"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0.0 if the union has no area."""
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    union = area(a) + area(b) - w * h
    return F.when(union <= 0, F.lit(0.0)).otherwise(w * h / F.nullif(union, F.lit(0.0)))


def clamped_bbox(b: Column, width: Column, height: Column) -> Column:
    """Whole pixels, rounded outwards and held to the page."""
    hold = lambda v, most: F.greatest(F.lit(0), F.least(v.cast("int"), most))
    return box(hold(F.floor(b["x0"]), width), hold(F.floor(b["y0"]), height), hold(F.ceil(b["x1"]), width), hold(F.ceil(b["y1"]), height))


def rounded(x: Column) -> Column:
    """To the nearest whole number, halves to the even one."""
    return F.rint(x).cast("int")


def rect_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Corners in any order, as a box of whole numbers."""
    a, b, c, d = (rounded(v) for v in (x0, y0, x1, y1))
    return box(F.least(a, c), F.least(b, d), F.greatest(a, c), F.greatest(b, d))


def rect_polygon(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    r = rect_box(x0, y0, x1, y1)
    corner = lambda x, y: F.struct(r[x].cast("double").alias("x"), r[y].cast("double").alias("y"))
    return F.array(corner("x0", "y0"), corner("x1", "y0"), corner("x1", "y1"), corner("x0", "y1"))


def scale_polygon(poly: Column, sx: Column, sy: Column) -> Column:
    return F.transform(poly, lambda p: F.struct((p["x"] * sx).alias("x"), (p["y"] * sy).alias("y")))


def permille_to_px(value: Column, axis: Column) -> Column:
    """Thousandths of an axis as pixels; an axis without length leaves the value."""
    return F.when(axis <= 0, value.cast("double")).otherwise(value / F.lit(1000.0) * axis)


def scaled_side(side: Column, scale: Column) -> Column:
    return F.greatest(F.lit(1), rounded(side * scale))


def page_scale(width: Column, height: Column, longest: int = MAX_PAGE_SIDE) -> Column:
    """Factor that brings the longer side down to `longest`; never above 1."""
    return F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))


def native_scale(width: Column, height: Column, below: int = UPSCALE_BELOW, longest: int = MAX_PAGE_SIDE) -> Column:
    """Up to twofold if both sides are under `below`, as far as the longer side stays within `longest`."""
    up = F.least(F.lit(2.0), F.lit(float(longest)) / F.greatest(width, height))
    return F.when((width >= below) | (height >= below) | (up <= 1.0), F.lit(1.0)).otherwise(up)


def random_pad(*key: Column, seed: int = 0) -> Column:
    """Padding drawn from the key by MD5: 1 to 3 pixels left and right, 0 to 2 above and below."""
    text = F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in key])
    draw = lambda k: (F.conv(F.substring(F.md5(text), 8 * k + 1, 8), 16, 10).cast("long") % 3).cast("int")
    return F.struct((draw(0) + 1).alias("left"), draw(1).alias("top"), (draw(2) + 1).alias("right"), draw(3).alias("bottom"))


def page_to_pixel(x: Column, y: Column, page_w: Column, page_h: Column, rotate: Column, width: Column, height: Column) -> Column:
    """A point of a page (points, from its lower left corner, before the page is turned) as a pixel of the rendered image
    (width x height, after it was turned clockwise by `rotate` degrees): struct(x, y), to the nearest whole number."""
    along, up = x / page_w, y / page_h  # both from 0 to 1
    turn = F.pmod(rotate.cast("int"), F.lit(360))
    dx = F.when(turn == 90, up).when(turn == 180, 1 - along).when(turn == 270, 1 - up).otherwise(along)
    dy = F.when(turn == 90, along).when(turn == 180, up).when(turn == 270, 1 - along).otherwise(1 - up)
    return F.struct(F.round(dx * width).cast("int").alias("x"), F.round(dy * height).cast("int").alias("y"))


def pixel_rect(b: Column, page_w: Column, page_h: Column, rotate: Column, width: Column, height: Column, pad: Column | None = None) -> Column:
    """A box of the page (b: x0, y0, x1, y1 in points, y upwards) as an upright box of pixels, with `pad` (left, top, right,
    bottom) around it as far as the image goes."""
    one, two = (page_to_pixel(b[x], b[y], page_w, page_h, rotate, width, height) for x, y in (("x0", "y0"), ("x1", "y1")))
    more = (lambda side: pad[side]) if pad is not None else (lambda side: F.lit(0))
    return box(
        F.greatest(F.lit(0), F.least(one["x"], two["x"]) - more("left")), F.greatest(F.lit(0), F.least(one["y"], two["y"]) - more("top")),
        F.least(width.cast("int"), F.greatest(one["x"], two["x"]) + more("right")), F.least(height.cast("int"), F.greatest(one["y"], two["y"]) + more("bottom")),
    )


def big_enough(w: Column, h: Column) -> Column:
    return (w > MIN_CROP_PIXELS) & (h > MIN_CROP_PIXELS)


def rotated_size(w: Column, h: Column) -> Column:
    return F.struct(h.alias("w"), w.alias("h"))
