"""Scalar functions against expected values."""

import html

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.functions import geometry as geo
from quoin.functions import text as tx
from quoin.functions import years
from quoin.functions.quality import word_ok


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def over(spark, values, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.r for r in df.select("k", f(F.col("v")).alias("r")).orderBy("k").collect()]


def test_labels(spark):
    assert over(spark, ["„Нормы” – “x” ‘y’ don’t", "«a» — \"b\" 'c'", None], tx.normalize_label) == ["\"Нормы\" — \"x\" 'y' don't", "«a» — \"b\" 'c'", None]
    strange = over(spark, ["а£б£ ©", "", "абв"], lambda c: tx.out_of_alphabet(c, list("абв")))
    assert strange == [["£", "©"], [], []]
    assert over(spark, ["стан\x02дар", "a­b￾c"], tx.restore_hyphens) == ["стан-дар", "a-b-c"]


@pytest.mark.parametrize(
    ("bucket", "text", "normalize", "alphabet", "want"),
    [
        ("good", "„a”", True, list('a"'), ("good", '"a"')), ("good", "„a”", False, list('a"'), ("needs_review", "„a”")), ("good", "b", True, None, ("good", "b")),
        ("needs_review", "a", True, list("a"), ("needs_review", "a")), ("good", "a b", True, list("a"), ("needs_review", "a b")),
    ],
)
def test_finalize(spark, bucket, text, normalize, alphabet, want):
    assert one(spark, *tx.finalize(F.lit(bucket), F.lit(text), normalize, alphabet)) == want


def test_postprocess(spark):
    cases = {
        "a  \\times   b": "a × b", "```markdown\nодин\nдва\n```": "один\nдва", "\\piecewise \\pi": "\\piecewise π", None: "", "  \t": "", "```": "", "\\rightarrow\\Rightarrow x": "→⇒ x", "\\deg3": "°3",
    }
    assert over(spark, list(cases), tx.postprocess) == list(cases.values())
    assert over(spark, ["```\n один \n\n два\n```", "x y\r\nz", None], tx.region_lines) == [["один", "два"], ["x", "y", "z"], []]


def test_html_and_names(spark):
    assert over(spark, ["<p>a&nbsp;&amp;lt; <b>b</b>\n c</p>", None, "&quot;x&#39;"], tx.strip_html) == ["a &lt; b c", "", "\"x'"]
    name = lambda c: tx.safe_filename(c, F.lit("0123456789"), F.lit(".jpg"))
    got = over(spark, ['File:Письмо: "1905" / лист*1.jpeg', "File:...jpg", "plain", "File:" + "x" * 200 + ".png"], name)
    assert got == ["01234567_Письмо___1905____лист_1.jpg", "01234567_file.jpg", "01234567_plain.jpg", "01234567_" + "x" * 100 + ".jpg"]
    assert over(spark, ["  a_b ", "Category:c_d"], tx.category_title) == ["Category:a b", "Category:c d"]


def test_character_references_are_those_of_html(spark):
    cases = [
        "a &amp; b", "&#1055;&#x41;&laquo;x&raquo;&mdash;", "&copy no semi &ampx &notit; &notin; &unknown; &", "&#0;&#13;&#128;&#129;&#150;&#55296;&#99999999999;&#xFFFFFFFFFFF;&#x110000;&#1;&#xFFFE;&#011;",
        "&#x41 &#65x &#X1F600;", "plain", None, "&amp;amp; &;&#; &#x;", "&CounterClockwiseContourIntegral; &fjlig; &frac12x &Oacutex &lt&gt", "&" * 40, "",
    ]
    assert over(spark, cases, tx.unescape) == [None if c is None else html.unescape(c) for c in cases]


def test_points_as_pixels_on_turned_pages(spark):
    """A page of 400 x 200 points with ink at its lower left, rendered with two pixels a point and turned."""
    ink = np.zeros((200, 400), bool)
    ink[170:180, 20:60] = True  # rows from above: 20 to 30 points above the lower edge
    for turn in (0, 90, 180, 270, 450):
        image = np.kron(np.rot90(ink, -turn // 90), np.ones((2, 2), bool))
        ys, xs = image.nonzero()
        b = geo.box(F.lit(20.0), F.lit(20.0), F.lit(60.0), F.lit(30.0))
        rect = lambda pad=None: one(spark, geo.pixel_rect(b, F.lit(400.0), F.lit(200.0), F.lit(turn), F.lit(image.shape[1]), F.lit(image.shape[0]), pad))  # noqa: B023, E731
        (got,) = rect()
        assert tuple(got) == (xs.min(), ys.min(), xs.max() + 1, ys.max() + 1)
        pad = F.struct(*[F.lit(n).alias(k) for k, n in (("left", 3), ("top", 1000), ("right", 1000), ("bottom", 2))])
        (got,) = rect(pad)
        assert tuple(got) == (max(0, xs.min() - 3), 0, image.shape[1], min(image.shape[0], ys.max() + 3))


def test_size_suffix(spark):
    got = over(spark, ["текст 12\t120\t32", "2024", "a\nb\t1\t2", "a\t1", "\t3\t4"], tx.split_crop_size)
    assert [tuple(r) for r in got] == [("текст 12", 120, 32), ("2024", None, None), ("a\nb", 1, 2), ("a\t1", None, None), ("", 3, 4)]
    line = lambda w, h: one(spark, tx.format_line(F.lit("p"), F.lit("t"), F.lit(w).cast("int"), F.lit(h).cast("int")))[0]
    assert (line(120, 32), line(None, None)) == ("p\tt\t120\t32", "p\tt")
    assert over(spark, ["crops/0/a.webp\tx", "b.png"], tx.image_name) == ["a.webp", "b.png"]
    assert over(spark, [" a\nb\r "], tx.clean_edit) == ["a b"]


def test_years(spark):
    year = lambda *f: one(spark, years.guess_year(*[F.lit(x).cast("string") for x in f]))[0]
    assert year("2017-02-08", "letter of 1795", None) == 1795 and year(None, "12345 and 19145", "") is None and year("1914", None, "0999") == 1914
    doc = lambda date, name: one(spark, years.document_year(F.lit(date).cast("string"), F.lit(name).cast("string")))[0]
    assert [doc("01.07.1999", "РТМ 3-72-70"), doc("", "РТМ 3-72-70"), doc(None, "ГОСТ 1-02"), doc("", "РД 5"), doc("", "X-1987 "), doc("", "X–25"), doc("", "X-26")] == [1999, 1970, 2002, None, 1987, 2025, 1926]


def rect(x0, y0, x1, y1):
    return geo.box(*[F.lit(float(v)) for v in (x0, y0, x1, y1)])


def test_geometry(spark):
    iou = lambda a, b: one(spark, geo.iou(rect(*a), rect(*b)))[0]
    assert iou((0, 0, 10, 10), (0, 0, 10, 10)) == 1.0 and iou((0, 0, 10, 10), (100, 100, 110, 110)) == 0.0
    assert iou((0, 0, 10, 10), (5, 0, 15, 10)) == pytest.approx(1 / 3) and iou((0, 0, 0, 0), (0, 0, 0, 0)) == 0.0
    quad = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(10, 5), (100, 0), (95, 30), (5, 35)]])
    assert tuple(one(spark, geo.polygon_bbox(quad))[0]) == (5, 0, 100, 35)
    assert tuple(one(spark, geo.clamped_bbox(rect(-5, -3, 150, 40), F.lit(100), F.lit(60)))[0]) == (0, 0, 100, 40)
    assert tuple(one(spark, geo.clamped_bbox(rect(1.9, 2.1, 9.2, 7.5), F.lit(100), F.lit(100)))[0]) == (1, 2, 10, 8)
    assert tuple(one(spark, geo.rect_box(F.lit(10.5), F.lit(3.5), F.lit(2.5), F.lit(0.4)))[0]) == (2, 0, 10, 4)
    assert one(spark, geo.permille_to_px(F.lit(450), F.lit(1000)), geo.permille_to_px(F.lit(450), F.lit(0))) == (450.0, 450.0)
    assert one(spark, geo.native_scale(F.lit(800), F.lit(1400)), geo.native_scale(F.lit(1500), F.lit(10)), geo.page_scale(F.lit(4096), F.lit(10))) == (2048 / 1400, 1.0, 0.5)


def test_words(spark):
    good = ["Изменение", "сталь-3", "т.п.", "кгс/см2", "мм", "СССР", "1.2.3", "ISO", "", "«да»", "VII"]
    bad = ["BATCH", "19В6", "oma", "втрвк", "x", "a1b", "rfP"]
    check = lambda w, cyr=True: over(spark, w, lambda c: word_ok(c, F.lit(cyr)))
    assert check(["Изменение", "т.п.", "кгс/см2", "мм", "СССР", "1.2.3", "ISO", "", "«да»"]) == [True] * 9
    assert check(bad) == [False] * len(bad) and check(["copy"]) == [False] and check(["copy", "don't"], False) == [True, True]
    assert len(good) == 11
