"""Sources, sinks, streaming, pixels, requests and whole runs."""

import hashlib
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.operators import labeling, pixels, progress
from quoin.operators.vote import vote
from quoin.plans import jobs
from quoin.plans.request import RequestError, RunRequest
from quoin.plans.run import Plan, plan_consensus, plan_vlm
from quoin.sinks import append_found, save_crops, write_buckets, write_debug, write_degraded, write_preview, write_records, write_status
from quoin.sources import catalog, files, pages, readings
from quoin.streaming import progress as live


def texts(path):
    return [line for p in sorted(path.rglob("part-*")) if p.suffix != ".crc" for line in p.read_text().splitlines()]


def test_inputs(spark, tmp_path):
    folder = tmp_path / "in [x] {1}"
    (folder / "sub.png").mkdir(parents=True)
    for n in ("b.JPG", "a.png", "c.TIF", "d.Pdf", "notes.txt"):
        (folder / n).write_bytes(b"%PDF-1" if n == "d.Pdf" else b"x")
    got = files.list_inputs(spark, str(folder)).orderBy("doc_ord").collect()
    assert [(r.path.rpartition("/")[2], r.kind, r.doc_ord) for r in got] == [("a.png", "image", 1), ("b.JPG", "image", 2), ("c.TIF", "image", 3), ("d.Pdf", "pdf", 4)]
    assert [r.path[-5:] for r in files.read_documents(spark, str(folder)).filter(files.is_pdf(F.col("content"))).collect()] == ["d.Pdf"]


def test_alphabet(spark, tmp_path, monkeypatch):
    (tmp_path / "ok").write_text("а\nб\r\n—\n\n")
    assert files.read_alphabet(spark, str(tmp_path / "ok")) == sorted("аб— ")
    for k, bad in enumerate(["", "\n\n", "аб\nв"]):
        (tmp_path / f"bad{k}").write_text(bad)
        with pytest.raises(ValueError):
            files.read_alphabet(spark, str(tmp_path / f"bad{k}"))
    monkeypatch.setattr(files, "MAX_CHARACTERS", 3)
    assert len(files.read_alphabet(spark, str(tmp_path / "ok"))) == 4
    monkeypatch.setattr(files, "MAX_CHARACTERS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        files.read_alphabet(spark, str(tmp_path / "ok"))


def test_debug_stops_at_the_first_bad_line(spark, tmp_path):
    (tmp_path / "debug").write_text('{"crop": "a", "diverged": true, "engines": {"paddle": {"text": "x", "score": 0.5}}}\n\n{"bucket": "good"}\nnot json\n{"crop": "b"}\n')
    rows = files.parse_debug(files.numbered_lines(spark, str(tmp_path / "debug"))).collect()
    assert [(r.crop, r.diverged, r.engines["paddle"].score) for r in rows] == [("a", True, 0.5)]
    (tmp_path / "status").write_text(" b.webp\n\na.webp\nb.webp\n")
    assert sorted(r.name for r in files.parse_status(files.numbered_lines(spark, str(tmp_path / "status"))).collect()) == ["a.webp", "b.webp"]
    (tmp_path / "seen").write_text('{"id": "1", "sha256": "x"}\n{"id": "2"}\n')
    assert sorted((r.id, r.sha256) for r in files.parse_seen(files.numbered_lines(spark, str(tmp_path / "seen")), "id", "sha256").collect()) == [("1", "x"), ("2", None)]


def test_decode(spark):
    df = spark.createDataFrame([(0, bytearray("Привет".encode())), (1, bytearray("Привет".encode("cp1251"))), (2, None)], "k int, raw binary")
    assert [r.t for r in df.select("k", files.decode_html(F.col("raw")).alias("t")).orderBy("k").collect()] == ["Привет", "Привет", None]


def test_query_decodes_whole_pages_in_the_code_page(spark, tmp_path, monkeypatch):
    from quoin.plans.queries import QUERIES

    seen = lambda raw: F.concat(decode(raw), F.when(F.length(raw) > 6, "!").otherwise(""))
    html = ["<p>И</p>", "<p>é \u0418\u0098</p>", "", "x"]
    spark.createDataFrame(list(enumerate(html)), "page_id bigint, html string").write.parquet(str(tmp_path / "pages.parquet"))
    digests = lambda: [r.digest for r in QUERIES["html_decode"](spark, str(tmp_path)).orderBy("page_id").collect()]
    assert digests() == [hashlib.md5(h.encode()).hexdigest() for h in html]
    decode = files.decode_html
    monkeypatch.setattr(files, "decode_html", seen)
    assert digests()[1] == hashlib.md5(html[1].encode() + b"!").hexdigest()  # what the operator gives is what counts


def test_catalog(spark):
    row = "<tr class='m3'><td>1</td><td>T &amp; <b>u</b></td><td>01.02.1970</td><td> in\n force </td><td><a href='https://x.y/Data2/3/77.pdf' class='z' title='РД 1-70 '>p</a></td></tr>"
    html = f"<a href='/list2/5-0.htm' x>ГОСТ &lt;1&gt; </a>{row}<tr class='m3'><td>no pdf</td></tr>"
    page = spark.createDataFrame([(html,)], "html string")
    (got,) = catalog.parse_catalog(page).collect()
    assert (got.id, got.designation, got.title, got.date, got.status, got.pdf_url) == ("77", "РД 1-70", "T & u", "01.02.1970", "in force", "https://x.y/Data2/3/77.pdf")
    assert [tuple(r) for r in catalog.parse_groups(page).collect()] == [("ГОСТ <1>", "5")]


def test_batch_source(spark):
    crops = spark.createDataFrame([(i, f"im{i}") for i in range(40)], "line int, image string").repartition(1)

    def load():
        def recognise(images):
            if "im3" in images:
                raise RuntimeError("broken")
            return [(i.upper(), 0.5) for i in images] if "im20" not in images else [("x", 1.0)]

        return recognise

    source = readings.BatchSource("paddle", 0, load)
    got = source.read(crops.orderBy("line").coalesce(1)).collect()
    assert len(got) == 40 and {r.engine for r in got} == {"paddle"}
    assert sum(r.text == "" and r.score == 0.0 for r in got) == 32 and {r.text for r in got if r.text} == {f"IM{i}" for i in range(32, 40)}


def test_text_layer(spark):
    chars = [("p", 1, i, c, float(i), 0.0, float(i + 1), 5.0) for i, c in enumerate(" ab\xadc ")] + [("p", 2, 9, " ", 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(chars, "page string, obj int, i int, ch string, x0 double, y0 double, x1 double, y1 double")
    (line,) = readings.text_layer_lines(df, ["page"]).collect()
    assert (line.ord, line.text, line.x0, line.x1) == (0, "ab-c", 1.0, 5.0)
    words = spark.createDataFrame([(0, 1, 1, 1, "б", 90.0, 5, 5, 10, 4), (1, 1, 1, 1, "в", 80.0, 20, 4, 5, 5), (2, 1, 1, 1, " ", 99.0, 0, 0, 1, 1), (3, 1, 1, 2, "x", -1.0, 0, 0, 1, 1)], "i int, block int, par int, line int, text string, conf double, left int, top int, width int, height int")
    (box,) = readings.word_lines(words, []).collect()
    assert (box.x0, box.y0, box.x1, box.y1) == (5, 4, 25, 9)
    got = {r.line: (r.text, r.score) for r in readings.word_reading(words, ["line"], words.select("line").distinct()).collect()}
    assert got == {1: ("б в", pytest.approx(0.85)), 2: ("", 0.0)}
    style = spark.range(1).select(readings.font_style(F.lit("ABCDEF+Liberation-BoldOblique"), F.lit(9.999), F.lit(400), F.lit(0))).first()[0]
    assert tuple(style) == ("Liberation-BoldOblique", 10.0, True, True)


def test_sinks(spark, tmp_path):
    rows = [(3, "crops/0/c.webp", "good", "x\ty", "paddle", False, 7, 8), (1, "crops/0/a.webp", "good", "т", "surya", True, 120, 32), (2, "crops/0/b.webp", "needs_review", "", "", False, 1, 2)]
    lines = spark.createDataFrame(rows, "n long, crop string, bucket string, text string, engine string, diverged boolean, w int, h int")
    for _ in range(2):
        write_buckets(lines, str(tmp_path / "out"), with_size=True)
    assert texts(tmp_path / "out/bucket=good") == ["crops/0/a.webp\tт\t120\t32", "crops/0/c.webp\tx\ty\t7\t8"] and texts(tmp_path / "out/bucket=needs_review") == ["crops/0/b.webp\t\t1\t2"]
    reads = spark.createDataFrame([(1, 0, "paddle", "a", 0.5), (1, 1, "surya", "", 0.0)], "n long, engine_ord int, engine string, text string, score double")
    write_debug(vote(reads, ["n"], 0.5, with_readings=True).withColumn("crop", F.lit("p")), str(tmp_path / "debug"))
    assert json.loads(texts(tmp_path / "debug")[0]) == {"crop": "p", "bucket": "needs_review", "engine": "paddle", "diverged": False, "engines": {"paddle": {"text": "a", "score": 0.5}, "surya": {"text": "", "score": 0.0}}}
    marks = spark.createDataFrame([(1, "a", "s", True, True), (2, "b", "s", None, True), (3, "c", "s", None, False)], "n long, crop string, source string, degraded boolean, page_degraded boolean")
    write_degraded(marks, str(tmp_path / "degrade"))
    assert [json.loads(x)["degraded"] for x in texts(tmp_path / "degrade")] == [True, None]
    recs, _ = labeling.records(labeling.parse_lines(spark.createDataFrame([(0, "c/z.webp\tt\t1\t2"), (1, "c/a.webp\tu")], "ord int, value string")))
    write_records(recs, str(tmp_path / "recs"))
    write_status(recs.withColumn("is_marked", F.lit(True)), str(tmp_path / "marks"))
    assert texts(tmp_path / "recs") == ["c/z.webp\tt\t1\t2", "c/a.webp\tu"] and texts(tmp_path / "marks") == ["a.webp", "z.webp"]


def test_crops(spark, tmp_path):
    page = np.arange(6 * 8, dtype=np.uint8).reshape(6, 8, 1)
    df = spark.createDataFrame([("a", (6, 8, 1, bytearray(page.tobytes())), (1, 2, 4, 5)), ("b", (6, 8, 1, bytearray(page.tobytes())), (0, 0, 8, 6))], f"crop_name string, page {pixels.IMAGE}, box struct<x0:int,y0:int,x1:int,y1:int>")
    out = {r.crop_name: r.crop for r in pixels.cut(df, "page", "box").collect()}
    assert bytes(out["a"].data) == page[2:5, 1:4].tobytes() and (out["b"].height, out["b"].width) == (6, 8)
    target = str(tmp_path)

    def put(path, image):
        if path == "b":
            raise OSError("disk")
        with open(f"{target}/{path}", "wb") as f:
            f.write(image["data"])

    bad = save_crops(pixels.cut(df, "page", "box"), put, "crop", "crop_name").collect()
    assert [tuple(r) for r in bad] == [("b", "disk")] and (tmp_path / "a").read_bytes() == page[2:5, 1:4].tobytes()


def stripes(ink=20, paper=230):
    image = np.full((40, 300, 1), paper, np.uint8)
    image[10:30, ::9] = image[10:30, 1::9] = image[10:30, 2::9] = ink
    return image.astype(np.float64)


def test_legible():
    clean = stripes()
    assert pixels.legible(clean, clean * 0.9 + 10) and pixels.legible(255 - clean, 250 - clean * 0.9)
    assert not pixels.legible(clean, np.full_like(clean, 230.0)) and not pixels.legible(clean, clean * 0.05 + 200)
    stain, lost = clean.copy(), clean.copy()
    stain[:, 100:130], lost[:, 100:130] = 20, 230
    assert not pixels.legible(clean, stain) and not pixels.legible(clean, lost)
    dot = np.full((20, 20, 1), 255.0)
    dot[5, 5] = 0
    assert pixels.legible(dot, dot - 30) and not pixels.legible(dot, dot - 80)
    assert pixels.legible(stripes(200, 230), stripes(205, 228), 25.0)  # pale text needs half of its own contrast
    rgb = np.repeat(clean, 3, axis=2)
    assert pixels.legible(rgb, rgb + 7) and not pixels.legible(rgb, np.repeat(stain, 3, axis=2)) and not pixels.legible(rgb, rgb * 0.05 + 200)


def test_legible_stack_judges_each_crop_by_itself():
    rng = np.random.default_rng(3)
    clean = np.stack([stripes(int(rng.integers(0, 120)), int(rng.integers(130, 256))) for _ in range(40)]).astype(np.uint8)
    noisy = clean.astype(int) + rng.integers(-60, 60, clean.shape) * (np.arange(40) % 3 == 0)[:, None, None, None]
    noisy[::5, :, 60:90] = 128
    noisy = np.clip(noisy, 0, 255).astype(np.uint8)
    one_by_one = [pixels.legible(a, b) for a, b in zip(clean, noisy, strict=True)]
    assert pixels.legible_stack(clean, noisy).tolist() == one_by_one and 0 < sum(one_by_one) < 40
    level = rng.integers(0, 256, (6, 31))
    mask = rng.random((6, 31)) < 0.4
    assert pixels._medians(level, mask, 255).tolist() == [float(np.median(level[i][mask[i]])) for i in range(6)]


def test_failed_and_cancelled_jobs(spark, tmp_path):
    broken = spark.range(1).select(F.raise_error(F.lit("no disk")).cast("string").alias("crop"), F.lit(1).alias("n"), F.lit("good").alias("bucket"), F.lit("t").alias("text"), F.lit(1).alias("w"), F.lit(1).alias("h"))
    with pytest.raises(Exception, match="no disk"):
        jobs.run(spark, Plan(RunRequest(output_dir=str(tmp_path)), broken), "job-2")
    row = jobs.status(spark, str(tmp_path)).first()
    assert row.status == "error" and "no disk" in row.error
    with pytest.raises(RuntimeError, match="does not run"):
        jobs.cancel(spark, "job-2")
    with pytest.raises(KeyError):
        jobs.cancel(spark, "no such job")


def test_choice_and_sampling(spark):
    image = lambda a: (a.shape[0], a.shape[1], 1, bytearray(a.astype(np.uint8).tobytes()))
    clean = stripes()
    df = spark.createDataFrame([(0, image(clean), image(clean)), (1, image(clean), image(clean * 0.9 + 10)), (2, image(clean), image(clean * 0 + 230))], f"k int, a {pixels.IMAGE}, b {pixels.IMAGE}")
    assert [r.c for r in df.select("k", pixels.choose_crop()(F.col("a"), F.col("b")).alias("c")).orderBy("k").collect()] == [None, True, False]
    drawn = spark.range(20_000).filter(pixels.degraded_share(0.3, 5, F.col("id"))).count()
    assert abs(drawn / 20_000 - 0.3) < 0.02 and spark.range(100).filter(pixels.degraded_share(0, 5, F.col("id"))).count() == 0


def test_crops_of_many_shapes(spark, monkeypatch):
    monkeypatch.setattr(pixels, "STACK_PIXELS", 1)
    image = lambda a: None if a is None else (a.shape[0], a.shape[1], a.shape[2], bytearray(a.astype(np.uint8).tobytes()))
    a, b = stripes(), np.repeat(stripes()[:30], 3, axis=2)
    rows = [(a, a + 9, True), (b, b + 9, True), (a, a * 0 + 230, False), (b, b, None), (a, None, None), (a, a[:, :200], False), (None, a, None), (b, a, False)]
    df = spark.createDataFrame([(k, image(x), image(y)) for k, (x, y, _) in enumerate(rows)], f"k int, a {pixels.IMAGE}, b {pixels.IMAGE}")
    got = df.select("k", pixels.choose_crop()(F.col("a"), F.col("b")).alias("c")).orderBy("k").collect()
    assert [r.c for r in got] == [want for *_, want in rows]


def test_degraded_pages(spark):
    page = (4, 6, 1, bytearray(range(24)))
    df = spark.createDataFrame([("a.pdf", "a0", page), ("a.pdf", "a1", page), ("b.pdf", "b0", page), ("b.pdf", "b1", page)], f"file string, page_key string, image {pixels.IMAGE}")

    def effect(pixels_, seed):
        if seed == zlib.crc32(b"7|a1"):
            raise RuntimeError("no ink")
        return pixels_[:, :3] if seed == zlib.crc32(b"7|b0") else 255 - pixels_

    out = pixels.degrade_pages(df, effect, seed=7).cache()
    assert {r.page_key: (r.failure, r.moved, r.noisy is None) for r in out.collect()} == {"a0": (None, False, False), "a1": ("RuntimeError: no ink", False, True), "b0": (None, True, True), "b1": (None, False, False)}
    kept, errors = pixels.settle_degraded(out, "file")
    assert sorted((r.page_key, r.degraded) for r in kept.collect()) == [("a0", True), ("a1", False)]
    assert sorted(map(tuple, errors.collect())) == [("a.pdf", "RuntimeError: no ink", 1), ("b.pdf", "an effect changed the geometry", 1)]
    assert bytes(kept.filter("page_key = 'a0'").first().noisy.data) == bytes(255 - i for i in range(24))


def test_turned_images(spark):
    df = spark.createDataFrame([(1, (2, 3, 1, bytearray([1, 2, 3, 4, 5, 6])))], f"k int, image {pixels.IMAGE}")
    shown = lambda d: (d.first().image.height, d.first().image.width, list(d.first().image.data))
    assert shown(pixels.turned(df, "image")) == (3, 2, [4, 1, 5, 2, 6, 3]) and shown(pixels.turned(df, "image", right=False)) == (3, 2, [3, 6, 2, 5, 1, 4])
    assert shown(pixels.turned(pixels.turned(df, "image"), "image", right=False)) == (2, 3, [1, 2, 3, 4, 5, 6])


def test_read_pages(spark):
    def pdf():
        def read(content, dpi):
            assert dpi == 200
            for k, word in enumerate(content.decode().split()):
                if word == "stop":
                    raise OSError("broken")
                yield ValueError("bad page") if word == "bad" else {"text": word, "image": np.full((1, k + 1, 3), k)}

        return read

    docs = spark.createDataFrame([(1, "pdf", bytearray(b"a bad b")), (2, "pdf", bytearray(b"a stop b")), (3, "image", bytearray(b"x")), (4, "pdf", bytearray())], "doc_ord bigint, kind string, content binary")
    out = pages.read_pages(docs, {"pdf": pdf}, batch=2).cache()
    assert [(r.doc_ord, r.page, r.text, r.error) for r in out.orderBy("doc_ord", "page").collect()] == [
        (1, 0, "a", None), (1, 1, None, "ValueError: bad page"), (1, 2, "b", None), (2, 0, "a", None), (2, 1, None, "OSError: broken"), (3, 0, None, "LookupError: no reader of image")]
    good, bad = pages.split_errors(out)
    assert good.count() == 3 and sorted(map(tuple, bad.collect())) == [(1, "ValueError: bad page", 1), (2, "OSError: broken", 1), (3, "LookupError: no reader of image", 1)]
    assert good.filter("doc_ord = 1 and page = 2").first().image.width == 3


def test_long_document_is_read_by_many_tasks(spark):
    def numbers():
        class Numbers:
            """A document is how many pages it has; page 7 is bad, and reading page 13 breaks off."""

            def count(self, content):
                return int(content)

            def read(self, content, dpi, first, stop):
                from pyspark import TaskContext

                for k in range(first, stop):
                    if k == 13:
                        raise OSError("broken")
                    yield ValueError("bad page") if k == 7 else {"text": f"{k} of {content.decode()}|{TaskContext.get().partitionId()}"}

        return Numbers()

    docs = spark.createDataFrame([(1, "pdf", bytearray(b"1000")), (2, "pdf", bytearray(b"3")), (3, "pdf", bytearray(b"x")), (4, "image", bytearray(b"1")), (5, "pdf", bytearray(b"0"))], "doc_ord bigint, kind string, content binary").coalesce(1)
    out = pages.read_pages(docs, {"pdf": numbers}, most=50).cache()
    long_ = {r.page: r for r in out.filter("doc_ord = 1").collect()}
    # The range that breaks off ends there; all others are whole.
    assert sorted(long_) == [*range(14), *range(50, 1000)] and long_[7].error == "ValueError: bad page" and long_[13].error == "OSError: broken"
    assert all(r.text.split("|")[0] == f"{k} of 1000" for k, r in long_.items() if k not in (7, 13))
    assert len({r.text.split("|")[1] for r in long_.values() if r.text}) >= 8
    rest = [(r.doc_ord, r.page, r.text and r.text.split("|")[0], r.error and r.error.split(":")[0]) for r in out.filter("doc_ord > 1").orderBy("doc_ord", "page").collect()]
    assert rest == [(2, 0, "0 of 3", None), (2, 1, "1 of 3", None), (2, 2, "2 of 3", None), (3, 0, None, "ValueError"), (4, 0, None, "LookupError")]
    ranges = pages.page_ranges(docs, {"pdf": numbers}, 300).orderBy("first").collect()
    assert [(r.first, r.stop) for r in ranges] == [(0, 250), (250, 500), (500, 750), (750, 1000)]


def test_detectors(spark):
    def load():
        def find(image):
            if image["width"] == 2:
                raise RuntimeError("no memory")
            return [[[1, 2], [30, 2], [30, 40]], np.array([[0, 0], [5, 5], [5, 0]]), [[1, 2]], [["x", 1]] if image["width"] == 3 else [[0, 0], [90, 0], [90, 90]]]

        return find

    df = spark.createDataFrame([(k, (1, k, 1, bytearray(k))) for k in (1, 2, 3)], f"k int, image {pixels.IMAGE}")
    found = readings.BoxSource("paddle", load).detect(df).cache()
    assert found.groupBy("k").count().orderBy("k").collect() == [(1, 4)]  # a page that fails in the middle has none either
    good, bad = readings.detected_boxes(found, F.lit(60), F.lit(50))
    assert [(r.line_no, tuple(r.box)) for r in good.orderBy("line_no").collect()] == [(0, (1, 2, 30, 40)), (3, (0, 0, 60, 50))]
    assert [(r.line_no, r.error) for r in bad.collect()] == [(2, "fewer than three points")]


def test_append_found(spark, tmp_path):
    for k in (1, 2):
        append_found(spark.createDataFrame([(k, f"t{k}", f"i{k}.jpg", None)], "ord int, title string, file string, year int"), str(tmp_path), ["title", "year"], images="file")
    assert sorted(texts(tmp_path / "documents")) == ['{"title":"t1","year":null}', '{"title":"t2","year":null}']
    assert sorted(texts(tmp_path / "rec")) == ["images/i1.jpg\t", "images/i2.jpg\t"]


def test_model_calls():
    calls = []

    def call(*outcomes):
        calls[:] = outcomes

        def one():
            now = calls.pop(0)
            if isinstance(now, Exception):
                raise now
            return now

        return one

    assert readings.answer(call("x")) == ("x", None, None) and readings.answer(call(None)) == ("", None, None)
    assert readings.answer(call(ConnectionError(), "x")) == ("x", None, None)
    assert readings.answer(call(readings.CallFailed(503), readings.CallFailed(502), "x")) == ("", "status", 502) and calls == ["x"]
    assert readings.answer(call(readings.CallFailed(404), "x")) == ("", "status", 404) and calls == ["x"]
    assert readings.answer(call(TimeoutError(), "x")) == ("", "timeout", None) and readings.answer(call(KeyError("a"))) == ("", "format", None)
    assert readings.answer(call(RuntimeError("a"))) == ("", "RuntimeError", None)


def test_preview(spark, tmp_path):
    rows = spark.createDataFrame([("in/b.x.pdf", 2, True, (1, 1, 1, bytearray(b"a"))), ("in/b.x.pdf", 1, False, (1, 1, 1, bytearray(b"b"))), (".pdf", 12, False, (1, 1, 1, bytearray(b"c")))], f"file string, page int, degraded boolean, pixels {pixels.IMAGE}")

    def put(path, image):
        if path == ".pdf_p012.webp":
            raise OSError("full")

    bad = write_preview(rows, str(tmp_path / "pages"), put)
    assert [json.loads(line) for line in texts(tmp_path / "pages")] == [
        {"file": ".pdf", "page": 12, "image": ".pdf_p012.webp", "degraded": False}, {"file": "in/b.x.pdf", "page": 1, "image": "b.x_p001.webp", "degraded": False}, {"file": "in/b.x.pdf", "page": 2, "image": "b.x_p002.webp", "degraded": True}]
    assert [tuple(r) for r in bad.collect()] == [(".pdf_p012.webp", "full")]


def test_effects():
    assert pixels.effects_errors({"ink": [{"one_of": [{"name": "A", "params": {}}], "p": 0.5}], "post": []}) == []
    assert len(pixels.effects_errors({"ink": [{"name": "A", "one_of": []}, {"name": "B", "p": 2}, 3, {"one_of": [{"name": "C", "p": 1}]}], "paper": 1})) == 6
    assert pixels.effects_errors({"light": []}) and pixels.effects_errors([])


def test_requests():
    RunRequest()
    RunRequest(mode="vlm", vlm_engines=["glm_ocr"])
    for bad in (
        {"engines": []}, {"engines": ["x"]}, {"min_agree": 4}, {"min_agree": 0}, {"preferred_model": "glm_ocr"}, {"score_threshold": 1.5}, {"mode": "vlm"}, {"mode": "vlm", "vlm_engines": ["glm_ocr"], "vlm_min_agree": 2},
        {"pdf_ocr_fallback": False, "extract_pdf_text_layer": False}, {"degrade_page_share": 0.5, "mode": "vlm", "vlm_engines": ["glm_ocr"]}, {"degrade_page_share": 0.5, "degrade_effects": {"x": []}}, {"iou_threshold": 0}, {"lang": "de"},
    ):
        with pytest.raises(RequestError):
            RunRequest(**bad)


LOG = "job_id long, seq long, kind string, bucket string, diverged boolean, msg string"


def test_streaming_equals_batch(spark, tmp_path):
    rows = [(j, s, "error" if s % 3 == 0 else "line", "good" if s % 2 else "needs_review", s % 5 == 0, f"m{s}") for j in (1, 2) for s in range(80)]
    log = spark.createDataFrame(rows, LOG)
    log.filter("seq < 40").write.parquet(str(tmp_path / "log/a"))
    log.filter("seq >= 40").write.parquet(str(tmp_path / "log/b"))
    stream = lambda: spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    got = live.run_available(live.rollup_stream(stream()))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, progress.rollup(log).collect()))
    q = live.snapshots(stream(), str(tmp_path / "snapshot"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert live.snapshot(spark, str(tmp_path / "snapshot")).count() == 2
    ring = live.run_available(live.error_ring(stream(), 5), "job_id")
    assert {r.job_id: (r.error_count, r.errors) for r in ring.collect()} == {j: (27, [f"m{s}" for s in (66, 69, 72, 75, 78)]) for j in (1, 2)}
    # Later messages come first, and in many small batches.
    log.filter("seq >= 60").write.parquet(str(tmp_path / "back/a"))
    log.filter("seq < 60").repartition(7).write.parquet(str(tmp_path / "back/b"))
    back = spark.readStream.schema(log.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "back"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        ring = live.run_available(live.error_ring(back, 5), "job_id")
        assert {r.job_id: (r.error_count, r.errors) for r in ring.collect()} == {j: (27, [f"m{s}" for s in (66, 69, 72, 75, 78)]) for j in (1, 2)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_whole_runs(spark, tmp_path):
    lines = spark.createDataFrame([(1, 0, k, 100, 30) for k in range(3)] + [(1, 1, 0, 100, 30), (1, 1, 1, 5, 30)], "doc_ord int, page int, line_no int, w int, h int")
    reads = spark.createDataFrame([(1, p, k, o, e, t, 0.9) for p, k, ts in ((0, 0, "xx"), (0, 1, "xy"), (0, 2, ["a\nb", "c"]), (1, 0, "zz"), (1, 1, "zz")) for (o, e), t in zip(enumerate(["paddle", "surya"]), ts, strict=True)], "doc_ord int, page int, line_no int, engine_ord int, engine string, text string, score double")
    layer = spark.createDataFrame([(1, 1, 0, "слой £", 50, 20)], "doc_ord int, page int, line_no int, text string, w int, h int")
    words = spark.createDataFrame([(1, 1, 0, "слой")], "doc_ord int, page int, pos int, word string")
    request = RunRequest(engines=["paddle", "surya"], detector_engine="surya", output_dir=str(tmp_path / "run"))
    plan = plan_consensus(request, lines, reads, words, layer, list("xyслой"), start=9_999)
    got = [(r.page, r.line_no, r.n, r.crop, r.bucket, r.source) for r in plan.lines.orderBy("n").collect()]
    assert got == [(0, 0, 9_999, "crops/0/image_09999.webp", "good", "voted"), (0, 1, 10_000, "crops/1/image_10000.webp", "needs_review", "voted"), (1, 0, 10_001, "crops/1/image_10001.webp", "needs_review", "text_layer")]
    assert plan.dropped.count() == 1 and tuple(plan.totals().first()) == (1, 2, 0, 1, 3)
    assert tuple(jobs.run(spark, plan, "job-1").first()) == ("done", None, 1, 2, 0, 1)
    assert tuple(jobs.status(spark, str(tmp_path / "run")).first())[0] == "done"
    assert texts(tmp_path / "run/lines/bucket=good") == ["crops/0/image_09999.webp\tx"] and len(texts(tmp_path / "run/debug")) == 2

    boxes = spark.createDataFrame([(1, 0, e, 0, 10.0 + d, 10.0, 180.0, 44.0, "t") for d, e in ((0, "hunyuan_ocr"), (2, "glm_ocr"))] + [(1, 0, "glm_ocr", 1, 0.0, 60.0, 5.0, 90.0, "small")], "doc_ord int, page int, engine string, idx int, x0 double, y0 double, x1 double, y1 double, text string")
    plan = plan_vlm(RunRequest(mode="vlm", vlm_engines=["hunyuan_ocr", "glm_ocr"], iou_threshold=0.999), boxes, F.lit(200), F.lit(100))
    assert [(r.n, r.text, r.engine, r.w) for r in plan.lines.collect()] == [(1, "t", "hunyuan_ocr", 170)]
