"""Operators against expected values and against plain rules on random input."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quoin.operators import boxes as bx
from quoin.operators import curate, labeling, numbering, progress, quality, spotting
from quoin.operators import vote as vt

READINGS = "line int, engine_ord int, engine string, text string, score double"
ENGINES = ["paddle", "surya", "tesseract"]


def readings(spark, lines):
    rows = [(k, o, ENGINES[o], t, float(s)) for k, line in enumerate(lines) for o, (t, s) in enumerate(line)]
    return spark.createDataFrame(rows, READINGS)


def one_vote(spark, line, **how):
    return tuple(vt.vote(readings(spark, [line]), ["line"], **how).first())[1:]


def test_vote_examples(spark):
    assert one_vote(spark, [("привет", 0.5), ("привет", 0.4), ("другое", 0.9)], threshold=0.9) == ("good", "привет", "paddle", False)
    assert one_vote(spark, [("a", 0.5), ("b", 0.6), ("c", 0.7)], threshold=0.6, preferred="tesseract", min_agree=1)[:3] == ("good", "c", "tesseract")
    assert one_vote(spark, [("a", 0.5), ("b", 0.95), ("c", 0.4)], threshold=0.9, preferred="paddle", min_agree=1)[:3] == ("good", "b", "surya")
    assert one_vote(spark, [("a", 0.5), ("b", 0.4)], threshold=0.9, min_agree=1) == ("needs_review", "a", "paddle", False)
    assert one_vote(spark, [("И1", 0.97), ("И2", 0.96), ("", 0)], threshold=0.9) == ("needs_review", "И1", "paddle", True)
    assert one_vote(spark, [("a", 0.97), ("b", 0.5)], threshold=0.9, preferred="surya") == ("needs_review", "b", "surya", False)
    assert one_vote(spark, [("", 0.0), ("", 0.0)], threshold=0.0, min_agree=1) == ("good", "", "paddle", False)
    empty = vt.vote(readings(spark, []), ["line"], 0.9, lines=spark.createDataFrame([(7,)], "line int"))
    assert [tuple(r) for r in empty.collect()] == [(7, "needs_review", "", "", False)]


def plain_vote(line, threshold, preferred, min_agree):
    said = [(ENGINES[o], t, s) for o, (t, s) in enumerate(line)]
    diverged = len({t for _, t, s in said if t and s >= threshold}) >= 2
    best = max(said, key=lambda r: r[2])
    own = next((r for r in said if r[0] == preferred), None)
    if min_agree >= 2:
        counts = Counter(t for _, t, _ in said if t)
        if counts and counts.most_common(1)[0][1] >= min_agree:
            text = counts.most_common(1)[0][0]
            return "good", text, next(e for e, t, _ in said if t == text), diverged
        hint = own if own and own[1] else best
        return "needs_review", hint[1], hint[0], diverged
    if own and own[2] >= threshold:
        return "good", own[1], own[0], diverged
    return ("good" if best[2] >= threshold else "needs_review"), best[1], best[0], diverged


@pytest.mark.parametrize(("threshold", "preferred", "min_agree"), [(0.5, None, 2), (0.5, "surya", 2), (0.0, "tesseract", 1), (0.6, None, 1), (0.3, "paddle", 3)])
def test_vote_random(spark, threshold, preferred, min_agree):
    rng = random.Random(1)
    lines = [[(rng.choice(["", "a", "b", "c"]), rng.randrange(0, 11) / 10) for _ in range(rng.randrange(1, 4))] for _ in range(400)]
    got = {r.line: tuple(r)[1:] for r in vt.vote(readings(spark, lines), ["line"], threshold, preferred, min_agree).collect()}
    assert got == {k: plain_vote(line, threshold, preferred, min_agree) for k, line in enumerate(lines)}


def test_multiline(spark):
    r = readings(spark, [[("a\nb", 1), ("ab", 1)], [("c", 1)]])
    kept, dropped = vt.split_multiline(r, ["line"], "surya")
    assert [x.line for x in kept.collect()] == [1] and [x.line for x in dropped.collect()] == [0]
    assert vt.split_multiline(r, ["line"], "paddle")[0].count() == 3


BOXES = "page int, engine_ord int, engine string, idx int, x0 double, y0 double, x1 double, y1 double, text string"


def overlap(a, b):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return 0.0 if union <= 0 else w * h / union


def plain_groups(boxes, threshold):
    """boxes: {(engine, idx): box}. Groups as lists of keys."""
    used, out = set(), []
    for key in sorted(boxes):
        if key in used:
            continue
        group = [key]
        for e in sorted({k[0] for k in boxes if k[0] > key[0]}):
            best = max(((overlap(boxes[key], boxes[k]), k) for k in boxes if k[0] == e and k not in used and overlap(boxes[key], boxes[k]) >= threshold), default=None)
            group += [best[1]] if best else []
        used |= set(group)
        out.append(group)
    return out


def test_groups_random(spark):
    rng = random.Random(2)
    pages, rows = {}, []
    for p in range(60):
        pages[p] = {}
        for e in range(3):
            for i in range(rng.randrange(0, 6)):
                x, y = rng.randrange(0, 4) * 5, rng.randrange(0, 4) * 5
                box = (x, y, x + rng.randrange(0, 4) * 5, y + rng.randrange(1, 3) * 5)
                pages[p][e, i] = box
                rows.append((p, e, f"e{e}", i, *map(float, box), rng.choice(["", "a", "b", "```\na\n```", " b  c"])))
    df = spark.createDataFrame(rows, BOXES)
    groups = bx.group_by_iou(df, ["page"], 0.3)
    got = {}
    for r in groups.orderBy("page", "grp").collect():
        got.setdefault(r.page, []).append([(m.e, m.i) for m in r.members])
    assert got == {p: g for p in pages if (g := plain_groups(pages[p], 0.3))}

    texts = {(r[0], r[1], r[3]): {"": "", "a": "a", "b": "b", "```\na\n```": "a", " b  c": "b c"}[r[8]] for r in rows}
    resolved = bx.resolve(groups, 2)
    for r in resolved.collect():
        said = [(m.engine, texts[r.page, m.e, m.i]) for m in r.members if texts[r.page, m.e, m.i]]
        counts = Counter(t for _, t in said)
        want = ("needs_review", "", "", False)
        if said:
            text, n = counts.most_common(1)[0]
            want = ("good" if n >= 2 else "needs_review", text, next(e for e, t in said if t == text), len(counts) >= 2)
        assert (r.bucket, r.text, r.engine, r.diverged) == want

    want, by = set(), {}
    for r in resolved.orderBy("page", "grp").collect():
        a = r.members[0]
        box, seen = (a.x0, a.y0, a.x1, a.y1), by.setdefault(r.page, [])
        if r.text and any(t == r.text and overlap(b, box) > 0 for b, t in seen):
            continue
        want.add((r.page, r.grp))
        if r.text:
            seen.append((box, r.text))
    assert {(r.page, r.grp) for r in bx.dedup_groups(resolved, ["page"]).collect()} == want


def test_spotting(spark):
    parse = lambda engine, raw, w=0, h=0: spark.range(1).select(spotting.parse(F.lit(engine), F.lit(raw).cast("string"), F.lit(w), F.lit(h))).first()[0]
    flat = lambda got: [(x.text, tuple(x.box) if x.box else None) for x in got]
    assert flat(parse("hunyuan_ocr", "Привет мир(100,200),(500,450)", 2000, 1000)) == [("Привет мир", (200, 200, 1000, 450))]
    assert flat(parse("hunyuan_ocr", "первая(1,2),(3,4)\nвторая (5, 6) , (7,8)")) == [("первая", (1, 2, 3, 4)), ("вторая", (5, 6, 7, 8))]
    assert parse("hunyuan_ocr", "(1,2),(3,4)") == [] and parse("hunyuan_ocr", None) == [] and parse("unknown", "x") == []
    loc = lambda *v: "".join(f"<|LOC_{x}|>" for x in v)
    a, b = loc(95, 190, 505, 190, 505, 460, 95, 460), loc(0, 500, 250, 500, 250, 600, 0, 600)
    full = f"<|TEXT_START|>one<|TEXT_END|><|LOC_BEGIN|>{a}<|LOC_END|><|TEXT_START|>two<|TEXT_END|><|LOC_BEGIN|>{b}<|LOC_END|>"
    want = [("one", (190, 190, 1010, 460)), ("two", (0, 500, 500, 600))]
    assert flat(parse("paddleocr_vl", full, 2000, 1000)) == want
    assert flat(parse("paddleocr_vl", full.replace("<|LOC_BEGIN|>", "").replace("<|LOC_END|>", ""), 2000, 1000)) == want
    assert flat(parse("paddleocr_vl", f"one{a}two{b}", 2000, 1000)) == want
    assert parse("paddleocr_vl", "one" + loc(1, 2, 3)) == [] and parse("paddleocr_vl", full.replace("one", " "), 1, 1)[0].text == "two"
    assert flat(parse("glm_ocr", "```\nx\n\n y\n```")) == [("x", None), ("y", None)]


WORDS = "doc string, page int, pos int, word string"
CLEAN = "Изменение размеров деталей после обработки не допускается .".split()
GARBAGE = "BATCH oma 19В6 рстфх втрвк гпрстк А1Б ввввввв н4х".split()


def words(spark, pages):
    rows = [(d, p, i, w) for (d, p), ws in pages.items() for i, w in enumerate(ws)]
    return spark.createDataFrame(rows, WORDS), spark.createDataFrame(list(pages), "doc string, page int")


def test_quality(spark):
    pages = {
        ("a", 0): CLEAN * 5, ("a", 1): CLEAN * 4, ("b", 0): GARBAGE * 5, ("c", 0): CLEAN * 5, ("c", 1): GARBAGE * 5, ("d", 0): [], ("e", 0): CLEAN * 4 + ["BATCH"], ("f", 0): ["да", "нет"],
        ("g", 0): list("Негативные"), ("h", 0): ["Изменение", "BATCH"],
    }
    w, p = words(spark, pages)
    out = quality.page_quality(w, ["doc", "page"], p)
    got = {(r.doc, r.page): r for r in out.collect()}
    assert got["a", 0].quality == 1.0 and got["a", 0].usable and got["b", 0].quality < 0.3 and not got["b", 0].usable
    assert (got["d", 0].quality, got["d", 0].measured, got["d", 0].usable) == (0.0, None, False)
    assert 0.9 < got["e", 0].quality < 0.98 and not got["e", 0].usable
    assert got["f", 0].measured is None and got["f", 0].usable and got["g", 0].quality == 0.0 and got["h", 0].quality == 9 / 14
    said = {r.doc: r for r in quality.diagnose(out, ["doc"]).collect()}
    assert {d: said[d].recommend for d in "abcd"} == {"a": "text_layer", "b": "ocr", "c": "mixed", "d": "ocr"}
    assert said["d"].median_quality is None and said["c"].usable_pages == 1 and said["d"].pages_without_text == 1 and said["a"].page_quality == [1.0, 1.0]
    routes = {r.doc: r.route for r in quality.route(out, True, False).filter("page = 0").collect()}
    assert routes["a"] == "text_layer" and routes["b"] == "skip"


def test_spaced_runs(spark):
    w, _ = words(spark, {("a", 0): ["a", "b", "слово", "н", "е", "г", "."]})
    marks = [r.spaced for r in quality.mark_words(w, ["doc", "page"]).orderBy("pos").collect()]
    assert marks == [False, False, False, True, True, True, False]


def test_numbering(spark):
    rows = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "k int, v int").repartition(5)
    out = numbering.number_rows(rows, ["k"], 9_990).orderBy("k").collect()
    assert [r.n for r in out] == list(range(9_990, 10_091))
    paths = [r[0] for r in spark.createDataFrame([(1,), (9999,), (10000,), (123456,)], "n int").select(numbering.crop_path(F.col("n"))).collect()]
    assert paths == ["crops/0/image_00001.webp", "crops/0/image_09999.webp", "crops/1/image_10000.webp", "crops/12/image_123456.webp"]
    files = lambda *p: numbering.resume_from(spark.createDataFrame([(x,) for x in p], "path string")).first().next
    assert files("0/image_00009.webp", "1/image_10042.webp", "a/b/image_99999.webp", "image_5.webp.tmp") == 10043 and files("3f2a.webp") == 1


def test_rank_over_many_partitions(spark):
    rows = spark.createDataFrame([("hot" if i % 3 else f"g{i % 7}", i) for i in range(3000)] + [(None, 1), (None, 2)], "g string, i int")
    got = {}
    for r in numbering.rank_within(rows.repartition(8), "g", ["i"]).collect():
        got.setdefault(r.g, []).append((r.i, r["rank"]))
    assert len(got["hot"]) == 2000 and all([k for _, k in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


def test_curation(spark):
    items = spark.createDataFrame([("a", i, str(i)) for i in (1, 2, 3)] + [("b", 1, "x")] + [("c", i, str(10 * i)) for i in (1, 2)], "s string, i int, v string")
    assert [r.v for r in curate.round_robin(items, "s", "i").orderBy("turn", "s").collect()] == ["1", "x", "10", "2", "20", "3"]
    rows = spark.createDataFrame([(1, "t1", "s1"), (2, "t2", "s1"), (3, "t2", "s2"), (4, "t3", ""), (5, "t4", ""), (6, "t3", "s9")], "o int, t string, s string")
    assert sorted(r.o for r in curate.first_by_two_keys(rows, ("t", "s"), "o").collect()) == [1, 3, 4, 5]
    assert sorted(r.o for r in curate.first_by_key(rows, "s", ["o"]).collect()) == [1, 3, 4, 5, 6]
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "r"), ("r", "c"), ("c", "b"), ("b", "d")], "parent string, child string")
    found = curate.walk(edges, spark.createDataFrame([("r",)], "node string"), 2)
    assert {(r.node, r.level) for r in found.collect()} == {("r", 0), ("a", 1), ("c", 1), ("b", 2)}
    seen = spark.createDataFrame([("t1", None), (None, "s2")], "t string, s string")
    assert sorted(r.o for r in curate.without_seen(rows, seen, "t", "s").collect()) == [2, 4, 5, 6]


def test_two_keys_random(spark):
    rng = random.Random(3)
    rows = [(i, f"t{rng.randrange(30)}", rng.choice(["", *(f"s{k}" for k in range(30))])) for i in range(120)]
    a, b, want = set(), set(), []
    for i, t, s in rows:
        if t not in a and not (s and s in b):
            a.add(t), b.add(s), want.append(i)
    df = spark.createDataFrame(rows, "o int, t string, s string")
    for rounds, most in ((3, 1000), (0, 1000), (1, 3), (0, 3)):
        got = curate.first_by_two_keys(df, ("t", "s"), "o", rounds, most)
        assert sorted(r.o for r in got.collect()) == want
    assert curate.first_by_two_keys(df.limit(0), ("t", "s"), "o").count() == 0


def test_two_keys_in_a_long_chain(spark, monkeypatch):
    """Each row shares a key with the next one, so every other row stays, and each round would settle two."""
    rows = [(i, f"t{(i + 1) // 2}", f"s{i // 2}") for i in range(2000)] + [(5000, None, None), (5001, None, "")]
    stars = []
    import quoin.operators.components as comp

    before = comp.stored
    monkeypatch.setattr(comp, "stored", lambda df, name, *a: stars.append(name) or before(df, name, *a))
    got = curate.first_by_two_keys(spark.createDataFrame(rows, "o int, t string, s string").repartition(4), ("t", "s"), "o")
    assert sorted(r.o for r in got.collect()) == [*range(0, 2000, 2), 5000, 5001]
    assert 0 < stars.count("small-star") <= 16


def test_hot_key_is_reduced_where_it_lies(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (20_000 - F.col("id")).alias("o"), F.lit("x").alias("_key"))
    first = curate.first_by_key(rows, "k", ["o"])
    assert first.filter("k = 'hot'").first().o == 1 and first.count() == 6668
    assert "partial_min_by" in first._jdf.queryExecution().toString()


def test_a_page_of_very_many_boxes(spark):
    boxes = spark.range(15_000).select(
        F.lit(1).alias("page"), (F.col("id") % 3).cast("int").alias("engine_ord"), F.concat(F.lit("e"), F.col("id") % 3).alias("engine"), F.floor(F.col("id") / 3).cast("int").alias("idx"),
        *[(base + d).cast("double").alias(c) for c, base, d in (
            ("x0", F.floor(F.col("id") / 3) % 50 * 100, F.col("id") % 3), ("y0", F.floor(F.col("id") / 150) * 20, F.lit(0)), ("x1", F.floor(F.col("id") / 3) % 50 * 100, 90 + F.col("id") % 3), ("y1", F.floor(F.col("id") / 150) * 20, F.lit(18)))],
        F.lit("t").alias("text"),
    )
    groups = bx.group_by_iou(boxes.repartition(8), ["page"], 0.5)
    assert groups.agg(F.count(F.lit(1)), F.min(F.size("members")), F.max("grp")).first() == (5000, 3, 4999)
    assert bx.overlaps(boxes, ["page"], 0.5).count() == 15_000


def test_labelling(spark):
    lines = spark.createDataFrame(
        [("good", 0, "c/a.webp\tfrom good\t120\t32"), ("good", 1, "c/b.webp\tb"), ("needs_review", 2, "c/a.webp\tx"), ("needs_review", 3, "c/n.webp\tn"), ("review", 4, "c/b.webp\tedited"), ("review", 5, "c/gone.webp\tg"),
         ("good", 6, "c/gone2.webp\t1"), ("review", 7, "../out.webp\tx"), ("good", 8, "  "), ("good", 9, "c/t.txt\tx"), ("good", 10, "c/a.webp\tlast")], "src string, ord int, value string")
    files = spark.createDataFrame([(f"c/{n}.webp",) for n in "abn"], "path string")
    parsed = labeling.parse_lines(lines)
    out = {r.name: (r.text, r.src, r.is_marked, r.ord) for r in labeling.merge_sources(parsed, files).collect()}
    assert out == {"a.webp": ("last", "good", True, 0), "b.webp": ("edited", "review", False, 4), "n.webp": ("n", "needs_review", False, 3)}
    recs, missing = labeling.records(parsed, files)
    assert {r.name: r.text for r in recs.collect()} == {"a.webp": "last", "b.webp": "edited", "n.webp": "n"} and missing.count() == 2
    marked = labeling.with_status(recs, spark.createDataFrame([("a.webp",)], "name string"))
    debug = spark.createDataFrame([(0, "c/b.webp", False), (1, "c/b.webp", True)], "ord int, crop string, diverged boolean")
    shown = labeling.with_debug(marked, debug)
    pick = lambda w: sorted(r.name for r in labeling.select_records(shown, w).collect())
    assert (pick("marked"), pick("diverged"), pick("unmarked")) == (["a.webp"], ["b.webp"], ["b.webp", "n.webp"])
    assert tuple(labeling.stats(shown).first()) == (3, 1, 2, 33)
    assert [r.name for r in labeling.page_of(shown, 9, 2).collect()] == ["n.webp"]
    edited = labeling.apply_edits(shown, spark.createDataFrame([("n.webp", 0, "1"), ("n.webp", 1, "2")], "name string, ord int, text string"))
    assert {(r.name, r.text, r.is_marked) for r in edited.collect()} >= {("n.webp", "2", True), ("b.webp", "edited", False)}
    assert labeling.delete(recs, spark.createDataFrame([("n.webp",)], "name string")).count() == 2
    assert sorted(r.line for r in labeling.append_new(spark.createDataFrame([("x",)], "line string"), spark.createDataFrame([("x",), ("y",), ("y",)], "line string")).collect()) == ["x", "y"]
    assert [r.v for r in labeling.keep_last(spark.createDataFrame([(i,) for i in range(4)], "v int"), 2, "v").orderBy("v").collect()] == [2, 3]


def test_progress(spark):
    log = [(1, i, "error", None, None, f"e{i}") for i in range(60)] + [(1, 100, "line", "good", True, None), (1, 101, "line", "needs_review", False, None), (1, 102, "found", None, None, None), (1, 103, "done", None, None, None), (2, 1, "failed", None, None, None), (2, 2, "cancelled", None, None, None)]
    df = spark.createDataFrame(log, "job_id long, seq long, kind string, bucket string, diverged boolean, msg string")
    row = {r.job_id: r for r in progress.rollup(df).collect()}[1]
    assert (row.good_count, row.review_count, row.diverged_count, row.error_count, row.docs_found) == (1, 1, 1, 60, 1)
    assert progress.last_errors(df).first().errors == [f"e{i}" for i in range(10, 60)]
    assert {r.job_id: r.status for r in progress.states(df).collect()} == {1: "done", 2: "error"}
    calls = spark.createDataFrame([("a", i, x) for i, x in enumerate([True, True, False, True, True, True, True])] + [("b", 0, True)], "engine string, seq int, timed_out boolean")
    assert [tuple(r) for r in progress.broken_engines(calls).collect()] == [("a", 5)]
