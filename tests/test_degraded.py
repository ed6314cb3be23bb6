"""Effects by description, and runs that degrade a share of their pages."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.operators import effects, pixels
from quoin.plans import jobs
from quoin.plans.request import RunRequest
from quoin.plans.run import plan_consensus

SPEC = {"post": [{"name": "c", "params": {"k": [1, 2]}}], "ink": [{"name": "a", "p": 0.25}, {"one_of": [{"name": "a"}, {"one_of": [{"name": "b"}, {"name": "c"}]}]}]}


def test_steps_are_drawn_by_key_and_place(spark):
    pages = spark.range(8000).select("id", effects.effect_steps(SPEC, 3, F.col("id")).alias("s"))
    rows = {r.id: [(x.phase, x.effect, x.params) for x in r.s] for r in pages.collect()}
    assert all(r[-1] == ("post", "c", '{"k": [1, 2]}') and [x[0] for x in r[:-1]] == ["ink"] * (len(r) - 1) for r in rows.values())
    first = sum(len(r) == 3 for r in rows.values()) / 8000
    second = [r[-2][1] for r in rows.values()]
    assert abs(first - 0.25) < 0.02 and abs(second.count("a") / 8000 - 0.5) < 0.02 and abs(second.count("b") / 8000 - 0.25) < 0.02
    again = {r.id: [(x.phase, x.effect, x.params) for x in r.s] for r in pages.repartition(7).filter("id % 10 = 0").collect()}
    assert all(rows[k] == v for k, v in again.items())
    assert spark.range(1).select(effects.effect_steps({}, 3, F.col("id")).alias("s")).first().s == []


def test_problems_of_descriptions():
    assert effects.problems(SPEC, {"a": None, "c": None}) == ["no effect is called b"]
    assert effects.problems({"ink": [{"p": 1}]}, {}) != [] and effects.names(SPEC) == {"a", "b", "c"}


def test_steps_are_applied_in_order_each_with_its_own_numbers():
    registry = {"add": lambda x, p, rng: x + p["k"], "double": lambda x, p, rng: x * 2, "noise": lambda x, p, rng: x + rng.integers(0, 50, x.shape), "gray": lambda x, p, rng: x[:, :, 0]}
    step = lambda name, **p: {"phase": "ink", "effect": name, "params": json.dumps(p)}
    page = np.ones((2, 3, 3), int)
    assert (effects.apply_steps(page, [step("add", k=2), step("double")], registry, 1) == 6).all()
    noisy = lambda seed: effects.apply_steps(page, [step("noise"), step("noise")], registry, seed)
    assert (noisy(1) == noisy(1)).all() and (noisy(1) != noisy(2)).any()
    assert effects.apply_steps(page, [step("gray")], registry, 1).shape == (2, 3, 3)
    with pytest.raises(LookupError):
        effects.apply_steps(page, [step("lost")], registry, 1)


def page_image(lines, height=20, width=120):
    rows = np.full((height * lines, width, 1), 235, np.uint8)
    for k in range(lines):
        rows[k * height + 5 : k * height + 15, 4 + k : width - 4 : 6] = 25
    return rows


def run(spark, tmp_path, effect, share=1.0, files=("a.pdf",)):
    image = page_image(3)
    shown = (image.shape[0], image.shape[1], 1, bytearray(image.tobytes()))
    pages = spark.createDataFrame([(d, p, f"in/{f}", shown) for d, f in enumerate(files) for p in (0, 1)], f"doc_ord long, page int, file string, image {pixels.IMAGE}")
    layer = spark.createDataFrame([(d, p, k, f"text {k}", 120, 20, 0, 20 * k, 120, 20 * k + 20) for d in range(len(files)) for p in (0, 1) for k in range(3)], "doc_ord long, page int, line_no long, text string, w int, h int, x0 int, y0 int, x1 int, y1 int")
    words = spark.createDataFrame([(d, p, 0, "text") for d in range(len(files)) for p in (0, 1)], "doc_ord long, page int, pos int, word string")
    none = spark.createDataFrame([], "doc_ord long, page int, line_no long, w int, h int")
    reads = spark.createDataFrame([], "doc_ord long, page int, line_no long, engine_ord int, engine string, text string, score double")
    request = RunRequest(output_dir=str(tmp_path), degrade_page_share=share, degrade_effects={"ink": [{"name": "effect"}]})
    plan = plan_consensus(request, none, reads, words, layer, pages=pages, effects={"effect": effect})
    return plan, tuple(jobs.run(spark, plan, f"degraded-{tmp_path.name}").first())


def records(tmp_path):
    return [json.loads(line) for p in sorted((tmp_path / "degrade").glob("part-*")) for line in p.read_text().splitlines()]


def test_line_comes_from_the_degraded_page(spark, tmp_path):
    plan, said = run(spark, tmp_path, lambda x, p, rng: np.clip(x.astype(int) - 12, 0, 255))
    assert said == ("done", None, 6, 0, 0, 0)
    assert [r["degraded"] for r in records(tmp_path)] == [True] * 6
    assert records(tmp_path)[0] == {"crop": "crops/0/image_00001.webp", "source": "a.pdf p. 1", "degraded": True}
    assert sorted(r.text for r in plan.lines.collect()) == sorted(["text 0", "text 1", "text 2"] * 2)


def test_line_that_does_not_read_well_keeps_the_clean_crop(spark, tmp_path):
    assert run(spark, tmp_path, lambda x, p, rng: np.full_like(x, 255))[1] == ("done", None, 6, 0, 0, 0)
    assert [r["degraded"] for r in records(tmp_path)] == [False] * 6


def test_lines_that_no_effect_has_touched(spark, tmp_path):
    def lower_half(x, p, rng):
        x = x.copy()
        x[40:] = 255
        return x

    run(spark, tmp_path, lower_half)
    assert [r["degraded"] for r in records(tmp_path)] == [None, None, False] * 2


def test_effect_that_fails_leaves_the_page_clean(spark, tmp_path):
    def crash(x, p, rng):
        raise RuntimeError("no numbers")

    plan, said = run(spark, tmp_path, crash)
    assert said == ("done", None, 6, 0, 0, 2) and records(tmp_path) == []
    assert [(r.file, r.error, r.n) for r in plan.errors.collect()] == [("in/a.pdf", "RuntimeError: no numbers", 2)]


def test_effect_that_changes_the_geometry_fails_the_file(spark, tmp_path):
    plan, said = run(spark, tmp_path, lambda x, p, rng: x[:-1] if p == {} and x.shape[0] == 60 else x)
    assert said[:4] == ("done", None, 0, 0) and said[5] == 2
    assert {r.error for r in plan.errors.collect()} == {"an effect changed the geometry"}


def test_run_that_degrades_nothing_writes_no_record(spark, tmp_path):
    plan, said = run(spark, tmp_path, None, share=0.0)
    assert said == ("done", None, 6, 0, 0, 0) and not (tmp_path / "degrade").exists() and "page_degraded" not in plan.lines.columns


def test_share_of_pages_and_what_is_missing(spark, tmp_path):
    plan, _ = run(spark, tmp_path, lambda x, p, rng: 255 - x, share=0.5, files=[f"{k}.pdf" for k in range(20)])
    hit = plan.lines.filter("page_degraded").select("doc_ord", "page").distinct().count()
    assert 8 < hit < 32 and plan.lines.count() == 120
    with pytest.raises(ValueError, match="images"):
        plan_consensus(RunRequest(degrade_page_share=0.5), plan.lines, plan.lines)


def test_crops_of_chosen_lines(spark):
    image = page_image(2)
    shown = lambda x: (x.shape[0], x.shape[1], 1, bytearray(x.astype(np.uint8).tobytes()))
    noisy = image.copy()
    noisy[:20] -= 10
    noisy[20:] = 255
    pages = spark.createDataFrame([(1, shown(image), shown(noisy), [(0, 0, 0, 120, 20), (1, 0, 20, 120, 40)])], f"k int, image {pixels.IMAGE}, noisy {pixels.IMAGE}, boxes array<struct<line_no:bigint,x0:int,y0:int,x1:int,y1:int>>")
    rows = pixels.choose_on_page(pages, with_crops=True).orderBy("line_no").collect()
    assert [(r.k, r.degraded) for r in rows] == [(1, True), (1, False)]
    assert bytes(rows[0].crop.data) == noisy[:20].tobytes() and bytes(rows[1].crop.data) == image[20:].tobytes()
