"""Runs that are stopped, taken over, gone on with, and read while they go on; engines under a deadline."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from quoin import storage
from quoin.operators import progress
from quoin.plans import jobs
from quoin.plans.lease import Lease, RunActive
from quoin.plans.passes import BOXES, Ledger, run_passes
from quoin.plans.request import RunRequest
from quoin.plans.run import Plan
from quoin.sinks import backup, delete_with_files
from quoin.sources.deadline import Calls, EngineGroup, detect_in_time
from quoin.sources.readings import BoxSource
from quoin.streaming import progress as live
from quoin.streaming import run as streamed


def texts(path):
    return sorted(line for p in path.glob("part-*") for line in p.read_text().splitlines())


# --- deadlines --------------------------------------------------------------------------------------------------------------


def hang(seconds=2.0):
    time.sleep(seconds)
    return "late"


def test_answers_within_the_deadline():
    assert Calls().answers({"a": lambda: "A", "b": lambda: "B"}, 5) == {"a": ("A", None), "b": ("B", None)}
    assert Calls().answers({"slow": lambda: hang(0.5), "fast": lambda: "ok"}, 0.1) == {"slow": (None, "timeout"), "fast": ("ok", None)}


def test_one_deadline_however_many_engines_hang():
    began = time.monotonic()
    assert Calls().answers({n: hang for n in "abcdef"}, 0.2) == {n: (None, "timeout") for n in "abcdef"}
    assert time.monotonic() - began < 1.0


def test_failures_are_told_apart_and_do_not_count_as_late():
    def fails():
        raise ConnectionError

    calls = Calls(streak=2)
    for _ in range(4):
        assert calls.answers({"a": fails}, 5) == {"a": (None, "connect")}


def test_an_engine_is_called_again_once_it_is_back_and_left_out_after_a_streak():
    calls, began = Calls(streak=3), time.monotonic()
    assert calls.answers({"a": lambda: hang(0.3)}, 0.05)["a"] == (None, "timeout")
    assert calls.answers({"a": lambda: "ok"}, 5)["a"] == ("ok", None)  # waits for the abandoned call, not beside it
    assert time.monotonic() - began >= 0.3
    for _ in range(3):
        assert calls.answers({"a": hang, "b": lambda: "ok"}, 0.05) == {"a": (None, "timeout"), "b": ("ok", None)}
    began = time.monotonic()
    assert calls.answers({"a": lambda: "ok", "b": lambda: "ok"}, 5) == {"a": (None, "off"), "b": ("ok", None)}
    assert time.monotonic() - began < 1


def test_engine_group_over_crops(spark):
    def slow():
        import time

        return lambda images: time.sleep(30)

    crops = spark.createDataFrame([(k, f"t{k}", "x") for k in range(6)], "k int, image string, engine_note string").coalesce(1)
    group = EngineGroup({"fast": lambda: lambda images: [(i, 1.0) for i in images], "slow": slow, "short": lambda: lambda images: [("x", 1.0)] * 2}, 1.0, batch=3, streak=1)
    began = time.monotonic()
    got = {(r.k, r.engine): (r.engine_ord, r.text, r.score, r.failure) for r in group.read(crops).collect()}
    assert time.monotonic() - began < 20
    assert all(got[k, "fast"] == (0, f"t{k}", 1.0, None) and got[k, "short"] == (2, "", 0.0, "format") for k in range(6))
    assert [got[k, "slow"] for k in (0, 2, 3, 5)] == [(1, "", 0.0, "timeout")] * 2 + [(1, "", 0.0, "off")] * 2


def test_an_engine_keeps_its_thread_until_its_calls_go():
    calls, seen = Calls(), []
    for _ in range(50):
        calls.answers({"a": lambda: seen.append(threading.current_thread())}, 5)
    assert len({id(t) for t in seen}) == 1
    del calls
    seen[0].join(5)
    assert not seen[0].is_alive()


def test_an_engine_that_exits_is_called_again():
    def leaves():
        raise SystemExit

    calls = Calls(streak=1)
    assert calls.answers({"a": leaves}, 5) == {"a": (None, "SystemExit")}
    assert calls.answers({"a": lambda: "ok"}, 5) == {"a": ("ok", None)}


def test_readings_of_many_small_batches_go_back_to_spark_together(spark, monkeypatch):
    crops = spark.createDataFrame([(k, f"t{k}") for k in range(1500)], "k int, image string")
    group = EngineGroup({"a": lambda: lambda images: [(i, 1.0) for i in images], "b": lambda: lambda images: [] if images == ["t7"] else [("x", 0.5)]}, 5.0, batch=1)
    want = [(k, *x) for k in range(1500) for x in ((0, "a", f"t{k}", 1.0, None), (1, "b", "" if k == 7 else "x", 0.0 if k == 7 else 0.5, "format" if k == 7 else None))]
    assert sorted((tuple(r) for r in group.read(crops.coalesce(1)).collect()), key=lambda r: r[:2]) == want
    monkeypatch.setattr(type(crops), "mapInPandas", lambda self, run, kinds: run)
    sizes = [len(f) for f in group.read(crops)(iter([crops.toPandas()] * 2 + [crops.limit(0).toPandas()]))]
    assert sum(sizes) == 6000 and len(sizes) <= 6


def test_hung_detector_gives_a_page_without_boxes(spark):
    def load():
        import time

        def find(image):
            if image["width"] == 2:
                time.sleep(30)
            return [[[1, 2], [30, 2], [30, 40]]]

        return detect_in_time(find, Calls(), 0.5)

    pages = spark.createDataFrame([(k, (1, k, 1, bytearray(k))) for k in (1, 2)], "k int, image struct<height:int,width:int,channels:int,data:binary>").coalesce(1)
    assert [(r.k, r.line_no) for r in BoxSource("paddle", load).detect(pages).collect()] == [(1, 0)]


# --- one run at a time ------------------------------------------------------------------------------------------------------


def slow_plan(spark, path, seconds=60):
    @F.udf("string")
    def wait(x):
        import time

        time.sleep(seconds / 100)
        return "t"

    lines = spark.range(400).repartition(4).select(F.col("id").alias("n"), F.lit("crop").alias("crop"), F.lit("good").alias("bucket"), F.lit(False).alias("diverged"), wait("id").alias("text"), F.lit(1).alias("w"), F.lit(1).alias("h"))
    return Plan(RunRequest(output_dir=str(path)), lines)


def in_thread(work):
    out = {}

    def run():
        try:
            out["got"] = work()
        except Exception as e:
            out["error"] = e

    thread = threading.Thread(target=run)
    thread.start()
    return thread, out


def until(holds, seconds=60):
    end = time.monotonic() + seconds
    while not holds():
        assert time.monotonic() < end
        time.sleep(0.05)


def test_cancel_stops_a_running_job_and_a_second_run_is_refused(spark, tmp_path):
    thread, out = in_thread(lambda: jobs.run(spark, slow_plan(spark, tmp_path), "long-job").first())
    until(lambda: jobs.jobs(spark).get("long-job") == "running" and spark.sparkContext.statusTracker().getActiveJobsIds())
    with pytest.raises(RunActive, match="long-job"):
        jobs.run(spark, slow_plan(spark, tmp_path), "second")
    assert jobs.status(spark, str(tmp_path)).first().status == "running"
    began = time.monotonic()
    jobs.cancel(spark, "long-job")
    thread.join(30)
    assert not thread.is_alive() and time.monotonic() - began < 20
    assert out["got"].status == "cancelled" and out["got"].error is None
    assert jobs.status(spark, str(tmp_path)).first().status == "cancelled"
    with pytest.raises(RuntimeError):
        jobs.cancel(spark, "long-job")
    lease = Lease(spark, str(tmp_path), "third")  # the folder is free again
    lease.end()


def test_stale_run_cannot_write_past_its_successor(spark, tmp_path):
    first = Lease(spark, str(tmp_path), "first", patience=0.5)
    first.held()
    with pytest.raises(RunActive, match="first"):
        Lease(spark, str(tmp_path), "second", patience=60)
    time.sleep(0.6)
    second = Lease(spark, str(tmp_path), "second", patience=0.5)
    assert second.number == first.number + 1
    with pytest.raises(RunActive, match="taken over"):
        first.held()
    second.held()
    second.end()


def test_only_one_of_many_takes_a_folder(spark, tmp_path):
    got, threads = [], []

    def take(k):
        try:
            got.append(Lease(spark, str(tmp_path), f"job {k}").job)
        except RunActive:
            pass

    for k in range(6):
        threads.append(threading.Thread(target=take, args=(k,)))
        threads[-1].start()
    for t in threads:
        t.join()
    assert len(got) == 1


def test_registry_keeps_the_newest_finished_jobs(spark):
    rows = spark.createDataFrame([(f"done-{i}", i, "done") for i in range(4)] + [("old", -1, "running")], "job string, started int, status string")
    assert sorted(r.job for r in progress.registry(rows, most=2).collect()) == ["done-2", "done-3", "old"]


def test_published_values_are_never_missing(spark, tmp_path):
    folder, seen, stop = str(tmp_path / "value"), [], threading.Event()
    storage.publish(spark, folder, {"n": 0})

    def read():
        while not stop.is_set():
            seen.append(storage.latest(spark, folder)["n"])

    thread, out = in_thread(read)
    for n in range(1, 60):
        storage.publish(spark, folder, {"n": n})
    stop.set()
    thread.join()
    assert "error" not in out and seen == sorted(seen) and storage.latest(spark, folder) == {"n": 59}
    assert len(storage.names(spark, folder)) == storage.VERSIONS


# --- passes -----------------------------------------------------------------------------------------------------------------


def engine(name, calls, path, fail_after=None):
    """Boxes that all engines agree on, a line a page; notes each page it is called for."""

    def boxes(pages):
        calls.extend((name, r.page) for r in pages.select("page").collect())
        if fail_after is not None and len([c for c in calls if c[0] == name]) > fail_after:
            raise OSError("disk full")
        return pages.select("doc_ord", "page", F.lit(0).alias("idx"), *[F.lit(float(v)).alias(c) for c, v in (("x0", 1), ("y0", 1), ("x1", 90), ("y1", 40))], F.concat(F.lit("line "), "page").alias("text"))

    return boxes


def some_pages(spark, n=12):
    return spark.range(n).select(F.lit(1).cast("long").alias("doc_ord"), F.col("id").cast("int").alias("page"), F.lit(200).alias("width"), F.lit(100).alias("height"))


def vlm_request(path):
    return RunRequest(mode="vlm", vlm_engines=["hunyuan_ocr", "glm_ocr"], vlm_min_agree=2, output_dir=str(path))


def test_run_that_was_stopped_goes_on_where_it_was(spark, tmp_path):
    calls, pages = [], some_pages(spark)
    engines = {"hunyuan_ocr": engine("a", calls, tmp_path), "glm_ocr": engine("b", calls, tmp_path, fail_after=5)}
    with pytest.raises(OSError):
        run_passes(spark, vlm_request(tmp_path / "run"), engines, pages, "half", parts=4)
    assert jobs.status(spark, str(tmp_path / "run")).first().status == "error"
    half = {c for c in calls if c[0] == "b"}
    finished = {r.page for r in Ledger(spark, f"{tmp_path}/run/passes").finished("glm_ocr").collect()}
    assert 0 < len(finished) < 12 and {("b", p) for p in finished} <= half
    calls.clear()
    engines["glm_ocr"] = engine("b", calls, tmp_path)
    assert tuple(run_passes(spark, vlm_request(tmp_path / "run"), engines, pages, "again", parts=4).first()) == ("done", None, 12, 0, 0, 0)
    assert sorted(calls) == sorted(("b", p) for p in range(12) if p not in finished)
    calls.clear()
    engines = {"hunyuan_ocr": engine("a", calls, tmp_path), "glm_ocr": engine("b", calls, tmp_path)}
    run_passes(spark, vlm_request(tmp_path / "whole"), engines, pages, "whole", parts=4)
    assert texts(tmp_path / "run/lines/bucket=good") == texts(tmp_path / "whole/lines/bucket=good") and len(calls) == 24


def test_cancelled_run_keeps_the_lines_of_the_first_pass(spark, tmp_path):
    entered = threading.Event()

    def stuck(pages):
        @F.udf("string")
        def wait(x):
            import time

            time.sleep(60)
            return "t"

        entered.set()
        return engine("b", [], tmp_path)(pages).withColumn("text", wait("text"))

    engines = {"hunyuan_ocr": engine("a", [], tmp_path), "glm_ocr": stuck}
    thread, out = in_thread(lambda: run_passes(spark, vlm_request(tmp_path), engines, some_pages(spark), "passes", parts=2).first())
    assert entered.wait(60)
    until(lambda: spark.sparkContext.statusTracker().getActiveJobsIds())
    jobs.cancel(spark, "passes")
    thread.join(60)
    assert tuple(out["got"]) == ("cancelled", None, 0, 12, 0, 0)
    lines = texts(tmp_path / "lines/bucket=needs_review")
    assert len(lines) == 12 and lines[0].split("\t")[1].startswith("line ")


def test_uncommitted_parts_are_never_read(spark, tmp_path):
    ledger, pages = Ledger(spark, str(tmp_path)), some_pages(spark, 2)
    boxes = engine("a", [], tmp_path)(pages).withColumn("engine", F.lit("a"))

    def stop():
        raise jobs.Cancelled

    with pytest.raises(jobs.Cancelled):
        ledger.commit("a", pages, boxes, stop)
    assert ledger.boxes().count() == 0 and ledger.finished("a").count() == 0
    ledger.commit("a", pages, boxes)
    assert ledger.boxes().count() == 2 and ledger.finished("a").count() == 2 and ledger.finished("b").count() == 0
    assert ledger.boxes().columns == [c.split()[0] for c in BOXES.split(", ")]


# --- streams ----------------------------------------------------------------------------------------------------------------


def line_stream(spark, path, files):
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, "doc long, line long, text string").coalesce(1).write.parquet(f"{path}/f{k}")
        time.sleep(0.01)
    return spark.readStream.schema("doc long, line long, text string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(path))


def test_stream_writes_while_it_goes_on_and_numbers_follow(spark, tmp_path):
    stream = line_stream(spark, tmp_path / "in", [[(2, k, f"t{k}") for k in range(5)], [(1, k, f"s{k}") for k in range(7)], []])
    streamed.run_stream(stream, str(tmp_path / "out"), ["doc", "line"], 100).awaitTermination()
    rows = streamed.lines_so_far(spark, str(tmp_path / "out")).orderBy("n").collect()
    assert [r.n for r in rows] == list(range(100, 112)) and [r.text for r in rows] == [f"t{k}" for k in range(5)] + [f"s{k}" for k in range(7)]
    assert rows[0].crop == "crops/0/image_00100.webp"
    # More files come: the run goes on with the next number.
    spark.createDataFrame([(3, 0, "u")], "doc long, line long, text string").write.parquet(str(tmp_path / "in/f9"))
    again = spark.readStream.schema("doc long, line long, text string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streamed.run_stream(again, str(tmp_path / "out"), ["doc", "line"], 100).awaitTermination()
    assert streamed.lines_so_far(spark, str(tmp_path / "out")).filter("n = 112").first().text == "u"


def test_batch_that_is_run_again_writes_nothing_twice(spark, tmp_path):
    out, rows = str(tmp_path), spark.createDataFrame([(1, k) for k in range(4)], "doc int, line int")

    def crash():
        raise OSError("lost")

    with pytest.raises(OSError):
        streamed.write_batch(rows, 0, out, ["doc", "line"], go_on=crash)  # files are there, but no commit
    assert streamed.lines_so_far(spark, out) is None
    first = streamed.write_batch(rows, 0, out, ["doc", "line"])
    assert (first["first"], first["next"]) == (1, 5) and streamed.write_batch(rows, 0, out, ["doc", "line"]) == first
    assert streamed.write_batch(rows.filter("line < 2"), 1, out, ["doc", "line"])["first"] == 5
    assert sorted(r.n for r in streamed.lines_so_far(spark, out).collect()) == list(range(1, 7))


LOG = "job_id int, seq int, kind string, bucket string, diverged boolean, msg string, ts timestamp"


def log_stream(spark, path):
    return spark.readStream.schema(LOG).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(path))


def write_log(spark, path, repeats=2):
    rows = [(j, s, "error" if s % 3 == 0 else "line", "good" if s % 2 else "needs_review", s % 5 == 0, f"m{s}") for j in (1, 2) for s in range(80)]
    log = spark.createDataFrame(rows, LOG.rpartition(",")[0]).withColumn("ts", F.timestamp_seconds(F.lit(1.7e9) + F.col("seq")))
    for k in range(4):
        part = log.filter(f"seq % 4 = {k}")
        for r in range(repeats):
            part.coalesce(1).write.parquet(f"{path}/{k}-{r}")
    return log


def test_events_that_come_twice_count_once(spark, tmp_path):
    log = write_log(spark, tmp_path)
    got = live.run_available(live.rollup_stream(live.once(log_stream(spark, tmp_path))))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, progress.rollup(log).collect()))


def test_reader_always_finds_a_whole_snapshot(spark, tmp_path):
    write_log(spark, tmp_path / "log", 1)
    path, seen, stop = str(tmp_path / "snapshot"), [], threading.Event()
    assert live.snapshot(spark, path) is None

    def read():
        while not stop.is_set():
            now = live.snapshot(spark, path, "job_id int, error_count long")
            if now is not None:
                seen.append((now.count(), now.agg(F.sum("error_count")).first()[0]))

    thread, out = in_thread(read)
    live.snapshots(log_stream(spark, tmp_path / "log"), path, str(tmp_path / "cp")).awaitTermination()
    stop.set()
    thread.join()
    assert "error" not in out and seen and all(n == 2 and errors for n, errors in seen)
    assert live.snapshot(spark, path).agg(F.sum("error_count")).first()[0] == 54


def test_breaker_switches_off_what_follows_over_batches(spark, tmp_path):
    out = [1, 0, 1, 1] + [1, 0, 1, 1, 0, 0]  # the streak is filled by the first call of the second batch
    for k, part in enumerate((range(4), range(4, 10))):
        spark.createDataFrame([(7, e, s, e == "slow" and out[s] == 1) for s in part for e in ("slow", "fast")], "job int, engine string, seq long, timed_out boolean").repartition(3).coalesce(1).write.parquet(f"{tmp_path}/{k}")
        time.sleep(0.01)
    calls = spark.readStream.schema("job int, engine string, seq long, timed_out boolean").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = {(r.engine, r.seq): (r.off, r.broken_at) for r in live.collected(live.breaker_stream(calls, "job")).collect()}
    assert [got["slow", s] for s in (3, 4, 5, 9)] == [(False, None), (False, 4), (True, 4), (True, 4)]
    assert all(got["fast", s] == (False, None) for s in range(10))


# --- saved versions -------------------------------------------------------------------------------------------------------


def test_saves_keep_the_newest_backups_and_can_be_restored(spark, tmp_path):
    path = str(tmp_path / "labels")
    now = lambda: sorted(r.value for r in spark.read.text(path).collect())
    for k in range(8):
        backup.save(spark, path, lambda to: spark.createDataFrame([(f"version {k}",)], "value string").write.text(to), "edit" if k else "manual")  # noqa: B023
    have = backup.backups(spark, path)
    assert now() == ["version 7"] and len(have) == backup.KEEP and {b["operation"] for b in have} == {"edit"}
    read = lambda b: spark.read.text(f"{path}.backups/{b['file']}").first().value
    assert [read(b) for b in have] == [f"version {k}" for k in (6, 5, 4, 3, 2)]
    assert len([p for p in (tmp_path / "labels.backups").iterdir() if p.name != "index"]) == backup.KEEP
    assert backup.restore(spark, path, have[2]["file"]) and now() == ["version 4"]
    assert [read(b) for b in backup.backups(spark, path)] == [f"version {k}" for k in (7, 6, 5, 3, 2)]
    assert not backup.restore(spark, path, "no such backup") and now() == ["version 4"]


def test_save_that_fails_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "labels")
    backup.save(spark, path, lambda to: spark.createDataFrame([("old",)], "value string").write.text(to))

    def broken(to):
        spark.createDataFrame([("half",)], "value string").write.text(to)
        raise OSError("disk full")

    with pytest.raises(OSError):
        backup.save(spark, path, broken)
    # A new version may be made from the old one.
    backup.save(spark, path, lambda to: spark.read.text(path).selectExpr("concat(value, '+') as value").write.text(to))
    assert spark.read.text(path).first().value == "old+" and len(backup.backups(spark, path)) == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["labels", "labels.backups"]


def test_record_whose_file_cannot_be_removed_stays(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.webp").write_text("x")
    recs = spark.createDataFrame([(f"{k}.webp", str(tmp_path / f"{k}.webp"), "t") for k in range(4)], "name string, path string, text string")

    def remove(path):
        import os

        os.remove(path)

    left, bad = delete_with_files(recs, spark.createDataFrame([("1.webp",), ("3.webp",)], "name string"), remove)
    assert sorted(r.name for r in left.collect()) == ["0.webp", "2.webp", "3.webp"] and left.columns == recs.columns
    assert [r.path.endswith("3.webp") for r in bad.collect()] == [True] and sorted(p.name for p in tmp_path.glob("*.webp")) == ["0.webp", "2.webp"]
