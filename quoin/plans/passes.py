"""Passes of engines over the pages of a run, with a ledger of what is finished.

An engine goes over the pages in parts. A part's boxes and its list of pages are written to a folder of their own and count
from the moment the ledger names them, by a file that appears whole; what a stopped or failed task has left behind is never
read. Pages in the ledger are left out before an engine is called again, so a run that was stopped goes on where it was, and
what was finished before a cancel is resolved all the same: lines that lack agreement go to review.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin import storage
from quoin.plans import jobs
from quoin.plans.lease import PATIENCE
from quoin.plans.request import RunRequest
from quoin.plans.run import PAGE, plan_vlm
from quoin.sources.files import literal

BOXES = "doc_ord long, page int, engine string, idx int, x0 double, y0 double, x1 double, y1 double, text string"
FINISHED = "doc_ord long, page int"


class Ledger:
    """What engines have finished, below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def commit(self, engine: str, pages: DataFrame, boxes: DataFrame, go_on: Callable[[], None] = lambda: None) -> None:
        """Boxes (BOXES) of the pages (doc_ord, page) by an engine; `go_on` is asked last, and raises if they may not count."""
        part = uuid.uuid4().hex
        boxes.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in BOXES.split(", ")]).write.parquet(f"{self.path}/parts/{part}/boxes")
        pages.select(F.col("doc_ord").cast("long"), F.col("page").cast("int")).write.parquet(f"{self.path}/parts/{part}/pages")
        go_on()
        storage.put_whole(self.spark, f"{self.path}/ledger/{part}.json", json.dumps({"engine": engine, "part": part}))

    def entries(self) -> list[dict]:
        return [json.loads(storage.read_text(self.spark, f"{self.path}/ledger/{n}")) for n in storage.names(self.spark, f"{self.path}/ledger")]

    def _parts(self, kind: str, schema: str, engine: str | None = None) -> DataFrame:
        paths = [f"{literal(self.path)}/parts/{e['part']}/{kind}" for e in self.entries() if engine in (None, e["engine"])]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def boxes(self) -> DataFrame:
        return self._parts("boxes", BOXES)

    def finished(self, engine: str) -> DataFrame:
        return self._parts("pages", FINISHED, engine)


def finished_boxes(boxes: DataFrame, finished: DataFrame) -> DataFrame:
    """The boxes (BOXES) of engines whose pass over the page is among the finished ones (engine, doc_ord, page)."""
    return boxes.join(finished.select("engine", *PAGE).distinct(), ["engine", *PAGE], "left_semi").select(*boxes.columns)


#: An engine as a pass: boxes (BOXES without engine) of the given pages.
Engine = Callable[[DataFrame], DataFrame]


def run_passes(spark: SparkSession, request: RunRequest, engines: dict[str, Engine], pages: DataFrame, job: str, parts: int = 8, alphabet: list[str] | None = None, start: int = 1, patience: float = PATIENCE) -> DataFrame:
    """Lets the request's engines go over pages (doc_ord, page, width, height, and what engines need), one after another and
    in `parts` by hash, and writes the lines. Gives the job's status. A cancelled job writes the lines of the passes that were
    committed; run once more, it calls the engines for the other pages only."""
    own = jobs.Job(spark, job, request.output_dir, patience)
    ledger = Ledger(spark, f"{request.output_dir}/passes")
    part = F.pmod(F.xxhash64(*PAGE), F.lit(parts))
    counts: dict = {}

    def passes() -> None:
        for engine in request.vlm_engines:
            todo = pages.join(ledger.finished(engine), PAGE, "left_anti")
            for k in range(parts):
                own.go_on()
                some = todo.filter(part == k)
                if some.limit(1).count():
                    ledger.commit(engine, some, engines[engine](some).withColumn("engine", F.lit(engine)), own.go_on)
        lines()

    def lines() -> dict:
        """Writes the lines of what the ledger has. Their owner is asked once more, but not whether the job is to stop."""
        own.lease.held()
        plan = plan_vlm(request, ledger.boxes(), F.col("width"), F.col("height"), alphabet, start, pages)
        plan.write(own.lease.held)
        counts.update(jobs.totals(plan))
        return counts

    return jobs.finish(own, passes, lambda: counts, lines)
