"""Progress of labelling jobs from their event log (job_id, seq, kind, bucket, diverged, msg)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many messages of a job stay.
MAX_ERRORS = 50
#: Time-outs in a row after which an engine is left out. Fixed value.
STREAK = 3
#: How many finished jobs stay in the registry. Fixed value.
MAX_FINISHED = 100
TERMINAL = ["error", "cancelled", "done"]


def counters() -> list[Column]:
    """Aggregates over a job's events; those of the batch and of the streaming rollup alike."""
    line = F.col("kind") == "line"
    return [
        F.coalesce(F.sum(F.when(F.col("kind") == "found", 1)), F.lit(0)).alias("docs_found"),
        F.coalesce(F.sum(F.when(F.col("kind") == "file_done", 1)), F.lit(0)).alias("docs_processed"),
        F.coalesce(F.sum(F.when(line & (F.col("bucket") == "good"), 1)), F.lit(0)).alias("good_count"),
        F.coalesce(F.sum(F.when(line & (F.col("bucket") == "needs_review"), 1)), F.lit(0)).alias("review_count"),
        F.coalesce(F.sum(F.when(line & F.col("diverged"), 1)), F.lit(0)).alias("diverged_count"),
        F.coalesce(F.sum(F.when(F.col("kind") == "error", 1)), F.lit(0)).alias("error_count"),
    ]


def rollup(log: DataFrame) -> DataFrame:
    return log.groupBy("job_id").agg(*counters())


def last_errors(log: DataFrame, n: int = MAX_ERRORS) -> DataFrame:
    """job_id, errors: the last n messages in order. Ranked before they are gathered, so a job never has more than n."""
    last = Window.partitionBy("job_id").orderBy(F.col("seq").desc())
    rows = log.filter("kind = 'error'").withColumn("_rn", F.row_number().over(last)).filter(F.col("_rn") <= n)
    return rows.groupBy("job_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "msg"))), lambda e: e["msg"]).alias("errors"))


def states(log: DataFrame) -> DataFrame:
    """job_id, status: error before cancelled before done, running without any."""
    rank = F.max(F.when(F.col("kind") == "failed", 3).when(F.col("kind") == "cancelled", 2).when(F.col("kind") == "done", 1).otherwise(0))
    return log.groupBy("job_id").agg(rank.alias("r")).select("job_id", F.element_at(F.array(*[F.lit(s) for s in ["running", "done", "cancelled", "error"]]), F.col("r") + 1).alias("status"))


def broken_engines(calls: DataFrame, *run: str, streak: int = STREAK) -> DataFrame:
    """calls (run.., engine, seq, timed_out): for each engine the call at which its first streak of time-outs is full;
    from there on the engine is left out of the run."""
    order = Window.partitionBy(*run, "engine").orderBy("seq")
    rows = calls.withColumn("_island", F.sum((~F.col("timed_out")).cast("int")).over(order))
    rows = rows.withColumn("_n", F.sum(F.col("timed_out").cast("int")).over(Window.partitionBy(*run, "engine", "_island").orderBy("seq")))
    return rows.filter(F.col("timed_out") & (F.col("_n") == streak)).groupBy(*run, "engine").agg(F.min("seq").alias("broken_at"))


def registry(jobs: DataFrame, started: str = "started", most: int = MAX_FINISHED) -> DataFrame:
    """jobs (status, `started` tells them apart and orders them, ...): all that run, and the newest `most` that have ended."""
    ended = F.col("status").isin(TERMINAL)
    return jobs.filter(~ended).unionByName(jobs.filter(ended).orderBy(F.col(started).desc()).limit(most))
