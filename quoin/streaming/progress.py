"""Live progress: the rollup of an event log as a streaming aggregation, and the bounded ring of messages as state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from heapq import nlargest

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from quoin import storage
from quoin.operators.progress import MAX_ERRORS, STREAK, counters
from quoin.scratch import session_dir
from quoin.sources.files import literal


def once(log: DataFrame, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """log without events that are delivered again, up to `late` after the first time: an event is (job_id, seq)."""
    return log.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(["job_id", "seq"])


def rollup_stream(log: DataFrame) -> DataFrame:
    """Streaming twin of operators.progress.rollup; for output mode complete or update."""
    return log.groupBy("job_id").agg(*counters())


def run_available(stream: DataFrame, key: str | None = None) -> DataFrame:
    """All that is there now, taken in by one run; the last state as a table in the shared folder. Without key each batch
    gives the whole state (output mode complete); with it, the rows that changed (update), and the last row of a key
    counts."""
    spark, path = stream.sparkSession, f"{session_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/out/batch={batch}" if key else f"{path}/out")

    query = stream.writeStream.outputMode("update" if key else "complete").foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if not key:
        return spark.read.schema(stream.schema).parquet(f"{path}/out")
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{path}/out")
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in stream.columns if c != key]), "batch").alias("_last")).select(key, "_last.*")


def error_ring(log: DataFrame, most: int = MAX_ERRORS) -> DataFrame:
    """job_id, error_count, errors: after each batch the number of errors so far and the `most` messages of greatest seq,
    in order, whatever the order in which they came."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, seqs, messages = state.get if state.exists else (0, [], [])
        kept = list(zip(seqs, messages, strict=True))
        for b in batches:
            b = b[b.kind == "error"]
            count += len(b)
            kept = nlargest(most, [*kept, *zip(b.seq.tolist(), b.msg.tolist(), strict=True)], key=lambda e: e[0])
        kept = kept[::-1]
        state.update((count, [s for s, _ in kept], [m for _, m in kept]))
        yield pd.DataFrame({"job_id": [key[0]], "error_count": [count], "errors": [[m for _, m in kept]]})

    return log.groupBy("job_id").applyInPandasWithState(update, "job_id long, error_count long, errors array<string>", "n long, seqs array<long>, errors array<string>", "update", GroupStateTimeout.NoTimeout)


def breaker_stream(calls: DataFrame, run: str, streak: int = STREAK) -> DataFrame:
    """calls (run, engine, seq, timed_out) as they come: run, engine, seq, off (the engine was switched off by an earlier call,
    so this one should not have been made), broken_at (the call that filled the first streak of time-outs, once it is known).
    The streak is state of (run, engine); within a batch calls count in the order of seq, over batches as they come."""
    kind = calls.schema[run].dataType.simpleString()

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, broken = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values("seq")
        off, at = [], []
        for seq, out in zip(rows.seq.tolist(), rows.timed_out.tolist(), strict=True):
            off.append(broken is not None)
            n = n + 1 if out else 0
            if broken is None and n == streak:
                broken = seq
            at.append(broken)
        state.update((n, broken))
        yield pd.DataFrame({run: key[0], "engine": key[1], "seq": rows.seq.to_numpy(), "off": off, "broken_at": pd.array(at, "Int64")})

    schema = f"{run} {kind}, engine string, seq long, off boolean, broken_at long"
    return calls.select(run, "engine", "seq", "timed_out").groupBy(run, "engine").applyInPandasWithState(update, schema, "n long, broken long", "append", GroupStateTimeout.NoTimeout)


def collected(stream: DataFrame) -> DataFrame:
    """All rows that an appending stream gives for what is there now, in the shared folder; each batch counts once, also if it
    is run again."""
    spark, path = stream.sparkSession, f"{session_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def snapshots(log: DataFrame, path: str, checkpoint: str):
    """Keeps a snapshot of the rollup below path, one for each batch. A snapshot is a folder of its own, and readers are sent
    to it once it is complete; the one before stays until the next is there."""
    spark = log.sparkSession

    def write(df: DataFrame, batch: int) -> None:
        before = storage.latest(spark, f"{path}/current")
        own = uuid.uuid4().hex
        df.write.json(f"{path}/{own}")
        storage.publish(spark, f"{path}/current", {"folder": own, "before": before and before["folder"], "batch": batch})
        if before and before["before"]:
            storage.delete(spark, f"{path}/{before['before']}")

    return rollup_stream(log).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The newest snapshot below path, or None before the first."""
    now = storage.latest(spark, f"{path}/current")
    if now is None:
        return None
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(f"{literal(path)}/{now['folder']}")
