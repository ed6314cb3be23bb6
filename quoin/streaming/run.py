"""A labelling run over a stream of documents: each micro-batch writes its lines while the run goes on, exactly once.

A batch's files and the number that follows its lines are committed together, by one small file that bears the batch's number
and appears whole. A batch that is run again after a failure finds its commit and writes nothing, and files without a commit
are never read; so lines have gapless numbers and none is there twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin import storage
from quoin.operators.numbering import crop_path, number_rows
from quoin.sources.files import literal


def commits(spark: SparkSession, output_dir: str) -> list[dict]:
    """The committed batches in order: batch, folder, first (number), next (number)."""
    folder = f"{output_dir}/commits"
    return [json.loads(storage.read_text(spark, f"{folder}/{n}")) for n in storage.names(spark, folder)]


def write_batch(rows: DataFrame, batch: int, output_dir: str, order: list[str], start: int = 1, go_on: Callable[[], None] = lambda: None) -> dict:
    """Writes the rows of a batch with n, in `order` (which tells them apart) and from where the last batch ended, and crop;
    gives its commit. A batch that has one is not written again. `go_on` is asked before the commit."""
    spark = rows.sparkSession
    done = commits(spark, output_dir)
    again = [c for c in done if c["batch"] == batch]
    if again:
        return again[0]
    first = done[-1]["next"] if done else start
    numbered = number_rows(rows, order, first).withColumn("crop", crop_path(F.col("n")))
    folder = f"lines/batch-{batch}-{uuid.uuid4().hex}"
    numbered.write.parquet(f"{output_dir}/{folder}")
    n = spark.read.parquet(f"{literal(output_dir)}/{folder}").count()
    commit = {"batch": batch, "folder": folder, "first": first, "next": first + n}
    go_on()
    storage.put_whole(spark, f"{output_dir}/commits/{batch:012d}.json", json.dumps(commit))
    return commit


def run_stream(stream: DataFrame, output_dir: str, order: list[str], start: int = 1, go_on: Callable[[], None] = lambda: None):
    """Takes in all that the stream has now, batch by batch; gives the query, which has started. The same output_dir goes on
    where it was."""
    query = stream.writeStream.foreachBatch(lambda df, batch: write_batch(df, batch, output_dir, order, start, go_on) and None)
    return query.option("checkpointLocation", f"{output_dir}/checkpoint").trigger(availableNow=True).start()


def lines_so_far(spark: SparkSession, output_dir: str) -> DataFrame | None:
    """All committed lines, also while the run goes on; None before the first batch."""
    done = commits(spark, output_dir)
    return spark.read.parquet(*[f"{literal(output_dir)}/{c['folder']}" for c in done]) if done else None
