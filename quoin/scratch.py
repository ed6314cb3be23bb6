"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Options for tables of many files. In a local folder they are written without checksum files: where its native library is missing,
#: Hadoop starts a process (chmod) in the executor for each file, each checksum file and each task's folder. Until it is loaded, such a
#: process shares the executor's memory, and a reading of memory counts all of it twice. Folders of other kinds are not affected.
FEW_PROCESSES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def scratch_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in a single-JVM session without one, a new temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """This session's own folder below scratch_dir."""
    context = spark.sparkContext
    if not hasattr(context, "_quoin_scratch"):
        context._quoin_scratch = f"{scratch_dir(spark)}/quoin-{uuid.uuid4().hex}"
    return context._quoin_scratch


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None, by: list[str] | None = None) -> DataFrame:
    """df written once as Parquet and read back: lineage ends here, and an executor lost later costs a reread only."""
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.options(**(options or {}))
    (writer.partitionBy(*by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def bucketed(df: DataFrame, name: str, buckets: int, key: str, by: str) -> DataFrame:
    """df written once as a table in `buckets` buckets of `key`, sorted by it, and a folder for each value of `by`; read back,
    such tables meet bucket by bucket, without a shuffle. Its name in the session's catalogue goes with clear()."""
    spark, table = df.sparkSession, f"quoin_{uuid.uuid4().hex}"
    path = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).partitionBy(by).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    spark.sparkContext._quoin_tables = [*getattr(spark.sparkContext, "_quoin_tables", []), table]
    return spark.table(table)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    _delete(df.sparkSession, df._scratch)


def clear(spark: SparkSession) -> None:
    """Deletes all that the session has stored, once its results have been written."""
    if hasattr(spark.sparkContext, "_quoin_scratch"):
        for table in getattr(spark.sparkContext, "_quoin_tables", []):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.sparkContext._quoin_tables = []
        _delete(spark, spark.sparkContext._quoin_scratch)
