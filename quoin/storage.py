"""Small files of the driver in the folder of a run: written whole or not at all, never over one another.

A file gets its name by a rename once it is complete, or by a create that fails if the name is taken; nothing is replaced in
place, so readers see a whole file or none, in a local folder as in a distributed store.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

#: How many versions of a published value stay, so that a reader who has just listed them still finds its own.
VERSIONS = 3


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    where, files = _files(spark, path)
    out = files.create(where, False)
    out.write(bytearray(text.encode()))
    out.close()


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Whether this call made the file: false if it is there already, so that a name can be had only once. A reader may find
    it still empty."""
    where, files = _files(spark, path)
    try:
        _put(spark, path, text)
    except Exception:
        if files.exists(where):
            return False
        raise
    return True


def put_whole(spark: SparkSession, path: str, text: str) -> None:
    """A file that appears complete."""
    where, files = _files(spark, path)
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    _put(spark, beside, text)
    if not files.rename(_files(spark, beside)[0], where):
        raise OSError(f"{path} can't be written")


def modified(spark: SparkSession, path: str) -> float:
    """When a file was written, in seconds."""
    where, files = _files(spark, path)
    return files.getFileStatus(where).getModificationTime() / 1000


def read_text(spark: SparkSession, path: str) -> str | None:
    where, files = _files(spark, path)
    if not files.exists(where):
        return None
    source = files.open(where)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the complete files of a folder, sorted; none if there is no such folder."""
    where, files = _files(spark, folder)
    if not files.exists(where):
        return []
    return sorted(n for n in (s.getPath().getName() for s in files.listStatus(where)) if not n.endswith((".tmp", ".crc")))


def is_folder(spark: SparkSession, path: str) -> bool:
    where, files = _files(spark, path)
    return files.exists(where) and files.getFileStatus(where).isDirectory()


def move(spark: SparkSession, path: str, to: str) -> None:
    """Renames a file or a folder to a name that is free."""
    where, files = _files(spark, path)
    target = _files(spark, to)[0]
    files.mkdirs(target.getParent())
    if files.exists(target) or not files.rename(where, target):
        raise OSError(f"{path} can't be moved to {to}")


def delete(spark: SparkSession, path: str) -> None:
    where, files = _files(spark, path)
    files.delete(where, True)


def publish(spark: SparkSession, folder: str, value: dict) -> None:
    """A new version of a value, by its one writer. The versions before stay for a while."""
    have = names(spark, folder)
    name = f"{folder}/{int(have[-1].partition('.')[0]) + 1 if have else 0:012d}.json"
    put_whole(spark, name, json.dumps(value, ensure_ascii=False))
    for old in have[: -(VERSIONS - 1)]:
        delete(spark, f"{folder}/{old}")


def latest(spark: SparkSession, folder: str) -> dict | None:
    """The newest version of a published value."""
    for _ in range(10):
        have = names(spark, folder)
        if not have:
            return None
        text = read_text(spark, f"{folder}/{have[-1]}")
        if text is not None:
            return json.loads(text)
    raise TimeoutError(f"{folder} changes faster than it can be read")
