"""Versions of a saved dataset: each save makes the one before a backup, the newest few of which stay.

A dataset is a folder that a job writes whole. Nothing is copied: the new version is written beside, the old one is renamed
to be the backup, and the list of backups is published as a file that readers always find whole. Backups count in the order
in which they were made, not by their clock.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from quoin import storage

#: How many backups stay. Fixed value.
KEEP = 5


def _folder(path: str) -> str:
    return f"{path.rstrip('/')}.backups"


def backups(spark: SparkSession, path: str) -> list[dict]:
    """The backups of a dataset, newest first: file, operation, at (seconds)."""
    index = storage.latest(spark, f"{_folder(path)}/index")
    return index["backups"][::-1] if index else []


def _set_aside(spark: SparkSession, path: str, operation: str, known: list[dict], keep: int) -> None:
    """Makes what is at path the newest backup, and lets the oldest go."""
    if storage.is_folder(spark, path):
        name = uuid.uuid4().hex
        storage.move(spark, path, f"{_folder(path)}/{name}")
        known = [*known, {"file": name, "operation": operation, "at": time.time()}]
    gone, known = known[: max(0, len(known) - keep)], known[max(0, len(known) - keep) :]
    storage.publish(spark, f"{_folder(path)}/index", {"backups": known})
    for old in gone:
        storage.delete(spark, f"{_folder(path)}/{old['file']}")


def save(spark: SparkSession, path: str, write: Callable[[str], None], operation: str = "manual", keep: int = KEEP) -> None:
    """write(folder) writes the new version; it may read the one at path, which becomes a backup once the new one is whole. If
    it fails, nothing has changed."""
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}.new"
    try:
        write(beside)
    except Exception:
        storage.delete(spark, beside)
        raise
    _set_aside(spark, path, operation, backups(spark, path)[::-1], keep)
    storage.move(spark, beside, path)


def restore(spark: SparkSession, path: str, name: str, keep: int = KEEP) -> bool:
    """Puts a backup in place again; what was there becomes a backup. False if there is no such backup."""
    known = backups(spark, path)[::-1]
    if name not in [b["file"] for b in known] or not storage.is_folder(spark, f"{_folder(path)}/{name}"):
        return False
    taken = f"{path.rstrip('/')}.{uuid.uuid4().hex}.new"
    storage.move(spark, f"{_folder(path)}/{name}", taken)
    _set_aside(spark, path, "restore", [b for b in known if b["file"] != name], keep)
    storage.move(spark, taken, path)
    return True
