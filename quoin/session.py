"""Session settings, and shipping the package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "quoin", **conf: str) -> SparkSession:
    """A session with this package's settings; master, memory and partitions are the caller's."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers of the session, once; needed by functions that run in them."""
    context = spark.sparkContext
    if getattr(context, "_quoin_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="quoin-")), "quoin.zip")
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    context.addPyFile(path)
    context._quoin_shipped = True
