"""Sinks of a labelling run: bucketed label files, debug and degradation records, crops, snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.functions.text import format_line
from quoin.scratch import stored


def dataset_lines(lines: DataFrame, with_size: bool = False) -> DataFrame:
    """lines (crop, text, w, h, ...) with value, a row of the label file."""
    none = F.lit(None).cast("int")
    return lines.withColumn("value", format_line(F.col("crop"), F.col("text"), F.col("w") if with_size else none, F.col("h") if with_size else none))


def write_buckets(lines: DataFrame, path: str, order: str = "n", with_size: bool = False) -> None:
    """Label rows under bucket=good and bucket=needs_review, replacing an earlier run; files follow each other in order."""
    rows = dataset_lines(lines, with_size).select("bucket", order, "value")
    rows.repartitionByRange("bucket", order).sortWithinPartitions("bucket", order).select("bucket", "value").write.mode("overwrite").partitionBy("bucket").text(path)


def write_json(rows: DataFrame, path: str, order: str, columns: list[str], mode: str = "overwrite") -> None:
    """JSON lines in order; nulls are written, since null is a value of its own here."""
    out = rows.repartitionByRange(order).sortWithinPartitions(order).select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))
    out.write.mode(mode).text(path)


def write_debug(voted: DataFrame, path: str, order: str = "n") -> None:
    """Records of voted lines with all readings."""
    engines = F.map_from_entries(F.transform("engines", lambda e: F.struct(e["engine"], F.struct(e["text"].alias("text"), e["score"].alias("score")))))
    write_json(voted.withColumn("engines", engines), path, order, ["crop", "bucket", "engine", "diverged", "engines"])


def write_degraded(lines: DataFrame, path: str, order: str = "n") -> None:
    """Which crop was taken, for lines of degraded pages; null means untouched."""
    write_json(lines.filter("page_degraded"), path, order, ["crop", "source", "degraded"])


def append_found(found: DataFrame, path: str, columns: list[str], order: str = "ord", images: str | None = None) -> None:
    """Appends records of new documents as JSON lines under path/documents and, with the column `images`, label lines without
    text for their pictures under path/rec."""
    write_json(found, f"{path}/documents", order, columns, "append")
    if images:
        rows = found.repartitionByRange(order).sortWithinPartitions(order)
        rows.select(F.concat(F.lit("images/"), F.col(images), F.lit("\t")).alias("value")).write.mode("append").text(f"{path}/rec")


def preview_rows(pages: DataFrame) -> DataFrame:
    """pages (file, page from 1, degraded boolean, ...) with image: the name of the preview picture of each page."""
    stem = F.regexp_replace(F.regexp_extract("file", r"[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    return pages.withColumn("image", F.format_string("%s_p%03d.webp", stem, F.col("page")))


def write_preview(pages: DataFrame, path: str, put: Callable[[str, dict], None] | None = None, pixels: str = "pixels") -> DataFrame | None:
    """A preview of degradation: a JSON line for each page (file, page, image, degraded), and with `put` the pictures
    themselves (column `pixels`) by save_crops, whose errors are given."""
    rows = preview_rows(pages)
    write_json(rows.withColumn("ord", F.struct("file", "page")), path, "ord", ["file", "page", "image", "degraded"])
    return save_crops(rows, put, pixels, "image") if put else None


def write_records(recs: DataFrame, path: str, order: str = "ord") -> None:
    """All records in their order, as a label file."""
    rows = recs.withColumn("value", format_line(F.col("path"), F.col("text"), F.col("w"), F.col("h")))
    rows.repartitionByRange(order).sortWithinPartitions(order).select("value").write.mode("overwrite").text(path)


def write_status(recs: DataFrame, path: str) -> None:
    """Names of marked records, sorted."""
    recs.filter("is_marked").select(F.col("name").alias("value")).distinct().orderBy("value").write.mode("overwrite").text(path)


def remove_files(paths: DataFrame, remove: Callable[[str], None], path: str = "path") -> DataFrame:
    """Calls remove(path) for each path where it lies; gives (path, error) of those that failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bad = []
            for p in b[path]:
                try:
                    remove(p)
                except Exception as e:  # one file never fails the run
                    bad.append((p, str(e)))
            yield pd.DataFrame(bad, columns=["path", "error"])

    return paths.select(path).mapInPandas(run, "path string, error string")


def delete_with_files(recs: DataFrame, names: DataFrame, remove: Callable[[str], None]) -> tuple[DataFrame, DataFrame]:
    """(recs without the named ones, errors by path): a record whose file can't be removed stays."""
    marked = recs.join(names.select("name").distinct(), "name", "left_semi")
    bad = stored(remove_files(marked, remove), "kept-files")
    gone = stored(marked.join(bad, "path", "left_anti").select("name"), "deleted")
    return recs.join(gone, "name", "left_anti").select(*recs.columns), bad


def save_crops(crops: DataFrame, put: Callable[[str, dict], None], image: str = "image", path: str = "crop") -> DataFrame:
    """Hands each image to put(path, image) where it lies; gives (path, error) of those that failed. Writing a path again
    replaces it, so a task that runs twice does no harm."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bad = []
            for p, im in zip(b[path], b[image], strict=True):
                try:
                    put(p, im)
                except Exception as e:  # one crop never fails the run
                    bad.append((p, str(e)))
            yield pd.DataFrame(bad, columns=["path", "error"])

    return crops.select(path, image).mapInPandas(run, "path string, error string")
