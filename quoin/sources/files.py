"""File sources: input folders, label files, alphabets, debug and status files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.functions.text import strip
from quoin.operators.numbering import number_rows

# Extensions of input files.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp"]
PDF_EXTENSIONS = [".pdf"]
#: More characters than this are none of an alphabet, and are not brought to the driver.
MAX_CHARACTERS = 1 << 17
DEBUG = "crop string, bucket string, engine string, diverged boolean, engines map<string,struct<text:string,score:double>>, _bad string"


def literal(path: str) -> str:
    """A path in which glob characters stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def classify(files: DataFrame, path: str = "path") -> DataFrame:
    """files with kind (image or pdf) and doc_ord: images by path, then PDFs by path; other files fall away."""
    ext = F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))
    kind = F.when(ext.isin(IMAGE_EXTENSIONS), "image").when(ext.isin(PDF_EXTENSIONS), "pdf")
    return number_rows(files.withColumn("kind", kind).filter("kind is not null"), ["kind", path], 1, "doc_ord")


def list_inputs(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length, kind, doc_ord of the files directly in folder; contents are not read."""
    files = spark.read.format("binaryFile").load(literal(folder)).select("path", "modificationTime", "length")
    return classify(files)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """As list_inputs, with content."""
    return classify(spark.read.format("binaryFile").load(literal(folder)))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): the lines of a text file in order. ord is increasing, not consecutive."""
    return spark.read.text(literal(path)).withColumn("ord", F.monotonically_increasing_id())


def read_alphabet(spark: SparkSession, path: str) -> list[str]:
    """One character a line; blank lines count for nothing, the space always belongs to it."""
    rows = spark.read.text(literal(path)).select(F.regexp_replace("value", r"[\r\n]+$", "").alias("c")).filter("c <> ''").distinct()
    chars = [r.c for r in rows.orderBy("c").limit(MAX_CHARACTERS + 1).collect()]
    if len(chars) > MAX_CHARACTERS:
        raise ValueError(f"{path}: more than {MAX_CHARACTERS} characters")
    wrong = [c for c in chars if len(c) != 1]
    if wrong or not chars:
        raise ValueError(f"{path}: one character a line is needed, found {wrong[:5] or 'none'}")
    return sorted({*chars, " "})


def upload_name(name: Column) -> Column:
    """The bare name of an uploaded label file, without any folder; null unless it is that of a text file."""
    bare = F.regexp_extract(name, r"[^/\\]*$", 0)
    return F.when(F.lower(bare).rlike(r"^[^.].*\.txt$"), bare)


def parse_debug(lines: DataFrame) -> DataFrame:
    """Debug records from (ord, value). Reading ends at the first line that isn't JSON; what came before stays."""
    rows = lines.filter(strip(F.col("value")) != "").withColumn("r", F.from_json("value", DEBUG, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = rows.filter("r._bad is not null or r is null").agg(F.min("ord").alias("_stop"))
    kept = rows.join(F.broadcast(bad), F.col("_stop").isNull() | (F.col("ord") < F.col("_stop")))  # one row
    return kept.select("ord", "r.*").drop("_bad").filter(F.coalesce(F.col("crop"), F.lit("")) != "")


def parse_status(lines: DataFrame) -> DataFrame:
    """name: what the status file marks as done."""
    return lines.select(strip(F.col("value")).alias("name")).filter("name <> ''").distinct()


def parse_seen(lines: DataFrame, *keys: str) -> DataFrame:
    """The keys of records saved before, from JSON lines."""
    rows = lines.filter(strip(F.col("value")) != "").select(F.from_json("value", ", ".join(f"{k} string" for k in keys)).alias("r"))
    return rows.select("r.*")


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.lit(b"%PDF")


def decode_html(raw: Column) -> Column:
    """UTF-8, else the Cyrillic code page, which the JVM function doesn't offer; only such pages go to Python workers."""

    @F.pandas_udf("string")
    def legacy(data):
        return data.map(lambda b: None if b is None else bytes(b).decode("cp1251", "replace"))

    valid = F.is_valid_utf8(raw.cast("string"))
    return F.when(valid, raw.cast("string")).otherwise(legacy(F.when(~valid, raw)))
