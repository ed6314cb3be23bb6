"""Corpus pipeline: an English corpus without near-duplicates and benchmark passages, mixed and sharded. Each stage is
written and reread as the next one's docs; a stage's table goes once the next one is written.

Defined cases, on top of those of the operators: a null or letterless text is rejected by language ID, and so is one in
another language than LANGUAGES (all stay if nothing is labelled); of each group of near-duplicates one row stays, repeated
rows and null identifiers included; an empty table gives an empty result; further columns are carried through to the end,
but for `shard` and `slot`, which the last stage writes anew; very long texts are read whole by every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quoin.llm.decontaminate import clean_documents
from quoin.llm.language_id import known_language
from quoin.llm.mixing import mixed_rows
from quoin.llm.sharding import sharded
from quoin.llm.simhash import keep_first
from quoin.scratch import drop, stored

#: The languages that the corpus is to have.
LANGUAGES = ("en",)


#: Fingerprints of a text, over its different pairs of words: with one alone, half of the texts that differ in a few words of
#: a hundred are missed.
SKETCHES = 3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return known_language(docs, LANGUAGES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs, shingle=2, sketches=SKETCHES)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharded(docs)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: The trained network and the seeded draws have no SQL form; tests/llm compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0])
        if done is not None:
            drop(done)
        done = docs
    return docs
