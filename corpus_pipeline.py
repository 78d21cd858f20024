"""A corpus pipeline of training-data operators: filter, deduplicate, redact, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's docs; all but the last keep the columns of documents. No stage but mixing repeats a row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import hostrules, mixing, nearcopies, pieces, secrets
from paperloom.llm.common import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host fails as a whole, go."""
    return hostrules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of their five-word shingles or more) stays, the one with the smallest id."""
    return nearcopies.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; n_chars follows. Every document stays."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each row."""
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixed_sources", mixed_sources),
    ("encoded", encoded),
]
#: XXH64 and byte-pair merges have no DuckDB form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    place = f"{shared_folder(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{i}_{name}")
        docs = spark.read.parquet(f"{place}/{i}_{name}")
    return docs
