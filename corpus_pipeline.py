"""Documents to packed windows: language ID, near-dedup, benchmark decontamination, secret masking, packing.

Every stage takes all rows that the one before it wrote.  Rows that are null in a column, empty texts, repeated rows and further columns are
treated as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import bag_minhash, decontaminate, language_id, packing, secrets
from cairn.llm.common import Written, tuned


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return language_id.keep_known(docs)


def without_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return bag_minhash.remove(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no test item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secrets.redact(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in windows."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", known_language),
    ("near-dedup", without_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", windows),
]

#: Networks, sketches and dynamic programming: the tests compare the stages with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of the table documents; what a stage gives is written as Parquet beside the checkpoints and read by the next."""
    tables = Written(tuned(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = tables.write(stage(spark, docs, sf_dir), str(k))
        if k > 1:
            tables.drop(str(k - 2))  # what the stage before this one read
    return docs
