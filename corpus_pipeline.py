"""A training corpus from ``documents``: language ID, near-duplicates, decontamination, personal data, packing.

Each stage works on all rows that its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bytequarry.llm import decontaminate, langid, neardup, packing, pii
from bytequarry.llm._common import materialise
from bytequarry.llm.queries import pieces_digest


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that language identification rejects: null, empty, or without letters. Mixtures of languages stay."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: links join a similarity of 0.8 or more (``op8_near_duplicates`` has its own threshold)."""
    return neardup.keep_one(docs, percent=80, bands=36)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold passages of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts."""
    return pii.redact_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return pieces_digest(packing.pack(docs))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmarks", benchmarks), ("personal_data", personal_data), ("pack", pack)]
#: Not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
