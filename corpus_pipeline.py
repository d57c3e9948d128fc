"""Corpus pipeline over ``documents``: five stages, each written as Parquet and read again before the next.

Language ID removes documents whose language is unknown or ambiguous; near-dedup leaves one document of each group;
decontamination removes documents with benchmark windows; secret scans replace secrets in the texts; packing cuts what is left
into sequences. Every stage but the last returns the columns of ``documents``, others beside them included, whatever their names.

Defined results: null and wordless texts have no language and leave in the first stage; rows with a null id take part like others,
and are never preferred among near-duplicates; of repeated rows one stays; ties go to the least id; texts of any length are
handled whole; an empty table gives empty stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from causeway.llm import decontaminate, language, near_dedup, packing, secret_scan
from causeway.llm.storage import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(spark, docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", pack),
]

#: Tokenising and the trained stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
