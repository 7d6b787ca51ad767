"""The corpus pipeline: each stage takes all its predecessor kept.

All stages but the last return the columns of their input, whatever their names.
Null and empty texts are rejected by the first stage; a stage that is given them
keeps them (near-dedup: as one group, as they share fingerprint zero).  Rows that
repeat a doc_id, or have none, are judged each by its own text.  Empty tables go
through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.functions.lineage import drop, passing, shared_folder
from quire.llm import decontam, mixing, pii, quality, simhash
from quire.llm.common import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates."""
    return pii.with_surrogates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with their shard and order."""
    return mixing.sharded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("source mix", source_mix),
]

#: SQL can't express the fingerprints' links; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; what only a stage needs goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}", None
    for k, (_, stage) in enumerate(STAGES):
        with passing(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if before is not None:
            drop(spark, before)
        before = f"{folder}/{k}"
        docs = spark.read.parquet(before)
    return docs
