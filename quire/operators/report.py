"""Run statistics as aggregations over status columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_status(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("n"))


def translation(rows: DataFrame, *keys: str) -> DataFrame:
    """Units by outcome."""
    names = ("ok", "retried", "fallback", "verbatim", "blocked", "repaired", "cached")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("units"), *(F.count_if(F.col("status") == s).alias(s) for s in names))


def polish(rows: DataFrame, *keys: str) -> DataFrame:
    """Units by what polishing did: pre, final and status given."""
    same = F.col("pre") == F.col("final")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("units"), F.count_if(~same).alias("changed"), F.count_if(same).alias("unchanged"),
        F.count_if(F.col("was_untranslated") & ~same).alias("retranslated"), F.count_if(F.col("status") == "retried").alias("retried"),
        F.count_if(F.col("status") == "verbatim").alias("kept"),
    )


def plan_health(units: DataFrame, *keys: str) -> DataFrame:
    """Leftover source language, missing entries, fingerprints that differ and entries of the old format."""
    return units.groupBy(*keys).agg(
        F.count_if("leftover").alias("leftover"), F.count_if(F.col("entry").isNull()).alias("missing"),
        F.count_if(F.col("entry").isNotNull() & F.col("entry_fp").isNotNull() & (F.col("entry_fp") != F.col("source_fp"))).alias("mismatched"),
        F.count_if(F.col("entry").isNotNull() & F.col("entry_fp").isNull()).alias("legacy"),
    )


def touched(rows: DataFrame) -> DataFrame:
    """Documents that any unit changes."""
    return rows.groupBy("doc_id").agg(F.bool_or(F.col("final") != F.col("text")).alias("touched")).where("touched").select("doc_id")


def labels(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("final") != F.col("text")).alias("changed"), F.count(F.lit(1)).alias("total"))


def figures(rows: DataFrame) -> DataFrame:
    return rows.groupBy("book_id").agg(F.count(F.lit(1)).alias("figures"), F.countDistinct("page").alias("pages"))


def sample_pairs(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` before and after pairs (pre, final) in order of chunk and unit: a sample to look at, a limit by purpose."""
    return rows.orderBy("chunk_no", "unit_no").limit(n).select("chunk_no", "unit_no", "pre", "final")
