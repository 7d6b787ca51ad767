"""Helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.lineage import cut, shared_folder, stored

__all__ = ["texts_of", "cut", "shared_folder", "stored", "table", "words_sql"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_sql(text: str) -> str:
    """SQL for the array of words ``[^\\x20\\x09-\\x0D]+`` of a text column (null: empty)."""
    return rf"filter(split(coalesce({text}, ''), r'[ \t-\r]+'), w -> w != '')"


def texts_of(column, rows: int = 512):
    """The values of an Arrow column, made some rows at a time, so that a batch isn't held twice."""
    for lo in range(0, len(column), rows):
        yield from column.slice(lo, rows).to_pylist()
