"""New documents as a stream through a model stage, each paid for once.

A file source feeds micro-batches; every batch anti-joins the checkpoint table,
asks only for what is missing and appends it, so a restart or a file that comes
twice costs nothing.  This goes beyond a batch rerun, with the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fingerprint
from ..operators import checkpoints
from ..operators.stage import Transform, answered


def run_batch(units: DataFrame, transform: Transform, store: str, stage: str) -> None:
    """Answers units (text, ...) that the store lacks; equal texts are asked for once."""
    spark = units.sparkSession
    work = units.where("text is not null").select("text").distinct()
    work = checkpoints.with_key(work, transform.ident, payload="text")
    todo = checkpoints.misses(work, checkpoints.read(spark, store), stage)
    made = answered(todo, transform).where("answer is not null")
    rows = made.select("chunk_key", F.lit(1).alias("unit_no"), F.col("answer").alias("text"), F.expr(fingerprint("text")).alias("source_fp"))
    checkpoints.write(rows, store, stage)


def start(spark: SparkSession, source: str, schema: str, transform: Transform, store: str, progress: str, stage: str = "translate"):
    """A query over Parquet files that appear in ``source``; handles what is there and ends."""
    stream = spark.readStream.schema(schema).parquet(source)
    work = stream.writeStream.foreachBatch(lambda batch, _: run_batch(batch, transform, store, stage))
    return work.option("checkpointLocation", progress).trigger(availableNow=True).start()
