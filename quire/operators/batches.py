"""Units through a model in chunks, each unit judged on its own.

Units are packed to a word target, sent as one numbered payload per chunk and
read back by number.  What is missing or fails its gate is asked for alone, with
all tries and the fallback; what still fails keeps its earlier text.  With a
store, answers are kept under a hash of everything they depend on, so a rerun
pays for what is missing and judges kept answers by the gates of today: units
that fail them now are asked for again, which is how a run is repaired.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lineage import cut
from . import checkpoints, pack, wire
from .stage import Transform, answered

TAIL = 0.3
#: The number of a unit that is sent alone.
ALONE = "<<<1>>>\n"


def _ident(transform: Transform) -> str:
    return transform.ident if transform.fallback is None else f"{transform.ident}>{_ident(transform.fallback)}"


def remembered(rows: DataFrame, transform: Transform, system: str, column: str, store: str | None, stage: str) -> DataFrame:
    """Adds answer and status to ``rows``, as ``answered`` does; with a store equal payloads are asked for once, ever.

    Only answers are stored: what was refused or came back empty is asked for
    again by the next run.  Null payloads have no answer.
    """
    if store is None:
        return answered(rows, transform, system, column)
    keys = ["chunk_key", "source_fp"]
    keyed = checkpoints.with_key(rows, _ident(transform), system, column).withColumn("source_fp", F.expr(T.fingerprint(column)))
    work = keyed.where(F.col(column).isNotNull()).select(*keys, column).dropDuplicates(keys)
    kept = checkpoints.newest(checkpoints.read(rows.sparkSession, store).where(F.col("stage") == stage))
    kept = cut(kept.select(*keys, F.col("text").alias("answer")).join(work.select(*keys), keys, "left_semi"))
    made = cut(answered(work.join(kept, keys, "left_anti"), transform, system, column).drop(column))
    checkpoints.write(made.where("answer is not null").select("chunk_key", F.lit(0).alias("unit_no"), F.col("answer").alias("text"), "source_fp"), store, stage)
    have = kept.withColumn("status", F.lit("ok")).unionByName(made)
    return keyed.join(have, keys, "left").withColumn("status", F.coalesce("status", F.lit("failed"))).drop(*keys)


def _unnumbered(answer: str) -> str:
    """SQL for an answer without its number and outer line ends."""
    return rf"regexp_replace(regexp_replace({answer}, r'^\s*<<<1>>>[ \t]*', ''), r'^\n+|\n+\z', '')"


def in_chunks(
    units: DataFrame, transform: Transform, gate: Column, sent: str = "text", kept: str = "text", system: str = "", target: int = 1500,
    key: str = "doc_id", order: str = "unit_no", max_chunks: int | None = None, store: str | None = None, stage: str = "units", labels: bool = False,
) -> DataFrame:
    """``units`` (key, order, n_words, ...) with chunk_no, candidate, failed (first gate), final and status.

    ``sent`` is the SQL of what the model gets, ``kept`` the column that final
    falls back to; ``gate`` reads the units' columns and candidate.  Statuses
    are ok, retried, fallback, blocked and verbatim.  With ``max_chunks`` only
    units of the first chunks of every key come back.  Units whose text has
    numbers like those of the wire are sent alone; null texts are not sent.
    ``labels``: answers may repeat ``[BG]``/``[EN]`` labels, which go.
    """
    bare = T.without_labels if labels else str
    rows = pack.with_tail_merged(pack.packed(units, target, key, order), target, TAIL, key)
    if max_chunks is not None:
        rows = pack.first_chunks(rows, max_chunks)
    rows = rows.withColumn("__sent", F.expr(sent))
    rows = rows.withColumn("__alone", F.col("__sent").isNull() | F.col("__sent").rlike(wire.MARKER))
    place = F.row_number().over(Window.partitionBy(key, "chunk_no", "__alone").orderBy(order))
    rows = cut(rows.withColumn("__no", place))

    chunk = [key, "chunk_no"]
    chunks = wire.render(rows.where(~F.col("__alone")), chunk, "__no", "__sent")
    said = remembered(chunks, replace(transform, tries=1, fallback=None), system, "payload", store, stage)
    said = said.where("answer is not null").select(*chunk, F.col("answer").alias("payload"), "expected")
    parsed = wire.parse(said, chunk).select(*chunk, F.col("unit_no").alias("__no"), F.expr(bare("text")).alias("candidate"), F.lit(False).alias("__alone"))
    first = rows.join(parsed, [*chunk, "__no", "__alone"], "left")
    first = cut(first.withColumn("failed", gate))

    cols = [*units.columns, "chunk_no", "candidate", "failed", "status"]
    good = first.where("failed is null").withColumn("status", F.lit("ok")).select(*cols)
    again = first.where("failed is not null").drop("candidate", "failed").withColumn("__one", F.concat(F.lit(ALONE), "__sent")).repartition(key, order)
    second = remembered(again, transform, system, "__one", store, f"{stage}:alone").withColumnRenamed("status", "__said")
    second = cut(second.withColumn("candidate", F.expr(bare(_unnumbered("answer")))).withColumn("failed", gate))
    how = F.when(F.col("failed").isNotNull(), F.when(F.col("__said") == "blocked", "blocked").otherwise("verbatim")).when(F.col("__said") == "fallback", "fallback").otherwise("retried")
    done = good.unionByName(second.withColumn("status", how).select(*cols))
    return done.withColumn("final", F.when(F.col("failed").isNull(), F.col("candidate")).otherwise(F.col(kept)))
