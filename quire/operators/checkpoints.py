"""Content-addressed checkpoints: a rerun only pays for what is missing.

Rows: stage, chunk_key, unit_no, text, source_fp, written_at.  Keys cover all
that a result depends on (prompt, transform, parameters, payload).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cache_key, fingerprint

SCHEMA = "stage string, chunk_key string, unit_no int, text string, source_fp string, written_at timestamp"


def with_key(rows: DataFrame, transform_id: str, prompt: str = "", payload: str = "payload") -> DataFrame:
    quoted = [f"'{x}'" for x in (prompt.replace("\\", "\\\\").replace("'", "\\'"), transform_id.replace("'", "\\'"))]
    return rows.withColumn("chunk_key", F.expr(cache_key(*quoted, payload)))


def read(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except Exception as e:  # nothing has been written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA)


def write(results: DataFrame, path: str, stage: str) -> None:
    """Appends results (chunk_key, unit_no, text, source_fp); the commit protocol makes a job's rows appear at once."""
    rows = results.select(F.lit(stage).alias("stage"), "chunk_key", F.col("unit_no").cast("int"), "text", "source_fp", F.current_timestamp().alias("written_at"))
    rows.write.mode("append").parquet(path)


def newest(entries: DataFrame) -> DataFrame:
    """The latest entry of each unit."""
    last = F.max_by(F.struct("text", "source_fp"), "written_at").alias("e")
    return entries.groupBy("stage", "chunk_key", "unit_no").agg(last).select("stage", "chunk_key", "unit_no", "e.*")


def hits(work: DataFrame, entries: DataFrame, stage: str) -> DataFrame:
    keys = entries.where(F.col("stage") == stage).select("chunk_key").distinct()
    return work.join(keys, "chunk_key", "left_semi")


def misses(work: DataFrame, entries: DataFrame, stage: str) -> DataFrame:
    keys = entries.where(F.col("stage") == stage).select("chunk_key").distinct()
    return work.join(keys, "chunk_key", "left_anti")


def applied(units: DataFrame, entries: DataFrame) -> DataFrame:
    """Units (doc_id, unit_no, text) with pre: the entry for their place if its fingerprint is theirs or missing."""
    e = entries.select(F.col("doc_id").alias("__d"), F.col("unit_no").alias("__u"), F.col("text").alias("pre"), F.col("source_fp").alias("__fp"))
    on = (F.col("doc_id") == F.col("__d")) & (F.col("unit_no") == F.col("__u")) & (F.col("__fp").isNull() | (F.col("__fp") == F.expr(fingerprint("text"))))
    return units.join(e, on, "left").drop("__d", "__u", "__fp")


def applied_by_content(units: DataFrame, entries: DataFrame) -> DataFrame:
    """The same by the fingerprint alone, wherever the unit stands now."""
    e = entries.where("source_fp is not null").groupBy("source_fp").agg(F.max_by("text", "written_at").alias("pre"))
    return units.withColumn("source_fp", F.expr(fingerprint("text"))).join(e, "source_fp", "left")


def overlaid(units: DataFrame, results: DataFrame) -> DataFrame:
    """All units with final: the result, else pre, else the source text; narrowing the work never narrows this."""
    r = results.select("doc_id", "unit_no", F.col("text").alias("__result"))
    return units.join(r, ["doc_id", "unit_no"], "left").withColumn("final", F.coalesce("__result", "pre", "text")).drop("__result")


def imported(files: DataFrame) -> DataFrame:
    """Entries of JSON checkpoint files (chunk_key, raw, mtime), in format 2 or the flat old one.

    Values that are not strings are dropped; a file that is no JSON object fails.
    """
    rows = files.withColumn("v", F.expr("try_parse_json(raw)"))
    is_object = F.expr("v is not null and schema_of_variant(v) like 'OBJECT%'")
    rows = rows.withColumn("v", F.when(is_object, F.col("v")).otherwise(F.expr("raise_error(concat('not a checkpoint: ', chunk_key))")))
    entry = F.from_json("raw", "format int, units map<string, struct<t: string, s: string>>")
    v2 = rows.where("try_variant_get(v, '$.format', 'int') = 2").select("chunk_key", "mtime", F.explode(entry["units"]).alias("k", "e"))
    v2 = v2.select("chunk_key", "mtime", F.col("k").try_cast("int").alias("unit_no"), "e.t", "e.s")
    flat = rows.where("coalesce(try_variant_get(v, '$.format', 'int'), 0) <> 2").select("chunk_key", "mtime", F.explode(F.expr("try_variant_get(v, '$', 'map<string, variant>')")).alias("k", "x"))
    flat = flat.where("schema_of_variant(x) = 'STRING'").select("chunk_key", "mtime", F.col("k").try_cast("int").alias("unit_no"), F.expr("variant_get(x, '$', 'string')").alias("t"), F.lit(None).cast("string").alias("s"))
    out = v2.union(flat).where("unit_no is not null and t is not null")
    return out.select("chunk_key", "unit_no", F.col("t").alias("text"), F.col("s").alias("source_fp"), F.col("mtime").alias("written_at"))


def newest_file(files: DataFrame) -> DataFrame:
    """Of several files of a chunk (chunk_no, key, raw, mtime) the one written last."""
    return files.groupBy("chunk_no").agg(F.max_by(F.struct("key", "raw", "mtime"), "mtime").alias("f")).select("chunk_no", "f.*")
