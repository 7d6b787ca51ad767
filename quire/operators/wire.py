"""Chunks on the wire: units between ``<<<n>>>`` markers, rendered and parsed as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import without_labels

MARKER = r"(?m)^<<<(\d+)>>>[ \t]*$"


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else key


def render(units: DataFrame, key: str | list[str] = "chunk_key", no: str = "unit_no", text: str = "text") -> DataFrame:
    """(key, payload, expected): the units of each chunk in order, numbered by ``no``."""
    ordered = F.array_sort(F.collect_list(F.struct(no, text)))
    parts = F.transform(ordered, lambda x: F.concat(F.lit("<<<"), x[no].cast("string"), F.lit(">>>\n"), x[text]))
    return units.groupBy(*_keys(key)).agg(F.array_join(parts, "\n").alias("payload"), F.count(F.lit(1)).cast("int").alias("expected"))


def with_source(pre: str = "pre", source: str = "source_en") -> str:
    """SQL for a text that shows its source below it, as ``[BG]``/``[EN]``, where it differs."""
    return rf"case when {source} <> {pre} then concat('[BG]\n', {pre}, '\n[EN]\n', {source}) else {pre} end"


def render_polish(units: DataFrame, show_source: bool, key: str | list[str] = "chunk_key", no: str = "unit_no") -> DataFrame:
    """The same for units with pre and, if shown, source_en."""
    return render(units.withColumn("__wire", F.expr(with_source() if show_source else "pre")), key, no, "__wire")


def parse(responses: DataFrame, key: str | list[str] = "chunk_key", payload: str = "payload", expected: str = "expected") -> DataFrame:
    """(key, unit_no, text): units by marker; of repeated numbers the last counts, unknown numbers are dropped."""
    ids = rf"transform(regexp_extract_all({payload}, r'{MARKER}', 1), i -> try_cast(i as int))"
    texts = rf"transform(slice(split({payload}, r'{MARKER}', -1), 2, greatest(size({ids}), 1)), t -> regexp_replace(t, r'^\n+|\n+\z', ''))"
    found = responses.where(F.expr(rf"{payload} rlike r'{MARKER}'")).select(*_keys(key), expected, F.posexplode(F.expr(f"arrays_zip({ids}, {texts})")).alias("at", "u"))
    found = found.select(*_keys(key), expected, "at", F.col("u")["0"].alias("unit_no"), F.col("u")["1"].alias("text")).where(F.col("unit_no").between(1, F.col(expected)))
    return found.groupBy(*_keys(key), "unit_no").agg(F.max_by("text", "at").alias("text"))


def without_echoed_labels(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.withColumn(text, F.expr(without_labels(text)))


def glossary_prompt(glossary: DataFrame) -> str:
    """Sorted ``- src -> dst`` lines of a glossary; a glossary is a prompt's part and small by nature."""
    rows = glossary.orderBy("src").collect()
    return "\n".join(f"- {r.src} -> {r.dst}" for r in rows)
