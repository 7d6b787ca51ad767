"""Model stages: a pluggable transform over Arrow batches, with retries, fallback and bisection.

A transform is ``fn(system, text) -> text`` that may raise ``Blocked`` (the
input is refused), ``Empty`` (nothing came back) or ``Retryable`` (try again
later).  What happens to a row is data: every stage returns a status column,
and run statistics are aggregations over it, which task retries cannot inflate.
Rows are dealt over partitions before a stage; that is its concurrency.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lineage import cut

# HTTP codes after which a call is tried again, and reasons that mean a refusal.
RETRYABLE = frozenset([429, 500, 502, 503, 504])
REFUSALS = frozenset(["SAFETY", "RECITATION", "PROHIBITED_CONTENT", "BLOCKLIST", "SPII"])


class Blocked(Exception):
    pass


class Empty(Exception):
    pass


class Retryable(Exception):
    def __init__(self, code: int | None = None):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class Transform:
    """``ident`` goes into every cache key; ``fallback`` runs after all tries of this one failed."""

    ident: str
    fn: Callable[[str, str], str]
    tries: int = 2
    retries: int = 5
    delay: float = 5.0
    max_delay: float = 120.0
    fallback: Transform | None = field(default=None)

    def call(self, system: str, text: str) -> str:
        """One answer; waits twice as long after each retryable error, and asks once more after an empty answer."""
        wait, last = self.delay, None
        for attempt in range(self.retries):
            try:
                out = self.fn(system, text)
                if out and out.strip():
                    return out
                last = Empty()
            except Retryable as e:
                if e.code is not None and e.code not in RETRYABLE:
                    raise
                last = e
            except Empty as e:
                last = e
            if attempt + 1 < self.retries and wait:
                time.sleep(wait)
                wait = min(wait * 2, self.max_delay)
        raise last


def identity(system: str, text: str) -> str:
    return text


def upper(system: str, text: str) -> str:
    return text.upper()


_PSEUDO = str.maketrans(T.LATIN, T.CYRILLIC)


def pseudo(system: str, text: str) -> str:
    """Letters exchanged for Cyrillic ones: what ``pseudo_translated`` is in SQL."""
    return text.translate(_PSEUDO)


def bisected(transform: Transform, system: str, text: str) -> list[tuple[str, str]]:
    """(text, status) of the paragraphs of a text; a refused text is tried in halves, down to single paragraphs."""
    try:
        return [(transform.call(system, text), "ok")]
    except (Blocked, Empty):
        parts = [p for p in text.split("\n\n") if p.strip()]
        if len(parts) < 2:
            return [(text, "verbatim")]
        half = len(parts) // 2
        return bisected(transform, system, "\n\n".join(parts[:half])) + bisected(transform, system, "\n\n".join(parts[half:]))


def laddered(transform: Transform, system: str, text: str) -> tuple[str | None, str]:
    """(answer, status): all tries of the transform, then of its fallback; statuses ok, fallback, blocked, failed."""
    at, status = transform, "failed"
    while at is not None:
        for _ in range(max(1, at.tries)):
            try:
                return at.call(system, text), "ok" if at is transform else "fallback"
            except Blocked:
                status = "blocked"
                break
            except (Empty, Retryable):
                status = "failed"
        at = at.fallback
    return None, status


def _mapped(rows: DataFrame, work: Callable[[str], list], added: str, column: str) -> DataFrame:
    names = [f.split()[0] for f in added.split(", ")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    at = rows.columns.index(column)
    arrow = {"string": pa.string(), "int": pa.int32()}

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                made = [work(x) for x in part.column(at).to_pylist()]
                cols = [pa.array([m[i] for m in made], arrow[f.split()[1]]) for i, f in enumerate(added.split(", "))]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, *names])

    return rows.mapInArrow(run, f"{kinds}, {added}")


def answered(rows: DataFrame, transform: Transform, system: str = "", column: str = "text") -> DataFrame:
    """Adds answer and status of one call per row, with its ladder."""

    def work(text):
        return (None, "failed") if text is None else laddered(transform, system, text)

    return _mapped(rows, work, "answer string, status string", column)


def cleaned(chunks: DataFrame, transform: Transform, system: str = "", short: str = "", long: str = "", lo: float = 0.70, hi: float = 1.20, store: str | None = None) -> DataFrame:
    """Adds cleaned, status and attempts to chunks (text): image blocks stay, the rest is cleaned with bisection.

    An answer whose word count drifts out of [lo, hi] of the input's is asked
    for once more, with the instruction ``short`` or ``long`` by how it drifted;
    statuses are ok, retried, verbatim (in part) and drift.  With a ``store``
    folder what didn't drift is kept under a hash of instruction, transform and
    text, so a rerun pays for what is missing, and equal texts are asked for once.
    """
    import re

    image = re.compile(r"\s*!\[[^\]]*\]\([^)]*\)\s*\Z")

    def once(text: str, asked: str):
        out, run, verbatim, words_in, words_out = [], [], False, 0, 0

        def flush():
            nonlocal verbatim, words_in, words_out
            if run:
                body = "\n\n".join(run)
                made = bisected(transform, asked, body)
                verbatim |= any(s == "verbatim" for _, s in made)
                joined = "\n\n".join(t for t, _ in made)
                words_in, words_out = words_in + len(body.split()), words_out + len(joined.split())
                out.append(joined)
                run.clear()

        for block in re.split(r"\n\s*\n", text):
            if image.match(block):
                flush()
                out.append(block.strip())
            elif block.strip():
                run.append(block)
        flush()
        return "\n\n".join(out), verbatim, (words_out / words_in if words_in else None)

    def work(text):
        if text is None:
            return None, "ok", 0
        asked = system
        for attempt in (1, 2):
            made, verbatim, ratio = once(text, asked)
            if ratio is None or lo <= ratio <= hi:
                return made, "verbatim" if verbatim else "ok" if attempt == 1 else "retried", attempt
            asked = (short if ratio < lo else long) or system
        return made, "drift", 2

    added = "cleaned string, status string, attempts int"
    if store is None:
        return _mapped(chunks, work, added, "text")
    from . import checkpoints

    keys = ["chunk_key", "source_fp"]
    keyed = checkpoints.with_key(chunks, transform.ident, system, "text").withColumn("source_fp", F.expr(T.fingerprint("text")))
    asked = keyed.where("text is not null").select(*keys, "text").dropDuplicates(keys)
    # The status goes before the text, on a line of its own.
    kept = checkpoints.newest(checkpoints.read(chunks.sparkSession, store).where("stage = 'clean'")).select(*keys, F.expr("substring_index(text, '\n', 1)").alias("status"), F.expr("substring(text, instr(text, '\n') + 1)").alias("cleaned"))
    kept = cut(kept.join(asked.select(*keys), keys, "left_semi")).withColumn("attempts", F.lit(0))
    made = cut(_mapped(asked.join(kept, keys, "left_anti"), work, added, "text").drop("text"))
    done = made.where("status <> 'drift'").select("chunk_key", F.lit(0).alias("unit_no"), F.concat_ws("\n", "status", "cleaned").alias("text"), "source_fp")
    checkpoints.write(done, store, "clean")
    have = kept.unionByName(made)
    return keyed.join(have, keys, "left").drop(*keys).select(*chunks.columns, "cleaned", F.coalesce("status", F.lit("ok")).alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"))


def strict(rows: DataFrame) -> DataFrame:
    """Fails the job on a chunk that drifted twice."""
    ok = F.when(F.col("status") == "drift", F.raise_error(F.lit("a cleaned chunk drifted"))).otherwise(F.col("status"))
    return rows.withColumn("status", ok)


def translated(units: DataFrame, transform: Transform, gate: Column, system: str = "") -> DataFrame:
    """Units (text, ...) with candidate, failed (first gate), final and status.

    One pass asks for every unit, and what came back is kept on shared storage; those that fail the gate are dealt over the
    cluster again and asked for alone with the ladder; what still fails keeps
    its source text.  ``gate`` reads the columns source and candidate.
    """
    first = answered(units, transform, system).withColumnsRenamed({"answer": "candidate", "status": "__first"}).withColumn("source", F.col("text"))
    first = cut(first.withColumn("failed", gate))
    good = first.where("failed is null").withColumn("status", F.col("__first"))
    again = first.where("failed is not null").select(*units.columns).repartition("text")
    second = answered(again, transform, system).withColumnsRenamed({"answer": "candidate", "status": "__first"}).withColumn("source", F.col("text"))
    second = cut(second.withColumn("failed", gate))
    status = F.when(F.col("failed").isNull(), F.lit("retried")).when(F.col("__first") == "blocked", "blocked").otherwise("verbatim")
    done = good.unionByName(second.withColumn("status", status))
    return done.withColumn("final", F.when(F.col("failed").isNull(), F.col("candidate")).otherwise(F.col("text"))).drop("__first", "source")


def to_repair(units: DataFrame, cached: DataFrame, gate: Column, keys=("doc_id", "unit_no")) -> DataFrame:
    """Units whose cached candidate fails the current gate."""
    c = cached.select(*keys, F.col("text").alias("candidate"))
    both = units.withColumn("source", F.col("text")).join(c, list(keys)).withColumn("failed", gate)
    return both.where("failed is not null").drop("source")


def metadata(first_chunks: DataFrame, transform: Transform, system: str = "") -> DataFrame:
    """doc_id with title, author, language and language_name read from a model's JSON; what is not valid is null."""
    sample = first_chunks.select("doc_id", F.substring("text", 1, 8000).alias("text"))
    raw = answered(sample, transform, system)
    m = F.from_json(F.expr(T.unfenced("answer")), "title string, author string, language string, language_name string")
    got = raw.select("doc_id", m.alias("m")).select("doc_id", "m.*")
    return got.select("doc_id", *(F.expr(T.single_line(c)).alias(c) for c in ("title", "author")), F.expr(T.language("language")).alias("language"), F.expr(T.single_line("language_name")).alias("language_name"))
