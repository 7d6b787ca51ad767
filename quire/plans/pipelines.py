"""The three document pipelines as logical plans over whole corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lineage import cut
from ..operators import blocks as B
from ..operators import batches, gates, pack, stage, units, wire
from ..operators.stage import Transform
from ..sources import markdown
from . import prompts

CLEAN_WORDS, TRANSLATE_WORDS, POLISH_WORDS, TAIL = 2000, 1500, 1000, 0.3


def planned(docs: DataFrame, target: int = CLEAN_WORDS, keep_contents: bool = False) -> DataFrame:
    """Chunks (doc_id, chunk_no, text, ...) of repaired documents (doc_id, text)."""
    clean = B.joined(B.without_page_artifacts(B.lines(docs)).withColumnRenamed("line", "text"), "line_no")
    found = B.blocks(clean)
    if not keep_contents:
        found = B.without_contents(found)
    return pack.chunk_texts(pack.packed(B.merged_paragraphs(found), target))


def convert(
    docs: DataFrame, transform: Transform, meta: DataFrame, hosts: DataFrame | None = None, target: int = CLEAN_WORDS, max_chunks: int | None = None,
    store: str | None = None, describe: Transform | None = None,
) -> DataFrame:
    """(doc_id, text): documents repaired, cleaned by a model in chunks, and put together.

    ``store``: a folder of cleaned chunks, with which a rerun resumes.  A chunk
    that drifted twice fails the job.  ``meta`` is what is known of title, author and language; with
    ``describe`` a model reads the rest from a document's first chunk.
    """
    chunks = planned(docs, target)
    if max_chunks is not None:
        chunks = pack.first_chunks(chunks, max_chunks)
    done = stage.cleaned(chunks, transform, prompts.CLEAN, prompts.CLEAN_SHORT, prompts.CLEAN_LONG, store=store)
    done = stage.strict(done).select("doc_id", "chunk_no", F.col("cleaned").alias("text"), "status")
    if describe is not None:
        done = cut(done)
        found = stage.metadata(done.where("chunk_no = 1"), describe, prompts.METADATA)
        meta = cut(markdown.with_metadata(docs.select("doc_id").distinct(), meta, found))
    return markdown.finalized(done, meta, hosts)


def translate(
    pages: DataFrame, transform: Transform, target: str = "bg", gate: Column | None = None, name_contains: str | None = None, system: str = "",
    words: int = TRANSLATE_WORDS, max_chunks: int | None = None, store: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(pages rewritten, unit results) of pages (doc_id, html[, name]), translated in chunks of ``words``.

    ``max_chunks``: of every document only the first chunks.  ``store``: a folder of answers, with which a rerun resumes.
    """
    if name_contains is not None:
        pages = pages.where(F.col("name").contains(name_contains))
    found = units.units(pages).where("not unsafe").select("doc_id", "unit_no", "n_words", "text", F.col("text").alias("source"))
    gate = gate if gate is not None else gates.translation_gate(target=f"'{target}'")
    done = batches.in_chunks(found, transform, gate, system=system, target=words, max_chunks=max_chunks, store=store, stage="translate")
    results = done.select("doc_id", "unit_no", "chunk_no", "text", "final", "status", "failed", "candidate")
    return units.rewritten(pages, results.where("final <> text").select("doc_id", "unit_no", F.col("final").alias("text"))), results


def polish(
    found: DataFrame, transform: Transform, untranslated_only: bool = False, show_source: bool = False, system: str = "", words: int = POLISH_WORDS,
    book: str = "doc_id", pos: str = "unit_no", max_chunks: int | None = None, store: str | None = None,
) -> DataFrame:
    """Units (doc_id, unit_no, text, pre) with final, status and was_untranslated: all come back, also those not worked on.

    Chunks go across the documents of a ``book`` in order of ``pos``; a unit
    without pre is taken as its text.  ``show_source`` sends the text below pre.
    """
    found = found.withColumn("pre", F.coalesce("pre", "text")).withColumn("was_untranslated", F.expr(T.looks_untranslated("pre")))
    work = found.where("was_untranslated") if untranslated_only else found
    place = F.struct(F.col(pos).alias("pos"), "doc_id", "unit_no").alias("__at")
    work = work.select(F.col(book).alias("__book"), place, "doc_id", "unit_no", "text", "pre", F.expr(T.word_count("pre")).alias("n_words"))
    sent = wire.with_source("pre", "text") if show_source else "pre"
    gate = gates.polish_gate(pre="pre", source="text")
    done = batches.in_chunks(work, transform, gate, sent, "pre", system, words, "__book", "__at", max_chunks, store, "polish", labels=True)
    done = done.select("doc_id", "unit_no", F.col("final").alias("__final"), "status", "chunk_no")
    both = found.join(done, ["doc_id", "unit_no"], "left").withColumn("__best", F.coalesce("__final", "pre"))
    safe = gates.is_safe("text", "__best")
    return both.withColumn("final", F.when(safe, F.coalesce("__best", "text")).otherwise(F.col("text"))).drop("__final", "__best")
