"""E-book packages in, translated packages out, many at a time."""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lineage import cut, stored
from ..operators import batches, checkpoints, gates, units, wire
from ..operators.stage import Transform
from ..sources import epub
from . import pipelines, prompts

_FILE = "book_id string, name string, content binary"


def _documents(found: DataFrame, names: DataFrame) -> DataFrame:
    """(book_id, name, doc_id, html) of the named entries; doc_id is a hash of both names."""
    docs = found.join(names.select("book_id", "name").distinct(), ["book_id", "name"])
    return docs.select("book_id", "name", F.xxhash64("book_id", "name").alias("doc_id"), F.col("content").cast("string").alias("html"))


def _written(docs: DataFrame) -> DataFrame:
    """Entries from (book_id, name, html)."""
    head = F.when(F.col("html").startswith("<?xml"), F.lit("")).otherwise(F.lit("<?xml version='1.0' encoding='UTF-8'?>\n"))
    return docs.select("book_id", "name", F.concat(head, "html").cast("binary").alias("content"))


def translated_labels(docs: DataFrame, transform: Transform, gate: Column, only: Column | None = None, system: str = "", store: str | None = None) -> DataFrame:
    """(doc_id, label_no, text, final) of the navigation labels of docs (doc_id, html); ``only`` picks labels to ask for.

    The labels of a document are one numbered payload and one call.  With a
    ``store`` a rerun has the answers, and judges each label by today's gate.
    """
    labels = cut(units.nav_labels(docs))
    work = labels.where(only) if only is not None else labels
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("label_no"))
    work = work.withColumn("__no", place).withColumn("source", F.col("text"))
    said = batches.remembered(wire.render(work, "doc_id", "__no"), transform, system, "payload", store, "navigation")
    said = said.where("answer is not null").select("doc_id", F.col("answer").alias("payload"), "expected")
    parsed = wire.parse(said, "doc_id").select("doc_id", F.col("unit_no").alias("__no"), F.expr(T.strip("text")).alias("candidate"))
    done = cut(work.join(parsed, ["doc_id", "__no"]).withColumn("failed", gate)).where("failed is null").select("doc_id", "label_no", F.col("candidate").alias("__new"))
    return labels.join(done, ["doc_id", "label_no"], "left").select("doc_id", "label_no", "text", F.coalesce("__new", "text").alias("final"))


def polished_labels(docs: DataFrame, transform: Transform, store: str | None = None) -> DataFrame:
    """The same for labels that are still untranslated."""
    return translated_labels(docs, transform, gates.polished_label_gate(), F.expr(T.looks_untranslated("text")), prompts.POLISH, store)


def _relabelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    by = labels.where("final <> text").groupBy("doc_id").agg(F.collect_list(F.struct("label_no", "final")).alias("labels"))
    both = docs.join(by, "doc_id", "left").select("book_id", "name", "html", "labels")

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            made = [units.with_labels(r["html"], {x["label_no"]: x["final"] for x in r["labels"] or []}) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string())], names=["book_id", "name", "html"])

    return both.mapInArrow(run, "book_id string, name string, html string")


def _with_metadata(found: DataFrame, language: str, suffix: str | None) -> DataFrame:
    def run(batches):
        for batch in batches:
            made = [epub.with_metadata(c, language, suffix) for c in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["book_id", "name", "content"])

    return found.where(F.col("name").endswith(".opf")).select("book_id", "name", "content").mapInArrow(run, _FILE)


def _parts(books: DataFrame, name_contains: str | None):
    """(entries, documents with their place in the book, navigation documents) of packages (book_id, content)."""
    found = stored(epub.entries(books))  # read for spine, navigation, documents and the rest
    package = cut(epub.packages(found))
    nav = epub.nav_documents(package, found)
    spine = epub.spine_documents(package, found).join(nav, ["book_id", "name"], "left_anti")
    if name_contains is not None:
        spine = spine.where(F.col("name").contains(name_contains))
    docs = _documents(found, spine).join(spine.select("book_id", "name", "pos"), ["book_id", "name"])
    return found, docs, _documents(found, nav)


def _put_together(found: DataFrame, docs: DataFrame, new: DataFrame, navs: DataFrame, labels: DataFrame, language: str, suffix: str | None) -> DataFrame:
    """(book_id, content) of packages with the documents ``new`` (doc_id, html), other labels and metadata."""
    body = docs.select("book_id", "name", "doc_id").join(new, "doc_id")
    changed = cut(_written(body).union(_written(_relabelled(navs, labels))).union(_with_metadata(found, language, suffix)))
    rest = found.select("book_id", "name", "content").join(changed.select("book_id", "name"), ["book_id", "name"], "left_anti")
    return epub.repacked(rest.union(changed))


def translate(
    books: DataFrame, transform: Transform, language: str = "bg", suffix: str | None = None, glossary: str = "",
    name_contains: str | None = None, words: int = pipelines.TRANSLATE_WORDS, max_chunks: int | None = None, store: str | None = None,
) -> DataFrame:
    """(book_id, content): packages (book_id, content) with documents, navigation and metadata in another language.

    Navigation documents are not translated as body text, so no label is asked
    for twice; documents that nothing changes stay as they are, byte for byte.
    """
    found, docs, navs = _parts(books, name_contains)
    asked = replace(transform, ident=f"{transform.ident}:{language}")
    system = prompts.system(prompts.TRANSLATE, language, glossary)
    new, results = pipelines.translate(docs.select("doc_id", "html"), asked, language, system=system, words=words, max_chunks=max_chunks, store=store)
    touched = results.where("final <> text").select("doc_id").distinct()
    labels = translated_labels(navs.select("doc_id", "html"), asked, gates.label_gate(target=f"'{language}'"), system=system, store=store)
    return _put_together(found, docs, new.join(touched, "doc_id", "left_semi"), navs, labels, language, suffix)


def to_polish(books: DataFrame, sources: DataFrame | None = None, prior: DataFrame | None = None, name_contains: str | None = None) -> DataFrame:
    """Units (book_id, pos, doc_id, unit_no, shown, text, pre) of packages to polish.

    ``shown`` is what the package has.  With ``prior`` (doc_id, unit_no, text,
    source_fp) the packages are the originals and earlier results are put over
    them where their fingerprint fits; with ``sources`` they are translations,
    and the unit of the same place in the original is their source; otherwise a
    unit is its own source.
    """
    _, docs, _ = _parts(books, name_contains)
    place = docs.select("doc_id", "book_id", "pos")
    found = units.units(docs.select("doc_id", "html")).where("not unsafe").select("doc_id", "unit_no", "text").join(place, "doc_id")
    found = found.withColumn("shown", F.col("text"))
    if prior is not None:
        return checkpoints.applied(found, prior)
    found = found.withColumn("pre", F.col("text"))
    if sources is not None:
        _, old, _ = _parts(sources, name_contains)
        old = units.units(old.select("doc_id", "html")).select("doc_id", "unit_no", F.col("text").alias("__source"))
        found = found.join(old, ["doc_id", "unit_no"], "left").withColumn("text", F.coalesce("__source", "text")).drop("__source")
    return found


def polish(
    books: DataFrame, transform: Transform, sources: DataFrame | None = None, prior: DataFrame | None = None, untranslated_only: bool = False, show_source: bool = False,
    suffix: str | None = None, glossary: str = "", name_contains: str | None = None, words: int = pipelines.POLISH_WORDS, max_chunks: int | None = None, store: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(packages (book_id, content), unit results): polished text, labels still in another language, and metadata.

    Narrowing the work (``untranslated_only``, ``max_chunks``) never narrows
    what is applied: every unit has its best text.  For a trial run look at the
    results (``report.sample_pairs``, ``report.polish``) and leave the packages.
    """
    found, docs, navs = _parts(books, name_contains)
    system = prompts.system(prompts.POLISH, None, glossary)
    best = to_polish(books, sources, prior, name_contains)
    results = cut(pipelines.polish(best, transform, untranslated_only, show_source, system, words, "book_id", "pos", max_chunks, store))
    changes = results.where("final <> shown").select("doc_id", "unit_no", F.col("final").alias("text"))
    new = units.rewritten(docs.join(changes.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "html"), changes)
    labels = polished_labels(navs.select("doc_id", "html"), transform, store)
    return _put_together(found, docs, new, navs, labels, "bg", suffix), results
