"""Markdown in and out: page joins, front matter, glossaries, final documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B


def pages_with_figures(pages: DataFrame, figures: DataFrame) -> DataFrame:
    """(doc_id, text): non-empty page texts (book_id, page, text), each followed by its figure references."""
    refs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "file_name"))), lambda f: F.concat(F.lit("![](images/"), f["file_name"], F.lit(")"))), "\n\n")
    by = figures.groupBy("book_id", "page").agg(refs.alias("refs"))
    bare = F.regexp_replace("text", rf"{T.WS}+\z", "")
    rows = pages.join(by, ["book_id", "page"], "left").withColumn("t", F.concat_ws("\n\n", F.when(bare != "", bare), "refs")).where("t <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("page", "t")))
    return rows.groupBy(F.col("book_id").alias("doc_id")).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("text"))


def frontmatter(title: str = "title", author: str = "author", language: str = "language") -> Column:
    """YAML head of a document, one line per field."""

    def quoted(c):
        return rf"replace(replace(coalesce({T.single_line(c)}, ''), '\\', '\\\\'), '\"', '\\\"')"

    return F.expr(f"concat('---\\ntitle: \"', {quoted(title)}, '\"\\nauthor: \"', {quoted(author)}, '\"\\nlang: \"', {quoted(language)}, '\"\\n---\\n\\n')")


def with_metadata(docs: DataFrame, given: DataFrame, found: DataFrame) -> DataFrame:
    """Adds title, author and language: what was given, else found, else file stem, Unknown, en."""
    g = given.select("doc_id", *(F.col(c).alias(f"g_{c}") for c in ("title", "author", "language")))
    f = found.select("doc_id", *(F.col(c).alias(f"f_{c}") for c in ("title", "author", "language")))
    stem = F.col("stem") if "stem" in docs.columns else F.col("doc_id").cast("string")
    both = docs.join(g, "doc_id", "left").join(f, "doc_id", "left")
    return both.select(*docs.columns, F.coalesce("g_title", "f_title", stem).alias("title"), F.coalesce("g_author", "f_author", F.lit("Unknown")).alias("author"), F.coalesce("g_language", "f_language", F.lit("en")).alias("language"))


def with_image_folder(text: str = "text", slug: str = "slug") -> Column:
    """Image references moved to the document's own folder."""
    return F.expr(f"replace({text}, '](images/', concat('](images/', {slug}, '/'))")


def finalized(chunks: DataFrame, meta: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """(doc_id, text): chunks (doc_id, chunk_no, text) put together, without watermarks, with heading ids and front matter."""
    docs = B.joined(chunks, "chunk_no", by="\n\n")
    if hosts is not None:
        docs = B.joined(B.without_watermarks(B.blocks(docs), hosts), "block_no", by="\n\n")
    docs = B.joined(B.with_heading_ids(B.lines(docs)).withColumn("text", F.col("line")), "line_no")
    both = docs.join(meta.select("doc_id", "title", "author", "language"), "doc_id", "left")
    return both.select("doc_id", F.concat(frontmatter(), "text").alias("text"))


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of a JSON glossary: an object, or its ``terms``; entries that are not strings are dropped, none left fails."""
    raw = spark.read.text(path, wholetext=True).select(F.expr("parse_json(value)").alias("v"))
    terms = raw.select(F.expr("coalesce(try_variant_get(v, '$.terms', 'map<string,variant>'), try_variant_get(v, '$', 'map<string,variant>'))").alias("m"))
    rows = terms.select(F.explode("m").alias("src", "x")).where("schema_of_variant(x) = 'STRING'").select("src", F.expr("variant_get(x, '$', 'string')").alias("dst"))
    if rows.isEmpty():
        raise ValueError("the glossary has no terms")
    return rows
