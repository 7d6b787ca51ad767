"""Documents as lines and blocks: layout repair with windows partitioned by document.

All windows of one document share the partitioning, so a chain of these
operators shuffles once.  ``docs`` has doc_id and text; null texts have no
lines and no blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Line shapes.
RULE, NUMBER = r"^-{3,}\z", r"^\d{1,4}\z"
HEADING = r"^(#{1,6})[ \t]+(.+?)[ \t]*\z"
LEADER = r"^.+[.․…]{2,}\s*\d{1,4}\s*\|?\s*\z"
PAGE_MARK = r"^\*{0,2}\d{1,4}\*{0,2}\z"
FENCE_OPEN, FENCE_CLOSE = r"^(`{3,}[^`]*|~{3,}.*)\z", r"^(`{3,}|~{3,})\s*\z"
TERMINAL = ".!?…:;\"'»)*"
CONTENTS = ("contents", "table of contents")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no from 0, line)."""
    return docs.select("doc_id", F.posexplode(F.expr(T.lines("text"))).alias("line_no", "line"))


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block_no from 1, text, n_words): what blank lines part, stripped, without empty ones."""
    parts = F.expr(rf"filter(transform(split(text, r'\n\s*\n'), b -> {T.strip('b')}), b -> b <> '')")
    found = docs.select("doc_id", F.posexplode(parts).alias("p", "text"))
    return found.select("doc_id", (F.col("p") + 1).alias("block_no"), "text", F.expr(T.word_count("text")).alias("n_words"))


def line_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of texts that have one block per line."""
    return blocks(docs.withColumn("text", F.expr(r"replace(text, '\n', '\n\n')")))


def joined(rows: DataFrame, order: str, text: str = "text", by: str = "\n") -> DataFrame:
    """(doc_id, text): the texts of each document in order, joined."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x[text]), by).alias("text"))


def without_page_artifacts(rows: DataFrame) -> DataFrame:
    """``lines`` rows without page rules and without page numbers next to a rule."""
    bare = F.expr(T.strip("line"))
    rule = F.when(bare != "", bare.rlike(RULE))
    rows = rows.withColumn("__rule", rule)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    before = F.last("__rule", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("__rule", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    near = F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))
    rows = rows.withColumn("__near", near)
    return rows.where(~F.coalesce("__rule", F.lit(False)) & ~(bare.rlike(NUMBER) & F.col("__near"))).drop("__rule", "__near")


def merged_paragraphs(rows: DataFrame) -> DataFrame:
    """``blocks`` rows with paragraphs that a page end split put together: islands of blocks that go on."""
    w = Window.partitionBy("doc_id").orderBy("block_no")
    prev = F.lag("text").over(w)
    structural = F.col("text").rlike(r"^(#|!\[)")
    goes_on = (
        prev.isNotNull() & ~structural & ~prev.rlike(r"^(#|!\[)") & ~F.substring(prev, -1, 1).isin(*TERMINAL)
        & F.col("text").rlike(r"^\p{IsLowercase}")
    )
    rows = rows.withColumn("__new", F.when(goes_on, 0).otherwise(1)).withColumn("__island", F.sum("__new").over(w))
    ordered = F.array_sort(F.collect_list(F.struct("block_no", "text")))
    text = F.aggregate(
        F.transform(ordered, lambda x: x["text"]), F.lit(None).cast("string"),
        lambda acc, b: F.when(acc.isNull(), b).when(acc.endswith("-"), F.concat(F.substring(acc, F.lit(1), F.length(acc) - 1), b)).otherwise(F.concat(acc, F.lit(" "), b)),
    )
    out = rows.groupBy("doc_id", "__island").agg(text.alias("text"))
    return out.select("doc_id", F.col("__island").cast("int").alias("block_no"), "text", F.expr(T.word_count("text")).alias("n_words"))


def _bare_lines(text: str) -> str:
    return f"filter(transform({T.lines(text)}, l -> {T.strip('l')}), l -> l <> '')"


def block_kind(text: str = "text") -> str:
    """SQL for L (listing), H (short heading), B (both), P (other); the block's lines are split once."""
    heading = rf"regexp_replace(regexp_extract(l, r'{HEADING}', 2), r'[*_]+', '')"
    short = rf"forall(rs, l -> l rlike r'{HEADING}' and {T.word_count(heading)} <= 8)"
    listing = rf"(forall(rs, l -> startswith(l, '|')) or {T.strip(text)} rlike r'{PAGE_MARK}' or size(filter(rs, l -> l rlike r'{LEADER}')) / size(rs) >= 0.6D)"
    kind = f"case when size(rs) = 0 then 'P' when {listing} then if({short}, 'B', 'L') when {short} then 'H' else 'P' end"
    return f"element_at(transform(array({_bare_lines(text)}), rs -> {kind}), 1)"


def is_contents_heading(text: str = "text") -> str:
    title = T.strip(rf"regexp_replace(regexp_extract(rs[0], r'{HEADING}', 2), r'[*_]+', '')")
    is_one = f"size(rs) = 1 and lower({title}) in ({', '.join(repr(c) for c in CONTENTS)})"
    # Few blocks start like a heading; only those are split.
    return rf"({text} rlike r'^\s*#' and element_at(transform(array({_bare_lines(text)}), rs -> {is_one}), 1))"


def without_contents(rows: DataFrame) -> DataFrame:
    """``blocks`` rows without the printed table of contents.

    Each block after the first contents heading is one letter of its document's
    shape; one pattern on the shape tells how many blocks go.  Only documents
    with such a heading are classified, and the shape is aggregated once per
    document; rows are partitioned by document throughout.
    """
    w = Window.partitionBy("doc_id")
    rows = rows.withColumn("__head", F.expr(is_contents_heading()))
    rows = rows.withColumn("__rank", F.row_number().over(w.orderBy("block_no")))
    rows = rows.withColumn("__first", F.min(F.when(F.col("__head"), F.col("__rank"))).over(w))
    after = rows.where(F.col("__rank") > F.col("__first")).select("doc_id", F.struct("__rank", F.expr(block_kind()).alias("kind")).alias("k"))
    shape = F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda x: x["kind"]), "")
    gone = after.groupBy(F.col("doc_id").alias("__doc")).agg(F.length(F.regexp_extract(shape, r"^(?:[LB]|H[HB]*L|H[HB]*B)+", 0)).alias("__n"))
    out = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("__doc")), "left")
    drop = (F.col("__n") > 0) & F.col("__rank").between(F.col("__first"), F.col("__first") + F.col("__n"))
    return out.where(~F.coalesce(drop, F.lit(False))).drop("__head", "__rank", "__first", "__doc", "__n")


def without_watermarks(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """``blocks`` rows without those that are only one of ``hosts`` (host), or a path below one."""
    h = hosts.select(F.expr(T.host("host")).alias("__host")).where("__host <> ''").distinct()
    rows = rows.withColumn("__key", F.expr(T.host("text")))
    # A block is a host or below it exactly if what stands before its first slash is the host.
    single = ~F.col("__key").rlike(T.WS)
    rows = rows.withColumn("__base", F.when(single, F.substring_index("__key", "/", 1)))
    return rows.join(h, F.col("__base") == F.col("__host"), "left_anti").drop("__key", "__base")


def with_heading_ids(rows: DataFrame) -> DataFrame:
    """``lines`` rows with `` {#sec-0001}`` after each heading outside fences, numbered by document.

    A fence line with an info string opens; one without turns the state over;
    so the state is the parity of turns since the last opening.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    bare = F.expr(T.strip("line"))
    turn, opens = bare.rlike(FENCE_CLOSE), bare.rlike(FENCE_OPEN) & ~bare.rlike(FENCE_CLOSE)
    rows = rows.withColumn("__turn", turn.cast("int")).withColumn("__opens", opens.cast("int"))
    rows = rows.withColumn("__turns", F.coalesce(F.sum("__turn").over(before), F.lit(0)))
    base = F.last(F.when(F.col("__opens") == 1, F.col("__turns")), True).over(before)
    inside = F.when(base.isNull(), F.col("__turns") % 2).otherwise((F.lit(1) + F.col("__turns") - base) % 2)
    rows = rows.withColumn("__inside", inside)
    heading = (F.col("__inside") == 0) & (F.col("__turn") == 0) & (F.col("__opens") == 0) & F.col("line").rlike(HEADING)
    rows = rows.withColumn("__heading", heading.cast("int")).withColumn("__no", F.sum("__heading").over(w))
    new = F.concat(F.regexp_replace("line", r"[ \t]+\z", ""), F.format_string(" {#sec-%04d}", F.col("__no").cast("int")))
    return rows.withColumn("line", F.when(F.col("__heading") == 1, new).otherwise(F.col("line"))).drop("__turn", "__opens", "__turns", "__inside", "__heading", "__no")
