"""Queries of the catalog for model stages, checkpoints, packages and run reports.

Models are offline stand-ins whose answers SQL can repeat: letters exchanged for
Cyrillic ones, refusals by a word part, JSON made from the text's length.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import replace
from html import escape

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.lineage import cut, shared_folder, stored
from ..operators import batches, checkpoints, gates, pack, report, stage, units, wire
from ..sources import book, epub, markdown
from . import packages
from .catalog import _DACCEPT, _DTAIL, NL, _dpack, _dpseudo, _ds, _dw, _docs, _t, _turns, query

PSEUDO = stage.Transform("pseudo-1", stage.pseudo, delay=0)


# ---- model stages ----
@query(rf"""with recursive u as (select conv_id, turn, {_dw('text')} as n_words from conversations), {_dpack('u', 'conv_id', 'turn', 60)}, {_DTAIL},
c as (select k, o, (case when chunk_no = last and last > 1 and t < 0.3 * 60 then chunk_no - 1 else chunk_no end)::int as chunk_no, text as source,
 regexp_replace({_dpseudo('text')}, '^\n+|\n+$', '', 'g') as candidate from t2 join conversations on conv_id = k and turn = o), f as (select *, {_DACCEPT} as failed from c)
select k as doc_id, o as unit_no, chunk_no, case when failed is null then candidate else source end as final, case when failed is null then 'ok' else 'verbatim' end as status from f""")
def translate_chunks(spark, d):
    rows = _turns(spark, d).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("unit_no"), "n_words", "text", F.col("text").alias("source"))
    done = batches.in_chunks(rows, PSEUDO, gates.translation_gate(target="'bg'"), target=60)
    return done.select("doc_id", "unit_no", "chunk_no", "final", "status")


def _refusing(system: str, text: str) -> str:
    if "tion" in text:
        raise stage.Blocked()
    return stage.pseudo(system, text)


@query(rf"""with p as (select doc_id, list_filter(string_split(text, {NL}), lambda x: {_ds('x')} <> '') as ps from documents)
select doc_id, array_to_string(list_transform(ps, lambda x: case when contains(x, 'tion') then x else {_dpseudo('x')} end), {NL} || {NL}) as cleaned,
 case when len(list_filter(ps, lambda x: contains(x, 'tion'))) > 0 then 'verbatim' else 'ok' end as status from p""")
def cleaned_chunks(spark, d):
    """Refused chunks are cleaned by halves, down to the paragraphs that stay as they are."""
    done = stage.cleaned(_docs(spark, d, r"replace(text, '\n', '\n\n')"), stage.Transform("refusing", _refusing, retries=1, delay=0))
    return done.select("doc_id", "cleaned", "status")


def _answer(system: str, text: str) -> str:
    return "```json\n" + json.dumps({"title": f" T\n{len(text)} ", "author": None, "language": "en" if len(text) % 2 else "no tag"}) + "\n```"


@query("""with n as (select doc_id, least(8000, length(text)) as n from documents)
select doc_id, 'T ' || n as title, null::varchar as author, case when n % 2 = 1 then 'en' end as language from n""")
def metadata_answers(spark, d):
    return stage.metadata(_docs(spark, d), stage.Transform("length", _answer, delay=0)).select("doc_id", "title", "author", "language")


@query(rf"""with p as (select doc_id, list_filter(string_split(text, {NL}), lambda x: {_ds('x')} <> '') as ps from documents)
select doc_id, array_to_string(list_transform(ps, lambda x: {_dpseudo('x')}), {NL} || {NL}) as cleaned, 'ok' as status, 0 as attempts from p""")
def resumed_cleaning(spark, d):
    """A second run over a store asks for nothing: its model would refuse."""
    docs = _docs(spark, d, r"replace(text, '\n', '\n\n')")
    store = f"{shared_folder(spark)}/cleaned-{uuid.uuid4().hex}"
    stage.cleaned(docs, PSEUDO, store=store).write.format("noop").mode("overwrite").save()
    return stage.cleaned(docs, replace(PSEUDO, fn=_refused), store=store).select("doc_id", "cleaned", "status", "attempts")


def _refused(system: str, text: str) -> str:
    raise stage.Blocked()


def _fallback(system: str, text: str) -> str:
    if "ing" in text:
        raise stage.Empty()
    return text.upper()


@query(f"select conv_id, turn, case when not contains(text, 'tion') then {_dpseudo('text')} when not contains(text, 'ing') then upper(text) end as answer, case when not contains(text, 'tion') then 'ok' when not contains(text, 'ing') then 'fallback' else 'failed' end as status from conversations")
def retry_ladder(spark, d):
    """What the first model refuses goes to the second one, with all its tries."""
    second = stage.Transform("upper", _fallback, retries=1, delay=0)
    first = stage.Transform("refusing", _refusing, retries=1, delay=0, fallback=second)
    rows = _t(spark, d, "conversations").select("conv_id", "turn", "text")
    return stage.answered(rows, first).select("conv_id", "turn", "answer", "status")


_STALE = _DACCEPT.replace("candidate", "stale")


@query(rf"""with c as (select conv_id, turn, text as source, regexp_replace(text, '^\n+|\n+$', '', 'g') as stale, regexp_replace({_dpseudo('text')}, '^\n+|\n+$', '', 'g') as candidate from conversations),
f as (select *, {_STALE} as was, {_DACCEPT} as failed from c)
select conv_id as doc_id, turn as unit_no, case when was is null then stale when failed is null then candidate else source end as final, case when was is null then 'ok' when failed is null then 'retried' else 'verbatim' end as status from f""")
def kept_answers(spark, d):
    """Answers kept from a run that returned texts as they were: those that fail the gates are asked for again, alone."""
    rows = _turns(spark, d).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("unit_no"), "n_words", "text", F.col("text").alias("source"))
    store, gate = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}", gates.translation_gate(target="'bg'")
    chunks = wire.render(pack.with_tail_merged(pack.packed(rows, 60, order="unit_no"), 60).withColumn("no", F.row_number().over(Window.partitionBy("doc_id", "chunk_no").orderBy("unit_no"))), ["doc_id", "chunk_no"], "no")
    batches.remembered(chunks, replace(PSEUDO, fn=stage.identity), "", "payload", store, "units").write.format("noop").mode("overwrite").save()
    return batches.in_chunks(rows, PSEUDO, gate, target=60, store=store).select("doc_id", "unit_no", "final", "status")


# ---- checkpoints ----
@query("select conv_id::varchar as chunk_key, turn::int as unit_no, text, case when conv_id % 2 = 0 then substring(sha1(text), 1, 16) end as source_fp from conversations where text is not null")
def checkpoint_import(spark, d):
    """Files of the format with fingerprints and of the flat one before it."""
    rows = _t(spark, d, "conversations").where("text is not null").withColumn("k", F.col("turn").cast("string"))
    two = F.to_json(F.struct(F.lit(2).alias("format"), F.map_from_entries(F.collect_list(F.struct("k", F.struct(F.col("text").alias("t"), F.expr(T.fingerprint("text")).alias("s"))))).alias("units")))
    flat = F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "text"))))
    raw = F.when(F.col("conv_id") % 2 == 0, two).otherwise(flat)
    files = rows.groupBy("conv_id").agg(raw.alias("raw")).select(F.col("conv_id").cast("string").alias("chunk_key"), "raw", F.timestamp_seconds(F.lit(0)).alias("mtime"))
    return checkpoints.imported(files).select("chunk_key", "unit_no", "text", "source_fp")


@query("select user_id as chunk_no, arg_max(event_type, event_id) as key, max(event_id)::varchar as raw from events group by user_id")
def newest_checkpoint(spark, d):
    files = _t(spark, d, "events").select(F.col("user_id").alias("chunk_no"), F.col("event_type").alias("key"), F.col("event_id").cast("string").alias("raw"), F.timestamp_seconds("event_id").alias("mtime"))
    return checkpoints.newest_file(files).select("chunk_no", "key", "raw")


# ---- sources and sinks ----
@query(rf"""with f as (select conv_id, turn, string_agg('![](images/' || printf('fig-%04d-%02d.png', turn::int, k::int) || ')', {NL} || {NL} order by k) as refs from (select conv_id, turn, unnest([0, 1]) as k from conversations where turn % 3 = 0) group by 1, 2),
p as (select conv_id, turn, nullif(regexp_replace(text, '\s+$', ''), '') as t, refs from conversations left join f using (conv_id, turn)), q as (select conv_id, turn, case when t is null then refs when refs is null then t else t || {NL} || {NL} || refs end as t from p)
select conv_id as doc_id, string_agg(t, {NL} || {NL} order by turn) as text from q where t is not null group by 1""")
def pages_with_figures(spark, d):
    pages = _t(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("page"), "text")
    figs = pages.where("page % 3 = 0").select("book_id", "page", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    figs = figs.withColumn("file_name", F.format_string("fig-%04d-%02d.png", "page", "k"))
    return markdown.pages_with_figures(pages, figs)


@query("select p_partkey, replace('![a](images/x.png) ' || p_name || ' [b](image/y)', '](images/', '](images/' || lower(p_brand) || '/') as text from part")
def image_folder(spark, d):
    rows = _t(spark, d, "part").select("p_partkey", F.expr("concat('![a](images/x.png) ', p_name, ' [b](image/y)')").alias("text"), F.lower("p_brand").alias("slug"))
    return rows.select("p_partkey", markdown.with_image_folder().alias("text"))


@query(f"select string_agg('- ' || n_name || ' -> ' || lower(n_name), {NL} order by n_name) as block from nation")
def glossary_block(spark, d):
    terms = _t(spark, d, "nation").select(F.col("n_name").alias("src"), F.lower("n_name").alias("dst"))
    return spark.createDataFrame([(wire.glossary_prompt(terms),)], "block string")


def _books(batches_):
    for batch in batches_:
        made = []
        for text in batch.column(1).to_pylist():
            lines = (text or "").split("\n")
            made.append(epub.compiled("T", "A", "en", [(f"Part {k}", "".join(f"<p>{escape(x)}</p>" for x in lines[k::2])) for k in (0, 1)]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["book_id", "content"])


@query(f"""with l as (select doc_id, unnest(list_zip(range(0, len(string_split(text, {NL}))), string_split(text, {NL}))) as z from documents), x as (select doc_id, (z[1] % 2 + 1)::int as pos, z[2] as t from l)
select doc_id::varchar as book_id, pos, count(*)::bigint as units, sum({_dw('t')})::bigint as n_words from x where {_ds('t')} <> '' group by 1, 2""")
def package_units(spark, d):
    """Documents compiled to packages, unpacked, and read in order of the spine."""
    found = stored(epub.entries(_compiled(spark, d)))
    spine = epub.spine_documents(epub.packages(found), found)
    docs = found.join(spine, ["book_id", "name"]).select(F.xxhash64("book_id", "name").alias("doc_id"), "book_id", "pos", F.col("content").cast("string").alias("html"))
    by = units.units(docs.select("doc_id", "html")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.sum("n_words").alias("n_words"))
    return docs.select("doc_id", "book_id", "pos").join(by, "doc_id").select("book_id", "pos", "units", "n_words")


def _compiled(spark, d):
    return _docs(spark, d).select(F.col("doc_id").cast("string").alias("book_id"), "text").mapInArrow(_books, "book_id string, content binary")


_DPAGE = """$$<?xml version='1.0' encoding='UTF-8'?>$$ || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml"><head><title>' || {t} || '</title></head><body>' || {b} || '</body></html>'"""


@query(f"""with l as (select doc_id, unnest(list_zip(range(0, len(string_split(text, {NL}))), string_split(text, {NL}))) as z from documents), x as (select doc_id, z[1] as i, z[2] as t from l), k as (select doc_id, k from documents, (values (0), (1)) v(k)),
c as (select k.doc_id, k.k, coalesce(string_agg('<p>' || replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), $$'$$, '&#x27;') || '</p>', '' order by i), '') as b from k left join x on x.doc_id = k.doc_id and x.i % 2 = k.k group by 1, 2)
select doc_id::varchar as book_id, printf('OPS/ch%04d.xhtml', k + 1) as name, {_DPAGE.format(t="'Part ' || k", b='b')} as text from c""")
def package_repack(spark, d):
    """Packages unpacked, packed again and unpacked: every chapter is what it was."""
    again = epub.entries(epub.repacked(epub.entries(_compiled(spark, d))))
    return again.where("name like 'OPS/ch%'").select("book_id", "name", F.col("content").cast("string").alias("text"))


_BARE = ("translate(text, '0123456789#*_`[]<>|&\\\\~+-=!>.)', 'abcdefghij')", "translate(text, '0123456789#*_`[]<>|&\\~+-=!>.)', 'abcdefghij')")


@query(f"""with s as (select doc_id, {_BARE[1]} as text from documents), x as (select doc_id, unnest(string_split(text, {NL})) as t from s),
w as (select doc_id, count(*) as n, sum({_dw('t')}) as words from x where {_ds('t')} <> '' group by 1)
select doc_id::varchar as book_id, pos::int as pos, case when pos = 1 then 3 else 1 + n end::bigint as units, case when pos = 1 then 6 else 2 + words end::bigint as n_words, case when pos = 1 then 'Part one' else 'Part two' end as title
from (select doc_id, coalesce(n, 0) as n, coalesce(words, 0) as words from documents left join w using (doc_id)), (values (1), (2)) v(pos)""")
def markdown_packages(spark, d):
    """Markdown with front matter and two chapters, compiled to packages and read again."""
    text = rf"concat('---\ntitle: \"T ', doc_id, '\"\nlang: \"de\"\n---\n\n# Part *one* {{#sec-0001}}\n\n- first item\n- **second** [item](x)\n\n## Part two {{#sec-0002}}\n\n', replace({_BARE[0]}, '\n', '\n\n'))"
    books = book.packages(_docs(spark, d, text))
    found = stored(epub.entries(books.withColumnRenamed("doc_id", "book_id")))
    spine = epub.spine_documents(epub.packages(found), found)
    docs = cut(found.join(spine, ["book_id", "name"]).select(F.xxhash64("book_id", "name").alias("doc_id"), "book_id", "pos", F.col("content").cast("string").alias("html")))
    by = units.units(docs.select("doc_id", "html")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.sum("n_words").alias("n_words"))
    return docs.join(by, "doc_id").select("book_id", "pos", "units", "n_words", F.regexp_extract("html", "<title>([^<]*)<", 1).alias("title"))


@query("select doc_id::varchar as book_id, 'OPS/nav.xhtml' as name from documents")
def package_navigation(spark, d):
    found = stored(epub.entries(_compiled(spark, d)))
    return epub.nav_documents(epub.packages(found), found)


@query(f"select doc_id::varchar as book_id, k::int as label_no, 'Part ' || (k - 1) as text, {_dpseudo("'Part ' || (k - 1)")} as final from documents, (values (1), (2)) v(k)")
def navigation_labels(spark, d):
    """The labels of a package's navigation, in one call per document."""
    found = stored(epub.entries(_compiled(spark, d)))
    docs = packages._documents(found, epub.nav_documents(epub.packages(found), found))
    labels = packages.translated_labels(docs.select("doc_id", "html"), PSEUDO, gates.label_gate(target="'bg'"))
    return docs.select("doc_id", "book_id").join(labels, "doc_id").select("book_id", "label_no", "text", "final")


@query("select doc_id::varchar as book_id, 'T (BG)' as title, 'bg' as language, 1 as languages from documents")
def package_metadata(spark, d):
    found = packages._with_metadata(epub.entries(_compiled(spark, d)), "bg", "(BG)").withColumn("x", F.col("content").cast("string"))
    return found.select("book_id", F.regexp_extract("x", "<dc:title>([^<]*)<", 1).alias("title"), F.regexp_extract("x", "<dc:language>([^<]*)<", 1).alias("language"), F.expr("size(regexp_extract_all(x, '<dc:language>', 0))").alias("languages"))


# ---- reports ----
@query("""with s as (select conv_id, turn, case turn % 7 when 0 then 'ok' when 1 then 'retried' when 2 then 'fallback' when 3 then 'verbatim' when 4 then 'blocked' when 5 then 'repaired' else 'cached' end as status from conversations)
select conv_id % 10 as book, count(*)::bigint as units, count_if(status = 'ok')::bigint as ok, count_if(status = 'retried')::bigint as retried, count_if(status = 'fallback')::bigint as fallback, count_if(status = 'verbatim')::bigint as verbatim,
 count_if(status = 'blocked')::bigint as blocked, count_if(status = 'repaired')::bigint as repaired, count_if(status = 'cached')::bigint as cached from s group by 1""")
def translation_report(spark, d):
    status = "case turn % 7 when 0 then 'ok' when 1 then 'retried' when 2 then 'fallback' when 3 then 'verbatim' when 4 then 'blocked' when 5 then 'repaired' else 'cached' end"
    return report.translation(_t(spark, d, "conversations").select(F.expr("conv_id % 10").alias("book"), F.expr(status).alias("status")), "book")


@query("select conv_id % 10 as book, case when turn % 3 = 0 then 'ok' else 'retried' end as status, count(*)::bigint as n from conversations group by 1, 2")
def status_counts(spark, d):
    return report.by_status(_t(spark, d, "conversations").select(F.expr("conv_id % 10").alias("book"), F.expr("if(turn % 3 = 0, 'ok', 'retried')").alias("status")), "book")


_RUN = "select conv_id as doc_id, turn as chunk_no, turn as unit_no, text, text as pre, case when turn % 3 = 0 and conv_id % 4 = 1 then 'new ' || text else text end as final, turn % 2 = 0 as was_untranslated, case turn % 5 when 0 then 'retried' when 1 then 'verbatim' else 'ok' end as status from conversations"


def _run(spark, d):
    rows = _t(spark, d, "conversations")
    final = F.expr("case when turn % 3 = 0 and conv_id % 4 = 1 then concat('new ', text) else text end").alias("final")
    status = F.expr("case turn % 5 when 0 then 'retried' when 1 then 'verbatim' else 'ok' end").alias("status")
    return rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_no"), F.col("turn").alias("unit_no"), "text", F.col("text").alias("pre"), final, F.expr("turn % 2 = 0").alias("was_untranslated"), status)


@query(f"""with r as ({_RUN}) select doc_id % 10 as book, count(*)::bigint as units, count_if(pre <> final)::bigint as changed, count_if(pre = final)::bigint as unchanged,
count_if(was_untranslated and pre <> final)::bigint as retranslated, count_if(status = 'retried')::bigint as retried, count_if(status = 'verbatim')::bigint as kept from (select * from r) group by 1""")
def polish_report(spark, d):
    return report.polish(_run(spark, d).withColumn("book", F.col("doc_id") % 10), "book")


@query(f"with r as ({_RUN}) select distinct doc_id from r where final <> text")
def touched_documents(spark, d):
    return report.touched(_run(spark, d))


@query(f"with r as ({_RUN}) select count_if(final <> text)::bigint as changed, count(*)::bigint as total from r")
def navigation_counts(spark, d):
    return report.labels(_run(spark, d))


@query(f"with r as ({_RUN}) select chunk_no, unit_no, pre, final from r where doc_id = (select min(doc_id) from r) order by chunk_no, unit_no limit 3")
def sample_pairs(spark, d):
    """The first three pairs of one run: a sample to look at."""
    rows = _run(spark, d)
    first = rows.agg(F.min("doc_id").alias("doc_id"))
    return report.sample_pairs(rows.join(first, "doc_id", "left_semi"), 3)


@query("select user_id % 5 as book_id, count(*)::bigint as figures, count(distinct event_id % 7)::bigint as pages from events group by 1")
def figure_counts(spark, d):
    return report.figures(_t(spark, d, "events").selectExpr("user_id % 5 as book_id", "event_id % 7 as page"))
