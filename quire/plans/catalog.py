"""One query per operator over the driver's tables, and its SQL in DuckDB's dialect.

The tables lack headings, rules, fences, markup and Cyrillic, so queries derive
their input by a rule that the SQL repeats: lines as blocks, words regrouped in
blocks of forty, scaffold lines put in by ``doc_id``, letters exchanged for
Cyrillic ones, first words wrapped in placeholders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import placeholders as P
from ..functions import text as T
from ..operators import blocks as B
from ..operators import checkpoints, figures, gates, pack, report, stage, units, wire
from ..sources import epub, markdown
from . import pipelines

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NL = "chr(10)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str, text: str = "text") -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.expr(text).alias("text"))


# ---- the same pieces in DuckDB ----
def _dw(s: str) -> str:
    return rf"len(list_filter(string_split_regex({s}, '\s+'), lambda w: w <> ''))"


def _ds(s: str) -> str:
    return rf"regexp_replace({s}, '^\s+|\s+$', '', 'g')"


def _dplain(s: str) -> str:
    return rf"regexp_replace({s}, '\[\[/?\d+/?\]\]', ' ', 'g')"


def _dletters(s: str) -> str:
    return rf"length(regexp_replace({s}, '[^\p{{L}}]', '', 'g'))"


def _dcyr(s: str) -> str:
    return rf"(case when {_dletters(s)} = 0 then 0.0::double else length(regexp_replace({s}, '[^\x{{0400}}-\x{{04FF}}]', '', 'g'))::double / {_dletters(s)} end)"


def _dpseudo(s: str) -> str:
    return f"translate({s}, '{T.LATIN}', '{T.CYRILLIC}')"


def _dfold(s: str) -> str:
    return rf"trim(regexp_replace(replace(lower({_dplain(s)}), 'ß', 'ss'), '\s+', ' ', 'g'))"


def _duntranslated(s: str) -> str:
    t = _dplain(s)
    w, n, c = _dw(t), _dletters(t), _dcyr(t)
    return f"({n} > 0 and {c} < 0.5 and (({w} >= 8 and {n} >= 24) or (1 - {c} >= 0.9 and {w} >= 4 and {n} >= 12) or (1 - {c} >= 0.9 and {w} >= 3 and {n} >= 16)))"


_DLINES = rf"""
lines as (select doc_id, {_ds('x.l')} as text, x.p as p from (select doc_id, unnest(list_zip(string_split(text, {NL}), range(1, len(string_split(text, {NL})) + 1))) as z from src) s, lateral (select z[1] as l, z[2] as p) x),
blocks as (select doc_id, row_number() over (partition by doc_id order by p) as block_no, text, {_dw('text')} as n_words from lines where text <> '')"""
_DBLOCKS = rf"""
parts as (select doc_id, unnest(list_zip(string_split_regex(text, '\n\s*\n'), range(1, len(string_split_regex(text, '\n\s*\n')) + 1))) as z from src),
blocks as (select doc_id, row_number() over (partition by doc_id order by z[2]) as block_no, {_ds('z[1]')} as text from parts where {_ds('z[1]')} <> '')"""


def _dpack(items: str, key: str, order: str, target: int) -> str:
    """Greedy packing as a recursion over items numbered n by key."""
    return f"""
items as (select {key} as k, {order} as o, n_words, row_number() over (partition by {key} order by {order}) as n from {items}),
packed as (select k, o, n_words, n, 1 as chunk_no, n_words as size from items where n = 1
 union all select i.k, i.o, i.n_words, i.n, case when p.size + i.n_words > {target} then p.chunk_no + 1 else p.chunk_no end,
 case when p.size + i.n_words > {target} then i.n_words else p.size + i.n_words end from packed p join items i on i.k = p.k and i.n = p.n + 1)"""


# ---- chunk plans ----
@query(f"""with recursive src as (select doc_id, text from documents), {_DLINES}, {_dpack('blocks', 'doc_id', 'block_no', 200)}
select k as doc_id, chunk_no::int as chunk_no, sum(n_words)::bigint as n_words, min(o)::int as block_from, max(o)::int as block_to from packed group by k, chunk_no""")
def chunk_plan(spark, d):
    rows = pack.packed(B.line_blocks(_docs(spark, d)), 200)
    return rows.groupBy("doc_id", "chunk_no").agg(F.sum("n_words").alias("n_words"), F.min("block_no").alias("block_from"), F.max("block_no").alias("block_to"))


def _turns(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.expr(f"{T.word_count('text')}").alias("n_words"), "text")


_DTAIL = "tail as (select *, max(chunk_no) over (partition by k) as last from packed), t2 as (select *, sum(case when chunk_no = last then n_words end) over (partition by k) as t from tail)"


@query(f"""with recursive u as (select conv_id, turn, {_dw('text')} as n_words from conversations), {_dpack('u', 'conv_id', 'turn', 60)}, {_DTAIL}
select k as conv_id, o as turn, (case when chunk_no = last and last > 1 and t < 0.3 * 60 then chunk_no - 1 else chunk_no end)::int as chunk_no from t2""")
def unit_chunk_plan_tail(spark, d):
    rows = pack.packed(_turns(spark, d).select("conv_id", "turn", "n_words"), 60, "conv_id", "turn")
    return pack.with_tail_merged(rows, 60, key="conv_id").select("conv_id", "turn", "chunk_no")


@query(f"""with recursive u as (select conv_id % 10 as book, conv_id * 1000 + turn as pos, {_dw('text')} as n_words from conversations), {_dpack('u', 'book', 'pos', 1000)}, {_DTAIL},
f as (select k as book, o as pos, (case when chunk_no = last and last > 1 and t < 300 then chunk_no - 1 else chunk_no end)::int as chunk_no from t2)
select book, pos, chunk_no, dense_rank() over (partition by book order by chunk_no)::int as job_no from f""")
def polish_chunk_plan(spark, d):
    rows = _turns(spark, d).select(F.expr("conv_id % 10").alias("book"), F.expr("conv_id * 1000 + turn").alias("pos"), "n_words")
    rows = pack.with_tail_merged(pack.packed(rows, 1000, "book", "pos"), 1000, key="book")
    return pack.numbered(rows.withColumn("one", F.lit(1)), "book", "one").select("book", "pos", "chunk_no", "job_no")


@query(f"""with recursive src as (select doc_id, text from documents), {_DLINES}, {_dpack('blocks', 'doc_id', 'block_no', 200)}
select k as doc_id, o::int as block_no, chunk_no::int as chunk_no from packed where chunk_no <= 2""")
def first_chunks(spark, d):
    rows = pack.packed_natively(B.line_blocks(_docs(spark, d)).select("doc_id", "block_no", F.col("n_words").cast("bigint")), 200)
    return pack.first_chunks(rows, 2).select("doc_id", "block_no", "chunk_no")


# ---- text functions ----
@query(f"select doc_id, {_dw('text')}::int as n_words, len(string_split(text, {NL}))::int as n_lines from documents")
def word_counts(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.expr(T.word_count("text")).alias("n_words"), F.size(F.expr(T.lines("text"))).alias("n_lines"))


@query(f"select source, count(*)::bigint as docs, sum({_dw('text')})::bigint as n_words from documents where contains(source, 'c1') group by source")
def document_filter(spark, d):
    """The filter on names reaches the scan; texts are read for what passes only."""
    docs = _t(spark, d, "documents").where(F.col("source").contains("c1"))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.expr(T.word_count("text"))).alias("n_words"))


@query(r"""select p_partkey, case when s = '' then 'book' else s end as slug from (select p_partkey,
regexp_replace(regexp_replace(lower(trim(p_name || ' — ' || p_brand || '!')), '[^\p{L}\p{N}_]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') as s from part)""")
def slugs(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.expr(T.slug("concat(p_name, ' — ', p_brand, '!')")).alias("slug"))


@query(r"""select doc_id, case when regexp_full_match(trim(tag), '[A-Za-z]{2,3}(-[A-Za-z0-9]{1,8})*') then trim(tag) end as language, coalesce(case lang when 'en' then 'English' when 'de' then 'German' when 'fr' then 'French' when 'es' then 'Spanish' end, lang) as language_name
from (select doc_id, lang, case doc_id % 3 when 0 then ' ' || lang || '-X1 ' when 1 then lang else lang || '_bad' end as tag from documents)""")
def languages(spark, d):
    tag = "case doc_id % 3 when 0 then concat(' ', lang, '-X1 ') when 1 then lang else concat(lang, '_bad') end"
    rows = _t(spark, d, "documents").select("doc_id", "lang", F.expr(tag).alias("tag"))
    return rows.select("doc_id", F.expr(T.language("tag")).alias("language"), F.expr(T.language_name("lang")).alias("language_name"))


@query(r"select doc_id, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') as line from documents")
def single_line(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.expr(T.single_line("text")).alias("line"))


@query(f"""select doc_id, '---' || {NL} || 'title: "' || replace(replace(source || ' "q" \\ ' || lang, '\\', '\\\\'), '"', '\\"') || '"' || {NL} || 'author: "' || source || '"' || {NL} || 'lang: "' || lang || '"' || {NL} || '---' || {NL} || {NL} as head from documents""")
def frontmatter(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.expr(r"""concat(source, r' "q" \ ', lang)""").alias("title"), F.col("source").alias("author"), F.col("lang").alias("language"))
    return rows.select("doc_id", markdown.frontmatter().alias("head"))


@query(r"select doc_id, case when doc_id % 2 = 0 then regexp_replace(text, '\n$', '') else text end as text from documents")
def fence_strip(spark, d):
    text = r"case when doc_id % 2 = 0 then concat('```markdown\n', text, '\n```\n') else text end"
    return _docs(spark, d, text).select("doc_id", F.expr(T.unfenced("text")).alias("text"))


_MIXED = "case when doc_id % 3 = 0 then {p} else text end"


@query(f"select doc_id, round({_dcyr('t')}, 9) as ratio, {_duntranslated('t')} as untranslated from (select doc_id, {_MIXED.format(p=_dpseudo('text'))} as t from documents)")
def cyrillic_ratio(spark, d):
    rows = _docs(spark, d, _MIXED.format(p=T.pseudo_translated("text")))
    return rows.select("doc_id", F.expr(f"round({T.cyrillic_ratio('text')}, 9)").alias("ratio"), F.expr(T.looks_untranslated("text")).alias("untranslated"))


@query(f"select doc_id, text from (select doc_id, {_MIXED.format(p=_dpseudo('text'))} as text from documents) where {_duntranslated('text')}")
def untranslated_only(spark, d):
    rows = _docs(spark, d, _MIXED.format(p=T.pseudo_translated("text")))
    return rows.where(F.expr(T.looks_untranslated("text")))


@query("select doc_id, substring(sha1(text), 1, 16) as fp, substring(sha1('clean' || chr(0) || 'pseudo-1' || chr(0) || text), 1, 10) as key from documents".replace("chr(0)", "chr(1)"))
def fingerprints(spark, d):
    key = T.cache_key("'clean'", "'pseudo-1'", "text").replace("char(0)", "char(1)")
    return _t(spark, d, "documents").select("doc_id", F.expr(T.fingerprint("text")).alias("fp"), F.expr(key).alias("key"))


@query(f"select doc_id, ({_dw(_dfold('a'))} >= 8 and {_dfold('a')} = {_dfold('b')}) as echo from (select doc_id, text as a, case when doc_id % 3 = 0 then '[[1]]' || upper(text) || '[[/1]]' when doc_id % 3 = 1 then {_dpseudo('text')} else text || ' x' end as b from documents)")
def echo_gate(spark, d):
    cand = f"case when doc_id % 3 = 0 then concat('[[1]]', upper(text), '[[/1]]') when doc_id % 3 = 1 then {T.pseudo_translated('text')} else concat(text, ' x') end"
    rows = _t(spark, d, "documents").select("doc_id", F.col("text").alias("a"), F.expr(cand).alias("b"))
    return rows.select("doc_id", F.expr(T.is_echo("a", "b")).alias("echo"))


@query("select doc_id, least(16384, greatest(512, floor(greatest(64, length(text) // 3) * 1.8::double)))::int as budget from documents")
def token_budgets(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.expr(T.token_budget("text")).alias("budget"))


@query(r"select page_id, regexp_replace(lower(regexp_replace(url, '^(https?://)?(www\.)?', '', 'i')), '/+$', '') as host from pages")
def host_normalise(spark, d):
    return _t(spark, d, "pages").select("page_id", F.expr(T.host("concat('**', url, '**')")).alias("host"))


@query(f"select doc_id, {_ds('text')} as text from documents")
def label_strip(spark, d):
    text = r"case when doc_id % 4 = 0 then concat('[BG]\n', text, '\n[EN]\nother') when doc_id % 4 = 1 then concat('[BG]', text) else text end"
    return _docs(spark, d, text).select("doc_id", F.expr(T.strip(T.without_labels("text"))).alias("text"))


# ---- blocks ----
_ART = "case when doc_id % 2 = 0 then replace(text, {nl}, concat({nl}, {nl}, '---', {nl}, ' ', {nl}, cast(doc_id % 900 as {s}), {nl})) else replace(text, {nl}, concat({nl}, '12', {nl})) end"


@query(rf"""with src as (select doc_id, {_ART.format(nl=NL, s='varchar')} as text from documents),
l as (select doc_id, z[2]::int - 1 as line_no, z[1] as line from (select doc_id, unnest(list_zip(string_split(text, {NL}), range(1, len(string_split(text, {NL})) + 1))) as z from src)),
r as (select *, case when trim(line) <> '' then regexp_full_match(trim(line), '-{{3,}}') end as rule from l),
n as (select *, coalesce(last_value(rule ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), false)
 or coalesce(first_value(rule ignore nulls) over (partition by doc_id order by line_no rows between 1 following and unbounded following), false) as near from r)
select doc_id, line_no::int as line_no, line from n where not coalesce(rule, false) and not (regexp_full_match(trim(line), '\d{{1,4}}') and near)""")
def page_artifacts(spark, d):
    return B.without_page_artifacts(B.lines(_docs(spark, d, _ART.format(nl="char(10)", s="string"))))


@query(rf"""with w as (select doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') as ws from documents),
b as (select doc_id, i + 1 as block_no, array_to_string(ws[i * 40 + 1 : i * 40 + 40], ' ') as text from (select doc_id, ws, unnest(range(0, (len(ws) + 39) // 40)) as i from w)),
j as (select *, lag(text) over (partition by doc_id order by block_no) as prev from b),
k as (select *, case when prev is not null and not regexp_matches(text, '^(#|!\[)') and not regexp_matches(prev, '^(#|!\[)') and right(prev, 1) not in ('.', '!', '?', '…', ':', ';', '"', '''', '»', ')', '*')
 and regexp_matches(text, '^\p{{Ll}}') then 0 else 1 end as new from j),
i as (select *, sum(new) over (partition by doc_id order by block_no) as island from k),
e as (select *, case when right(text, 1) = '-' and lead(new) over (partition by doc_id order by block_no) = 0 then left(text, -1 + length(text)) when lead(new) over (partition by doc_id order by block_no) = 0 then text || ' ' else text end as piece from i)
select doc_id, island::int as block_no, string_agg(piece, '' order by block_no) as text from e group by doc_id, island""")
def merge_paragraphs(spark, d):
    words = rf"filter(split(text, r'{T.WS}+'), w -> w <> '')"
    rows = _docs(spark, d).select("doc_id", F.expr(words).alias("ws")).where("size(ws) > 0")
    parts = rows.select("doc_id", F.posexplode(F.expr("transform(sequence(0, (size(ws) - 1) div 40), i -> array_join(slice(ws, i * 40 + 1, 40), ' '))")).alias("p", "text"))
    return B.merged_paragraphs(parts.select("doc_id", (F.col("p") + 1).alias("block_no"), "text")).select("doc_id", "block_no", "text")


_TOC = (
    "case doc_id % 4 when 0 then concat('Intro.', {b}, '## **Contents**', {b}, 'One ....... 12', {b}, '# A short one', {b}, '**7**', {b}, '| two | 9 |', {b}, '## Real heading', {b}, text)"
    " when 1 then concat('# Contents', {b}, text) when 2 then concat('### Table of contents', {b}, '# H', {b}, 'Two…… 30', {b}, text) else text end"
)


@query(rf"""with src as (select doc_id, {_TOC.format(b=f'{NL} || {NL}')} as text from documents), {_DBLOCKS},
k as (select *, regexp_matches(text, '^#{{1,6}}[ \t]+.+$') and {_dw(r"regexp_replace(regexp_extract(text, '^#{1,6}[ \t]+(.+?)[ \t]*$', 1), '[*_]+', '', 'g')")} <= 8 as h, lower(trim(regexp_replace(regexp_extract(text, '^#{{1,6}}[ \t]+(.+?)[ \t]*$', 1), '[*_]+', '', 'g'))) in ('contents', 'table of contents') and not contains(text, {NL}) as head,
 list_bool_and(list_transform(string_split(text, {NL}), lambda l: starts_with(l, '|'))) or regexp_full_match(text, '\*{{0,2}}\d{{1,4}}\*{{0,2}}') or
 len(list_filter(string_split(text, {NL}), lambda l: regexp_full_match(l, '.+[.․…]{{2,}}\s*\d{{1,4}}\s*\|?\s*'))) / len(string_split(text, {NL})) >= 0.6 as lst from blocks),
m as (select *, case when lst and h then 'B' when lst then 'L' when h then 'H' else 'P' end as kind, min(case when head then block_no end) over (partition by doc_id) as hd from k),
s as (select doc_id, length(regexp_extract(string_agg(kind, '' order by block_no), '^([LB]|H[HB]*L|H[HB]*B)+')) as n from m where block_no > hd group by doc_id)
select m.doc_id, m.block_no::int as block_no, m.text from m left join s using (doc_id) where not coalesce(s.n > 0 and m.block_no between m.hd and m.hd + s.n, false)""")
def strip_toc(spark, d):
    docs = _docs(spark, d, _TOC.format(b="char(10), char(10)"))
    return B.without_contents(B.blocks(docs)).select("doc_id", "block_no", "text")


_HOST = r"regexp_extract(url, '^https?://([^/?#]+)', 1)"


@query(rf"""with h as (select page_id, {_HOST} as host from pages), hs as (select distinct regexp_replace(lower(host), '^www\.', '') as host from h where host not like '%.net'),
src as (select d.doc_id, case when doc_id % 3 = 0 then d.text || {NL} || {NL} || '*https://' || h.host || '/x*' || {NL} || {NL} || h.host || ' is said' else d.text end as text from documents d join h on h.page_id = d.doc_id % (select count(*) from pages)), {_DBLOCKS},
n as (select *, regexp_replace(lower(regexp_replace(regexp_replace(text, '^[*_()\[\]]+|[*_()\[\]]+$', '', 'g'), '^(https?://)?(www\.)?', '', 'i')), '/+$', '') as k from blocks)
select doc_id, block_no::int as block_no, text from n where regexp_matches(k, '\s') or string_split(k, '/')[1] not in (select host from hs)""")
def strip_watermarks(spark, d):
    h = _t(spark, d, "pages").select("page_id", F.expr(_HOST.replace("(url, '", "(url, r'")).alias("host"))
    n = h.agg(F.count(F.lit(1)).alias("n"))
    docs = _t(spark, d, "documents").join(F.broadcast(n)).withColumn("page", F.expr("doc_id % n")).join(h, F.expr("page_id = page"))
    text = r"case when doc_id % 3 = 0 then concat(text, '\n\n*https://', host, '/x*\n\n', host, ' is said') else text end"
    rows = B.blocks(docs.select("doc_id", F.expr(text).alias("text")))
    return B.without_watermarks(rows, h.where("host not like '%.net'").select("host")).select("doc_id", "block_no", "text")


_HEAD = "case doc_id % 3 when 0 then replace(text, {n}, concat({n}, '## Head  ', {n}, '```py', {n}, '# no', {n}, '```', {n})) when 1 then replace(text, {n}, concat({n}, '~~~', {n}, '# T', {n})) else concat('# Top', {n}, text) end"


@query(rf"""with src as (select doc_id, {_HEAD.format(n=NL)} as text from documents),
l as (select doc_id, z[2]::int - 1 as line_no, z[1] as line from (select doc_id, unnest(list_zip(string_split(text, {NL}), range(1, len(string_split(text, {NL})) + 1))) as z from src)),
f as (select *, regexp_full_match(trim(line), '(`{{3,}}|~{{3,}})\s*') as turn, regexp_full_match(trim(line), '`{{3,}}[^`]*|~{{3,}}.*') and not regexp_full_match(trim(line), '(`{{3,}}|~{{3,}})\s*') as opens from l),
g as (select *, coalesce(sum(turn::int) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as turns from f),
b as (select *, last_value(case when opens then turns end ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding) as base from g),
h as (select *, (case when base is null then turns % 2 else (1 + turns - base) % 2 end) = 0 and not turn and not opens and regexp_full_match(line, '#{{1,6}}[ \t]+.+') as heading from b),
c as (select *, sum(heading::int) over (partition by doc_id order by line_no) as no from h)
select doc_id, line_no::int as line_no, case when heading then regexp_replace(line, '[ \t]+$', '') || format(' {{{{#sec-{{:04d}}}}}}', no::int) else line end as line from c""")
def heading_ids(spark, d):
    return B.with_heading_ids(B.lines(_docs(spark, d, _HEAD.format(n="char(10)"))))


@query(rf"""with src as (select doc_id, case when doc_id % 2 = 0 then replace(text, {NL}, {NL} || {NL} || '![a b](images/x.png)' || {NL} || {NL}) else replace(text, {NL}, {NL} || {NL}) end as text from documents), {_DBLOCKS}
select doc_id, count_if(img)::bigint as images, sum(case when img then 0 else {_dw('text')} end)::bigint as n_words from (select *, regexp_full_match(text, '\s*!\[[^\]]*\]\([^)]*\)\s*') as img from blocks) group by doc_id""")
def image_bypass(spark, d):
    text = r"case when doc_id % 2 = 0 then replace(text, '\n', '\n\n![a b](images/x.png)\n\n') else replace(text, '\n', '\n\n') end"
    rows = B.blocks(_docs(spark, d, text)).withColumn("img", F.expr(T.is_image_block("text")))
    return rows.groupBy("doc_id").agg(F.count_if("img").alias("images"), F.sum(F.when(F.col("img"), 0).otherwise(F.col("n_words"))).alias("n_words"))


# ---- placeholders and gates ----
_W, _DWORD = "split(text, ' ')[0]", "string_split(text, ' ')[1]"


def _marked(w: str, pseudo: str, cat) -> tuple[str, str]:
    src = cat("'[[1]]'", w, "'[[/1]] '", "text", "' [[2/]]'")
    cases = {
        0: pseudo.replace("(text,", f"({src},"), 1: pseudo, 2: cat("'[[/1]]'", w, "'[[1]] '", pseudo, "' [[2/]]'"),
        3: cat("'[[1]][[/1]] '", pseudo, "' [[2/]]'"), 4: cat("'[[1]]'", w, "'[[/1]] [[2/]]'"), 5: src,
    }
    return src, "case conv_id % 6 " + " ".join(f"when {k} then {v}" for k, v in cases.items()) + " end"


def _candidates(spark, d):
    src, cand = _marked(_W, T.pseudo_translated("text"), lambda *x: f"concat({', '.join(x)})")
    return _t(spark, d, "conversations").select("conv_id", "turn", F.expr(src).alias("source"), F.expr(cand).alias("candidate"), F.lit("bg").alias("target"))


_dsrc, _dcand = _marked(_DWORD, _dpseudo("text"), lambda *x: f"({' || '.join(x)})")
_DC = f"c as (select conv_id, turn, {_dsrc} as source, {_dcand} as candidate from conversations)"
_DPAR = r"(list_sort(regexp_extract_all(source, '\[\[/?\d+/?\]\]')) = list_sort(regexp_extract_all({c}, '\[\[/?\d+/?\]\]')))"
_DNEST = "(case when strpos({c}, '[[1]]') = 0 and strpos({c}, '[[/1]]') = 0 then true else strpos({c}, '[[1]]') > 0 and strpos({c}, '[[1]]') < strpos({c}, '[[/1]]') end)"
_DSPAN = r"(trim(regexp_extract({c}, '(?s)\[\[1\]\](.*?)\[\[/1\]\]', 1)) <> '' or trim(regexp_extract(source, '(?s)\[\[1\]\](.*?)\[\[/1\]\]', 1)) = '')"


@query(f"with {_DC} select conv_id, turn, {_DPAR.format(c='candidate')} as parity, {_DNEST.format(c='candidate')} as nests, {_DSPAN.format(c='candidate')} as keeps from c")
def placeholder_checks(spark, d):
    rows = _candidates(spark, d)
    return rows.select("conv_id", "turn", F.expr(P.parity("source", "candidate")).alias("parity"), F.expr(P.applies("source", "candidate")).alias("nests"), F.expr(P.keeps_content("source", "candidate")).alias("keeps"))


def _dgate(gates_: list[tuple[str, str]]) -> str:
    return "case " + " ".join(f"when not ({ok}) then '{n}'" for n, ok in gates_) + " end"


_DACCEPT = _dgate([
    ("empty", f"{_ds('candidate')} <> ''"), ("parity", _DPAR.format(c="candidate")), ("nesting", _DNEST.format(c="candidate")), ("emphasis", _DSPAN.format(c="candidate")),
    ("length", f"{_dw(_dplain('source'))} < 12 or {_dw(_dplain('candidate'))}::double / {_dw(_dplain('source'))} between 0.5 and 1.9"),
    ("echo", f"not ({_dw(_dfold('source'))} >= 8 and {_dfold('source')} = {_dfold('candidate')})"),
    ("script", f"{_dw(_dplain('candidate'))} < 8 or {_dcyr(_dplain('candidate'))} >= 0.45"),
])


@query(f"with {_DC} select conv_id, turn, {_DACCEPT} as failed from c")
def accept_translation(spark, d):
    return _candidates(spark, d).select("conv_id", "turn", gates.translation_gate().alias("failed"))


_DPOLISH = _dgate([
    ("empty", f"{_ds('candidate')} <> ''"), ("parity", _DPAR.format(c="candidate")), ("nesting", _DNEST.format(c="candidate")), ("emphasis", _DSPAN.format(c="candidate")),
    ("chars", f"length({_dplain('source')}) < 40 or length({_dplain('candidate')})::double / length({_dplain('source')}) between (case when {_duntranslated('source')} then 0.35 else 0.4 end) and (case when {_duntranslated('source')} then 3.0 else 2.5 end)"),
    ("words", f"{_dw(_dplain('source'))} < 12 or {_duntranslated('source')} or {_dw(_dplain('candidate'))}::double / {_dw(_dplain('source'))} between 0.5 and 2.2"),
    ("script", f"{_dw(_dplain('candidate'))} < 8 or {_dcyr(_dplain('candidate'))} >= 0.5 or {_dletters(_dplain('source'))} < 24"),
])


@query(f"with {_DC} select conv_id, turn, {_DPOLISH} as failed from c")
def accept_polish(spark, d):
    return _candidates(spark, d).select("conv_id", "turn", gates.polish_gate(pre="source", source="source").alias("failed"))


@query(f"with {_DC}, f as (select conv_id, {_DACCEPT} as failed from c) select failed, count(*)::bigint as units, count(distinct conv_id)::bigint as convs from f group by failed")
def stats_report(spark, d):
    rows = _candidates(spark, d).select("conv_id", gates.translation_gate().alias("failed"))
    return rows.groupBy("failed").agg(F.count(F.lit(1)).alias("units"), F.countDistinct("conv_id").alias("convs"))


@query(f"""with {_DC}, p as (select *, case conv_id % 3 when 0 then '' when 1 then source else candidate end as pre from c)
select conv_id, turn, ({_ds('pre')} = '' or pre = source or ({_DNEST.format(c='pre')} and {_DSPAN.format(c='pre')})) as safe from p""")
def pre_is_safe(spark, d):
    rows = _candidates(spark, d).withColumn("pre", F.expr("case conv_id % 3 when 0 then '' when 1 then source else candidate end"))
    return rows.select("conv_id", "turn", gates.is_safe().alias("safe"))


_CUT = "case doc_id % 7 when 0 then substring(text, 1, 40) when 1 then {two} else text end"


@query(f"""select doc_id, round(case when {_dw('a')} = 0 then null else {_dw('b')}::double / {_dw('a')} end, 9) as ratio, coalesce({_dw('b')}::double / nullif({_dw('a')}, 0) between 0.70 and 1.20, true) as ok
from (select doc_id, text as a, {_CUT.format(two="text || ' ' || text")} as b from documents)""")
def fidelity(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.col("text").alias("source"), F.expr(_CUT.format(two="concat(text, ' ', text)")).alias("output"))
    return rows.select("doc_id", F.round(gates.fidelity(), 9).alias("ratio"), gates.is_faithful().alias("ok"))


# ---- trees ----
@query(r"""select page_id as doc_id, i::int as label_no, regexp_replace(l[i], '^\s+|\s+$', '', 'g') as text from (select page_id, l, unnest(range(1, len(l) + 1)) as i from (select page_id, regexp_extract_all(html, '<a href="[^"]*">([^<]+)</a>', 1) as l from pages))""")
def nav_labels(spark, d):
    return units.nav_labels(_t(spark, d, "pages"), "page_id")


# The pages' markup as SQL sees it: list items with a link, a box, a title, paragraphs (some open with an unclosed b that ends with a br), a foot.
def _dplainhtml(s: str) -> str:
    return rf"regexp_replace(replace(replace(replace({s}, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;?', '&', 'g')"


def _dhtml(s: str) -> str:
    return f"replace(replace(replace({s}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


_DUNITS = rf"""
ps as (select page_id, regexp_extract_all(regexp_replace(html, '^.*?<body>', '', 's'), '<(?:li|div class="ad"|h1|p|footer)>(?:[^<]|<a href="[^"]*">|</a>|<b>|<br>)*', 0) as l from pages),
pc as (select page_id, i::int as n, l[i] as piece from (select page_id, l, unnest(range(1, len(l) + 1)) as i from ps)),
pt as (select page_id, n, regexp_extract(piece, '^<(\w+)', 1) as tag, regexp_extract(piece, '<a href="([^"]*)">', 1) as href, contains(piece, '<b>') as bold,
 {_dplainhtml("regexp_replace(regexp_replace(regexp_replace(piece, '^<[^>]*>', ''), '<a href=[^>]*>', ''), '</a>|<b>|<br>', '', 'g')")} as t from pc),
us as (select page_id as doc_id, row_number() over (partition by page_id order by n)::int as unit_no, tag, href, bold, t, case when tag = 'li' then '[[1]]' || t || '[[/1]]' when bold then '[[1]]' || t || '[[2/]][[/1]]' else t end as text from pt where trim(t) <> '')"""


@query(rf"""with {_DUNITS} select doc_id, unit_no, tag, text, {_dw('t')}::int as n_words,
case when tag = 'li' then '<a href="' || href || '">' || {_dhtml('t')} || '</a>' when bold then '<b>' || {_dhtml('t')} || '<br/></b>' else {_dhtml('t')} end as xhtml from us""")
def html_units(spark, d):
    found = units.units(_t(spark, d, "pages"), "page_id")
    return found.select("doc_id", "unit_no", "tag", "text", "n_words", F.expr(P.rebuilt("text", "inlines")).alias("xhtml"))


_DLABEL = _dgate([
    ("empty", f"{_ds('candidate')} <> ''"), ("length", f"{_dw('source')} < 3 or {_dw('candidate')}::double / {_dw('source')} between 0.3 and 3.0"),
    ("echo", f"not ({_dw(_dfold('source'))} >= 4 and {_dfold('source')} = {_dfold('candidate')})"), ("script", f"{_dw('candidate')} < 3 or {_dcyr('candidate')} >= 0.45"),
])
_DLABELP = _dgate([
    ("empty", f"{_ds('candidate')} <> ''"), ("untranslated", f"not {_duntranslated('candidate')}"), ("same", f"{_dfold('source')} <> {_dfold('candidate')}"),
    ("script", f"{_dw('candidate')} < 3 or {_dcyr('candidate')} >= 0.5"),
])
_LABEL = "case doc_id % 5 when 0 then source when 1 then '' when 2 then {p} when 3 then {c} else {two} end"


@query(rf"""with {_DUNITS}, l as (select doc_id, unit_no as label_no, trim(t) || ' ' || doc_id || case when unit_no % 2 = 0 then ' one two three four' else '' end as source from us where tag = 'li'),
c as (select *, {_LABEL.format(p=_dpseudo('source'), c="source || ' x'", two="source || ' ' || source || ' ' || source || ' ' || source")} as candidate from l) select doc_id, label_no, {_DLABEL} as failed, {_DLABELP} as polish_failed from c""")
def label_gates(spark, d):
    rows = units.nav_labels(_t(spark, d, "pages"), "page_id").select("doc_id", "label_no", F.expr("concat(text, ' ', doc_id, if(label_no % 2 = 0, ' one two three four', ''))").alias("source"))
    cand = _LABEL.format(p=T.pseudo_translated("source"), c="concat(source, ' x')", two="concat_ws(' ', source, source, source, source)")
    rows = rows.withColumn("candidate", F.expr(cand)).withColumn("target", F.lit("bg"))
    return rows.select("doc_id", "label_no", gates.label_gate().alias("failed"), gates.polished_label_gate().alias("polish_failed"))


# ---- wire, checkpoints ----
@query(r"select conv_id, row_number() over (partition by conv_id order by turn)::int as unit_no, regexp_replace(text, '^\n+|\n+$', '', 'g') as text from conversations")
def wire_roundtrip(spark, d):
    """All turns, rendered and parsed; an answer's unknown number is dropped."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = _t(spark, d, "conversations").select("conv_id", rank.alias("unit_no"), "text")
    sent = wire.render(rows, "conv_id")
    more = F.concat("payload", F.lit("\n<<<"), (F.col("expected") + 1).cast("string"), F.lit(">>>\nnone"))
    return wire.parse(sent.withColumn("payload", more), "conv_id")


_CACHED = "substring(sha1('stage' || chr(1) || text), 1, 10)"


@query(f"with k as (select doc_id, {_CACHED} as key from documents), c as (select distinct key from k where doc_id % 4 = 0) select doc_id, key in (select key from c) as hit from k")
def cache_split(spark, d):
    work = _docs(spark, d).withColumn("chunk_key", F.expr(T.cache_key("'stage'", "text").replace("char(0)", "char(1)")))
    entries = work.where("doc_id % 4 = 0").select(F.lit("s").alias("stage"), "chunk_key")
    hit = checkpoints.hits(work, entries, "s").select("doc_id", F.lit(True).alias("hit"))
    return hit.union(checkpoints.misses(work, entries, "s").select("doc_id", F.lit(False).alias("hit")))


@query(f"with {_DC}, f as (select *, {_DACCEPT} as failed from c) select conv_id as doc_id, turn as unit_no, failed from f where conv_id % 2 = 0 and failed is not null")
def repair_list(spark, d):
    rows = _candidates(spark, d).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("unit_no"), F.col("source").alias("text"), "candidate")
    cached = rows.where("doc_id % 2 = 0").select("doc_id", "unit_no", F.col("candidate").alias("text"))
    return stage.to_repair(rows.drop("candidate"), cached, gates.translation_gate(target="'bg'")).select("doc_id", "unit_no", "failed")


@query("""select conv_id as doc_id, turn as unit_no, case when turn % 2 = 0 then 'new ' || turn when conv_id % 3 = 0 then text when conv_id % 3 = 1 then 'pre ' || text else text end as final from conversations""")
def overlay(spark, d):
    rows = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("unit_no"), "text")
    fp = F.expr(f"case when doc_id % 3 = 1 then {T.fingerprint('text')} else 'other' end")
    entries = rows.where("doc_id % 3 > 0").select("doc_id", "unit_no", F.concat(F.lit("pre "), "text").alias("text"), fp.alias("source_fp"))
    with_pre = checkpoints.applied(rows, entries)
    results = rows.where("unit_no % 2 = 0").select("doc_id", "unit_no", F.concat(F.lit("new "), F.col("unit_no").cast("string")).alias("text"))
    return checkpoints.overlaid(with_pre, results).select("doc_id", "unit_no", "final")


@query(f"""with e as (select conv_id, turn, text, case when turn % 3 = 0 then text else {_dpseudo('text')} end as shown, substring(sha1(text), 1, 16) as fp, case turn % 4 when 0 then null when 1 then substring(sha1(text), 1, 16) when 2 then 'x' end as efp, turn % 4 < 3 as has from conversations)
select conv_id % 5 as book, count_if({_duntranslated('shown')})::bigint as leftover, count_if(not has)::bigint as missing, count_if(has and efp is not null and efp <> fp)::bigint as mismatched, count_if(has and efp is null)::bigint as legacy from e group by 1""")
def fingerprint_guard(spark, d):
    rows = _t(spark, d, "conversations").select(F.expr("conv_id % 5").alias("book"), F.expr(T.fingerprint("text")).alias("source_fp"), F.expr("case when turn % 4 < 3 then text end").alias("entry"),
        F.expr(f"case turn % 4 when 1 then {T.fingerprint('text')} when 2 then 'x' end").alias("entry_fp"),
        F.expr(T.looks_untranslated(f"if(turn % 3 = 0, text, {T.pseudo_translated('text')})")).alias("leftover"))
    return report.plan_health(rows, "book")


@query("""with m as (select doc_id, coalesce(nullif(trim(case when doc_id % 2 = 0 then '  T ' || doc_id end), ''), 'stem' || doc_id) as title, case when doc_id % 3 = 0 then source else 'Unknown' end as author, case when doc_id % 5 = 0 then 'xx' when doc_id % 2 = 0 then lang else 'en' end as language from documents)
select doc_id, title, author, language from m""")
def metadata_fallback(spark, d):
    docs = _t(spark, d, "documents").withColumn("stem", F.concat(F.lit("stem"), F.col("doc_id").cast("string")))
    answer = F.to_json(F.struct(F.expr("case when doc_id % 2 = 0 then concat('  T ', doc_id) end").alias("title"), F.expr("case when doc_id % 3 = 0 then source end").alias("author"), F.expr("case when doc_id % 2 = 0 then lang else 'not a tag' end").alias("language")))
    m = F.from_json(answer, "title string, author string, language string")
    found = docs.select("doc_id", m.alias("m")).select("doc_id", F.expr(T.single_line("m.title")).alias("title"), F.expr(T.single_line("m.author")).alias("author"), F.expr(T.language("m.language")).alias("language"))
    given = docs.where("doc_id % 5 = 0").select("doc_id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("author"), F.lit("xx").alias("language"))
    return markdown.with_metadata(docs.select("doc_id", "stem"), given, found).drop("stem")


# ---- packages and figures ----
@query("""with r as (select doc_id % 7 as book, source, min(doc_id) as pos from documents group by 1, 2) select book::varchar as book_id, row_number() over (partition by book order by pos)::int as pos, source as name from r""")
def spine_dedupe(spark, d):
    rows = _t(spark, d, "documents").select(F.expr("cast(doc_id % 7 as string)").alias("book_id"), F.col("doc_id").alias("pos"), F.col("source").alias("name"))
    return epub.deduplicated(rows, "book_id", "name", "pos")


_BOX = ["floor(value * 7) % 700 as y0", "floor(value * 7) % 700 + 5 + event_id % 40 as y1", "cast(event_id % 90 as double) as x0", "cast(event_id % 90 + 30 as double) as x1"]


@query(f"""with b as (select user_id, {', '.join(_BOX)} from events), o as (select *, max(y1) over (partition by user_id order by y0, y1, x0, x1 rows between unbounded preceding and 1 preceding) as reach from b),
i as (select *, sum(case when reach is null or y0 > reach + 18 then 1 else 0 end) over (partition by user_id order by y0, y1, x0, x1 rows unbounded preceding) as band from o)
select user_id, band::bigint as band, min(x0)::double as x0, min(y0)::double as y0, max(x1)::double as x1, max(y1)::double as y1 from i group by user_id, band""")
def band_merge(spark, d):
    rows = _t(spark, d, "events").selectExpr("user_id", *_BOX)
    rows = rows.selectExpr("user_id", *(f"cast({c} as double) as {c}" for c in ("x0", "y0", "x1", "y1")))
    return figures.merged_bands(rows, "user_id")


@query("""select event_id from (select event_id, 100 + event_id % 300 as w, 100 + (event_id * 7) % 900 as h, 50 + event_id % 50 as s from events) where least(w, h) >= 128 and greatest(w, h) <= 6 * least(w, h) and s >= 60""")
def raster_filter(spark, d):
    rows = _t(spark, d, "events").selectExpr("event_id", "100 + event_id % 300 as w_px", "100 + (event_id * 7) % 900 as h_px", "0 as x0", "0 as y0", "50 + event_id % 50 as x1", "50 + event_id % 50 as y1")
    return figures.real_rasters(rows).select("event_id")


# Draw operations that hang together on each page; page 9 of a book has few of them, on a small area.
_OP = "user_id % 2 as book, case when event_id % 101 = 0 then 9 else event_id % 3 end as page, case when event_id % 101 = 0 then event_id % 60 else event_id % 300 end as x0, case when event_id % 101 = 0 then (event_id * 7) % 50 else (event_id * 7) % 500 end as y0"
_PROSE = " ".join(["word"] * 22)
_DFIG = f"""
o as (select {_OP} from events), b as (select book::varchar as book_id, page::int as page, count(*) as n, greatest(min(x0 // 6) * 6 - 4, 0)::double as x0, greatest(min(y0 // 6) * 6 - 4, 0)::double as y0,
 least((max((x0 + 60) // 6) + 1) * 6 + 4, 400)::double as x1, least((max((y0 + 30) // 6) + 1) * 6 + 4, 600)::double as y1 from o group by 1, 2),
f as (select book_id, page, x0, y0, x1, y1 from b where n >= 30 union all select distinct (user_id % 2)::varchar, 10, 16.0, 16.0, 150.0, 124.0 from events where event_id % 103 = 0)"""


def _figures(spark, d):
    ops = _t(spark, d, "events").selectExpr(*_OP.replace(", case", "\n case").split("\n"))
    ops = ops.selectExpr("cast(book as string) as book_id", "cast(page as int) as page", "cast(x0 as double) as x0", "cast(y0 as double) as y0").selectExpr("*", "x0 + 60 as x1", "y0 + 30 as y1")
    pages = ops.select("book_id", "page").distinct().withColumn("width", F.lit(400.0)).withColumn("height", F.lit(600.0))
    texts = ops.where("x0 % 37 = 0").withColumn("text", F.expr(f"if(y0 % 2 = 0, '{_PROSE}', 'a label')"))
    # Pictures on page 10, with a label that reaches out of them, and slivers on page 11.
    pics = _t(spark, d, "events").where("event_id % 103 = 0 or event_id % 107 = 0").selectExpr("cast(user_id % 2 as string) as book_id", "if(event_id % 103 = 0, 10, 11) as page", "20D as x0", "20D as y0", "120D as x1", "120D as y1", "if(event_id % 103 = 0, 200, 2000) as w_px", "200 as h_px")
    pages = pages.unionByName(pics.select("book_id", "page").distinct().withColumn("width", F.lit(400.0)).withColumn("height", F.lit(600.0)))
    texts = texts.unionByName(pics.where("page = 10").selectExpr("book_id", "page", "110D as x0", "110D as y0", "150D as x1", "118D as y1", "'a label' as text").distinct())
    found = figures.regions(pages, ops, texts, pics)
    return figures.plan(found, ops, texts, pics)


@query(f"with {_DFIG} select book_id, page, 0 as k, x0, y0, x1, y1, printf('fig-%04d-%02d.png', page + 1, 0) as file_name from f")
def figure_plan(spark, d):
    return _figures(spark, d)[0]


@query(f"""with {_DFIG} select f.book_id, f.page, 0 as k, o.x0::double as x0, o.y0::double as y0, o.x0 + 60.0::double as x1, o.y0 + 30.0::double as y1, case when o.y0 % 2 = 0 then '{_PROSE}' else 'a label' end as text,
case when o.y0 % 2 = 0 then 'body' else 'label' end as kind from f join o on f.book_id = o.book::varchar and f.page = o.page where o.x0 % 37 = 0
union all select book_id, page, 0, 110.0, 110.0, 150.0, 118.0, 'a label', 'label' from f where page = 10""")
def figure_texts(spark, d):
    """The texts in figures: prose stays text, labels go into the picture."""
    return _figures(spark, d)[1]


# ---- whole pipelines, offline ----
_DTRANS = f"""{_DUNITS}, c as (select *, text as source, {_dpseudo('text')} as candidate, {_dpseudo('t')} as said from us), g as (select *, {_DACCEPT} as failed from c)"""


def _translated(spark, d):
    pages = _t(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "html", F.col("url").alias("name"))
    return pipelines.translate(pages, stage.Transform("pseudo-1", stage.pseudo, delay=0))


@query(f"with {_DTRANS} select doc_id, unit_no, text, case when failed is null then candidate else text end as final, case when failed is null then 'ok' else 'verbatim' end as status from g")
def translate_pages(spark, d):
    return _translated(spark, d)[1].select("doc_id", "unit_no", "text", "final", "status")


@query(rf"""with {_DTRANS}, x as (select doc_id, unit_no, tag, href, bold, {_dhtml("case when failed is null then said else t end")} as t from g),
w as (select doc_id, string_agg(case when tag = 'li' then '<li><a href="' || href || '">' || t || '</a></li>' end, '' order by unit_no) as lis, max(case when tag = 'div' then t end) as box, max(case when tag = 'footer' then t end) as foot,
 string_agg(case when tag = 'h1' then '<h1>' || t || '</h1>' when tag = 'p' then '<p>' || case when bold then '<b>' || t || '<br/></b>' else t end || '</p>' end, '' order by unit_no) as art from x group by doc_id),
h as (select page_id as doc_id, replace(regexp_extract(html, '^(.*?)<title>', 1, 's'), '<meta charset="utf-8">', '<meta charset="utf-8"/>') as lead, {_dhtml(_dplainhtml("regexp_extract(html, '<title>([^<]*)', 1)"))} as title,
 regexp_extract(html, '</title>.*?<body>', 0, 's') as rest, regexp_extract(html, '<!--[^>]*-->', 0) as note from pages)
select doc_id, lead || '<title>' || title || rest || '<nav><ul>' || lis || '</ul></nav>' || note || '<div class="ad">' || box || '</div><article>' || art || '</article><footer>' || foot || '</footer></body></html>' as html from h join w using (doc_id)""")
def translated_html(spark, d):
    """The pages with their translated units in place; everything else as it was."""
    return _translated(spark, d)[0]


_DJOINED = rf"""
lj as (select *, lag(text) over (partition by doc_id order by block_no) as prev from blocks),
lk as (select *, case when prev is not null and not regexp_matches(text, '^(#|!\[)') and not regexp_matches(prev, '^(#|!\[)') and right(prev, 1) not in ('.', '!', '?', '…', ':', ';', '"', '''', '»', ')', '*')
 and regexp_matches(text, '^\p{{Ll}}') then 0 else 1 end as new from lj),
li as (select *, sum(new) over (partition by doc_id order by block_no) as island from lk),
le as (select *, case when right(text, 1) = '-' and lead(new) over (partition by doc_id order by block_no) = 0 then left(text, -1 + length(text)) when lead(new) over (partition by doc_id order by block_no) = 0 then text || ' ' else text end as piece from li),
lm as (select doc_id, island, string_agg(piece, '' order by block_no) as text from le group by doc_id, island)"""


@query(rf"""with src as (select doc_id, text from documents), {_DLINES}, {_DJOINED}
select doc_id, '---' || {NL} || 'title: "Document ' || doc_id || '"' || {NL} || 'author: "' || any_value(source) || '"' || {NL} || 'lang: "' || any_value(lang) || '"' || {NL} || '---' || {NL} || {NL} || string_agg(lm.text, {NL} || {NL} order by island) as text
from lm join documents using (doc_id) group by doc_id""")
def convert_documents(spark, d):
    docs = _docs(spark, d, r"replace(text, '\n', '\n\n')")
    meta = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.col("source").alias("author"), F.col("lang").alias("language"))
    return pipelines.convert(docs, stage.Transform("identity", stage.identity, delay=0), meta)


@query(f"""with p as (select conv_id, turn, text, case when turn % 2 = 0 then {_dpseudo('text')} else text end as source from conversations),
c as (select *, {_ds(_dpseudo('source'))} as candidate, {_duntranslated('source')} as raw from p), f as (select *, {_DPOLISH} as failed from c)
select conv_id as doc_id, turn as unit_no, case when raw and failed is null then candidate else source end as final, case when raw then case when failed is null then 'ok' else 'verbatim' end end as status from f""")
def polish_units(spark, d):
    rows = _t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("unit_no"), "text", F.expr(f"case when turn % 2 = 0 then {T.pseudo_translated('text')} else text end").alias("pre"))
    return pipelines.polish(rows, stage.Transform("pseudo-1", stage.pseudo, delay=0), untranslated_only=True).select("doc_id", "unit_no", "final", "status")
