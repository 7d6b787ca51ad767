"""The ten operators over their whole tables, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, html, mixing, pii, quality, simhash, tokens, toxicity, warc
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.by_section(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.formatted(chat.events_of(turns).unionByName(chat.sample_log(spark))))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.hi - s.lo)")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(warc.write_records(table(spark, sf_dir, "pages")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the mix: sizes and targets."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality.report(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_toxicity, op3_chat_formatting, op4_decontamination, op5_warc,
    op6_simhash, op7_pii, op8_mixing, op9_html_extraction, op10_quality_rules, mixing_targets,
)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"

#: Where SQL can say what an operator computes over whole tables.
ORACLES: dict[str, str] = {
    "op3_chat_formatting": rf"""
with t as (select conv_id, turn, role, coalesce(text, '') as text from conversations
 union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok')
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
 coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as loss_chars,
 sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn), '')) as loss_sha256,
 sum(length('### ') + length({_ESCAPED.format('role')}) + 1 + length({_ESCAPED.format('text')}) + length('</turn>') + 1)::bigint as formatted_chars
from t group by conv_id""",
    "op4_decontamination": rf"""
with d as (select doc_id, {_WORDS} as w from documents), i as (select item_id::varchar as item_id, {_WORDS} as w from benchmark),
iw as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[p + 1 : p + least(10, len(w))], ' ') as g from (select item_id, w, unnest(range(0, greatest(1, len(w) - 9))) as p from i where len(w) > 0)),
ns as (select distinct n from iw),
dw as (select doc_id, n, p, array_to_string(w[p + 1 : p + n], ' ') as g from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) as p from d, ns where len(w) >= n)),
m as (select doc_id, item_id, iw.n as n, p from dw join iw on dw.n = iw.n and dw.g = iw.g),
h as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from m) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from m) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join t using (doc_id)""",
    "mixing_targets": r"""
with d as (select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> ''))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, ([5.0, 2.0, 1.0])[(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w, 3.0::double * source_size as most from s),
l as (select a.most / a.w as b, ((select sum(source_size) from r) - coalesce(sum(case when c.most / c.w < a.most / a.w then c.most end), 0)) / sum(case when c.most / c.w >= a.most / a.w then c.w end) as level from r a, r c group by a.source, a.most, a.w),
t as (select level from l where level <= b order by b limit 1)
select doc_id, size, source_size, round(least(most, w * level), 6)::double as target from d join r on d.source is not distinct from r.source, t""",
    "op10_quality_rules": rf"""
with d as (select doc_id, coalesce(text, '') as text, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') as w from documents),
l as (select *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) as ls from d),
g as (select doc_id, p, array_to_string(w[p + 1 : p + 5], ' ') as g from (select doc_id, w, unnest(range(0, len(w) - 4)) as p from d where len(w) >= 5)),
r as (select doc_id, p, count(*) over (partition by doc_id, g) as n from g),
c as (select doc_id, count(distinct q) as n_repeat_words from (select doc_id, unnest(range(p, p + 5)) as q from r where n > 1) group by doc_id),
s as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
 len(ls) as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
 length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) as n_upper, length(text) - length(regexp_replace(text, '\p{{L}}', '', 'g')) as n_letters from l left join c using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
 20 * n_symbols > word_chars or word_chars < 2 * n_words or word_chars > 20 * n_words or 2 * n_dup_lines > n_lines or 10 * n_upper > 6 * n_letters as more from s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or more) as kept from b""",
}
