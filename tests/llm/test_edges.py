"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline
from quire.llm import chat, decontam, html, mixing, pii, quality, simhash, tokens, toxicity, warc

LONG = "lorem ipsum dolor sit amet consectetur " * 8000 + "tail " + "x" * 70000
DOCS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "a", 1),
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "a", 1),
    (2, None, None, None, None),
    (None, "one two three four five six seven eight nine ten eleven", "en", "b", 2),
    (None, None, None, "b", None),
    (3, "", "en", "", 0),
    (4, " \t\n\r\x0b\x0c ", "en", "a", 6),
    (5, "日本語 текст 😀 ß Ünï \x00 \x1c end", "xx", "ü", 20),
    (6, LONG, "en", "a", len(LONG)),
    (7, "mail me at a.b@mail.example.com or +1 (017) 555-7713", "en", None, 52),
]
# Extra columns whose names the operators use themselves.
CLASH = ["size", "target", "fp", "component_id", "n_words", "kept", "block", "mix_shard", "words", "lines", "place", "spans", "host", "node", "toxic", "first"]


def docs(spark, rows=DOCS):
    from pyspark.sql import functions as F

    made = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return made.select("*", *(F.lit("c").alias(c) for c in CLASH))


def benchmark(spark, rows=(("b1", "beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), ("b2", None), (None, "one two"), ("b3", ""), ("b4", "ten eleven"), ("b4", "ten eleven"))):
    return spark.createDataFrame(list(rows), "item_id string, text string")


@pytest.mark.parametrize("empty", [False, True])
def test_documents(spark, empty):
    rows = [] if empty else DOCS
    d = docs(spark, rows)
    n = len(rows)
    assert tokens.section_tokens(d).count() == n
    assert simhash.near_duplicates(d).count() == n
    assert pii.report(d).count() == n
    assert mixing.mix(d).count() == n
    assert quality.report(d).count() == n
    assert decontam.contamination(d, benchmark(spark)).count() == n
    assert decontam.contamination(d, benchmark(spark, [])).count() == n
    labels = spark.createDataFrame([] if empty else [(1, 1, 0), (2, None, 1), (None, 0, 1), (6, 0, None)], "doc_id bigint, quality int, toxic int")
    assert toxicity.score(d, toxicity.train(d, labels)).count() == n


def test_results_of_odd_rows(spark):
    d = docs(spark)
    found = {(r.doc_id, r.n_words): r for r in quality.report(d).collect()}
    assert found[2, 0].base_failed and not found[2, 0].kept and found[4, 0].word_chars == 0
    assert found[6, 48002].n_repeat_words >= 47999
    sims = simhash.near_duplicates(d).collect()
    assert {r.component_id for r in sims if r.doc_id in (2, 3, 4)} == {2}  # no words: fingerprint zero, linked
    assert [r.component_id for r in sims if r.doc_id == 1] == [1, 1]
    hits = {(r.doc_id, r.n_words): r for r in decontam.contamination(d, benchmark(spark)).collect()}
    assert hits[1, 11]["items"] == ["b1"] and hits[None, 11]["items"] == ["b4"] and hits[2, 0]["items"] == []
    mixed = mixing.mix(d).collect()
    assert all(r.taken <= 3 * r.size for r in mixed) and sum(r.size for r in mixed if r.source is None) == 8


def test_stages(spark, tmp_path):
    from quire.llm.common import table

    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    d = docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == d.columns
        assert 0 < out.count() <= 3 * d.count()
        assert stage(spark, docs(spark, []), str(tmp_path)).count() == 0
    kept = simhash.keep_one(d).collect()
    assert len([r for r in kept if r.doc_id == 1]) == 1
    new = {r.doc_id: r for r in pii.with_surrogates(d).collect()}
    assert "a.b@" not in new[7].text and "555-7713" not in new[7].text and new[7].n_chars == len(new[7].text) and new[6].text == LONG
    assert table(spark, str(tmp_path), "benchmark").count() == 6


def test_near_duplicates_go_by_row(spark):
    x, y, z = ("the first text of some words", "quite another text about fish", "a third one without any id")
    rows = [(1, x), (5, x), (5, y), (None, z), (None, "and a fourth one, neither near"), (None, x), (7, "same id and text twice"), (7, "same id and text twice")]
    for n in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(n)
        kept = simhash.keep_one(docs).collect()
        assert sorted(map(tuple, simhash.keep_one(docs, sent=0).collect()), key=str) == sorted(map(tuple, kept), key=str)  # joined, not sent
        assert sorted(map(tuple, kept), key=str) == sorted([rows[i] for i in (0, 2, 3, 4, 6)], key=str)


def test_pages_and_chats(spark):
    rows = [(1, "http://a.example/x", "<p>hi &amp; ho<p>two"), (1, "http://a.example/x", "<p>hi &amp; ho<p>two"), (None, None, None), (2, "not a url", ""), (3, "http://a.example/y", "<div>" * 3000 + "deep" + "</div>" * 3), (4, "x", "<" * 2000), (5, "http://a.example/z", "<p>\ud83d lone &#xD800; &#0; &notit; &#x110000;</p>".encode("utf-8", "replace").decode())]
    for some in (rows, []):
        pages = spark.createDataFrame(some, "page_id bigint, url string, html string")
        assert html.main_text(pages).count() == len(some)
        assert warc.report(warc.write_records(pages)).count() == len(some)
    texts = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert texts[1] == "hi & ho two" and texts[2] == "" and texts[3] == "deep"
    turns = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (None, 1, "user", "y"), (2, 1, "assistant", LONG)], "conv_id bigint, turn bigint, role string, text string")
    out = {r.conv_id: r for r in chat.digests(chat.formatted(chat.events_of(turns))).collect()}
    assert out[1].n_turns == 3 and out[2].loss_chars == len(LONG) and set(out) == {1, 2}
    assert chat.digests(chat.formatted(chat.events_of(turns.where("false")))).count() == 0
