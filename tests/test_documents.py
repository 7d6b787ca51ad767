"""Units, stages, checkpoints, packages, figures, streams."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import batches, checkpoints, clients, figures, gates, report, stage, units, wire
from quire.plans import pipelines
from quire.sources import epub, markdown
from quire.streaming import resumable

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def unit_texts(html):
    return [t for _, t, _ in units.units_of(html)]


def test_units():
    assert unit_texts("<body><p>One <b>two <i>x</i></b><br/>end<!-- c --></p><div>stray<p>in</p></div><script>no</script><ul><li>a<li>b</ul></body>") == [
        "One [[1]]two [[2]]x[[/2]][[/1]][[3/]]end", "in", "a", "b",
    ]
    assert unit_texts("<p>a<p> <p><b></b>") == ["a"] and unit_texts(None) == []
    html = '<body><p>One <a href="x" class="k">two</a></p></body>'
    assert units.applied(html, {1: "[[1]]Два[[/1]] < едно"}) == '<body><p><a href="x" class="k">Два</a> &lt; едно</p></body>'
    assert units.applied(html, {1: "[[/1]]Два[[1]]"}) == html and units.applied(html, {1: "[[2/]]"}) == html
    assert units.with_labels("<nav><a href='1'><span>A</span> b</a><text>c</text></nav>", {2: "X"}) == '<nav><a href="1"><span>A</span> b</a><text>X</text></nav>'


def test_unit_frame(spark):
    rows = units.units(spark.createDataFrame([(1, "<p>See [[1]] <b>x</b></p><p>fine</p>")], "doc_id bigint, html string")).collect()
    assert [(r.unit_no, r.unsafe) for r in rows] == [(1, True), (2, False)] and rows[0].inlines[1].tag == "b"


def test_gates(spark):
    src = "[[1]]one[[/1]] two three four five six seven eight nine ten eleven twelve"
    good = "[[1]]едно[[/1]] две три четири пет шест седем осем девет десет единадесет дванадесет"
    rows = [(good, None), ("", "empty"), ("едно", "parity"), ("[[/1]]едно[[1]]" + good[14:], "nesting"), ("[[1]][[/1]] " + good[13:], "emphasis"),
            ("[[1]]едно[[/1]] две", "length"), (src, "echo"), (src.replace("two", "2x"), "script")]
    frame = spark.createDataFrame([(src, c, "bg", e) for c, e in rows], "source string, candidate string, target string, expected string")
    for r in frame.withColumn("failed", gates.translation_gate()).collect():
        assert r.failed == r.expected, r
    one = spark.createDataFrame([("a b c", "a b")], "source string, output string")
    assert not one.select(gates.is_faithful()).first()[0]


def flaky(system, text):
    if "REFUSE" in text:
        raise stage.Blocked()
    if "EMPTY" in text:
        return ""
    if "\n\n" in text and "HARD" in text:
        raise stage.Blocked()
    return text.replace("a", "b")


def test_bisection_and_ladder():
    t = stage.Transform("t", flaky, retries=1, delay=0)
    assert stage.bisected(t, "", "a\n\nREFUSE a\n\na") == [("b", "ok"), ("REFUSE a", "verbatim"), ("b", "ok")]
    assert stage.laddered(t, "", "EMPTY") == (None, "failed") and stage.laddered(t, "", "REFUSE") == (None, "blocked")
    over = stage.Transform("t", flaky, retries=1, delay=0, fallback=stage.Transform("u", stage.upper))
    assert stage.laddered(over, "", "REFUSE x") == ("REFUSE X", "fallback")
    calls = []

    def twice(system, text):
        calls.append(1)
        if len(calls) < 3:
            raise stage.Retryable(503)
        return text

    assert stage.Transform("v", twice, delay=0).call("", "x") == "x" and len(calls) == 3
    with pytest.raises(stage.Retryable):
        stage.Transform("w", lambda s, x: (_ for _ in ()).throw(stage.Retryable(400)), delay=0).call("", "x")


def test_cleaning(spark):
    rows = spark.createDataFrame([(1, "a a a\n\n![i](j.png)\n\nREFUSE"), (2, "word " * 10)], "doc_id bigint, text string")
    out = {r.doc_id: r for r in stage.cleaned(rows, stage.Transform("t", flaky, retries=1, delay=0)).collect()}
    assert out[1].cleaned == "b b b\n\n![i](j.png)\n\nREFUSE" and out[1].status == "verbatim"
    short = stage.cleaned(rows, stage.Transform("s", lambda s, t: "x", delay=0)).where("doc_id = 2").first()
    assert (short.status, short.attempts) == ("drift", 2)


def test_translation_keeps_what_fails(spark):
    pages = spark.createDataFrame([(1, "<body><p>Hello there</p><p>REFUSE me</p></body>")], "doc_id bigint, html string")

    def model(system, text):
        if "REFUSE" in text:
            raise stage.Blocked()
        return stage.pseudo(system, text)

    new, results = pipelines.translate(pages, stage.Transform("m", model, delay=0))
    assert {r.unit_no: (r.status, r.final) for r in results.collect()} == {1: ("retried", stage.pseudo("", "Hello there")), 2: ("blocked", "REFUSE me")}
    assert new.first().html == f"<body><p>{stage.pseudo('', 'Hello there')}</p><p>REFUSE me</p></body>"


def test_polish_applies_all_units(spark):
    rows = spark.createDataFrame([(1, 1, "This is one long English sentence here", "This is one long English sentence here"), (1, 2, "two", "две")], "doc_id bigint, unit_no int, text string, pre string")
    out = {r.unit_no: r for r in pipelines.polish(rows, stage.Transform("p", stage.pseudo, delay=0), untranslated_only=True).collect()}
    assert out[1].final == stage.pseudo("", rows.first().text) and out[2].final == "две" and out[2].status is None


def test_wire(spark):
    rows = spark.createDataFrame([("k", "<<<1>>>\na\n\nb\n<<<3>>>\nx\n<<<1>>>\nlast\n<<<7>>>\nno", 3)], "chunk_key string, payload string, expected int")
    assert sorted((r.unit_no, r.text) for r in wire.parse(rows).collect()) == [(1, "last"), (3, "x")]
    sent = spark.createDataFrame([("k", 1, "пре", "src"), ("k", 2, "same", "same")], "chunk_key string, unit_no int, pre string, source_en string")
    assert wire.render_polish(sent, True).first().payload == "<<<1>>>\n[BG]\nпре\n[EN]\nsrc\n<<<2>>>\nsame"


def test_checkpoints(spark, tmp_path):
    raw = [("a", json.dumps({"format": 2, "units": {"1": {"t": "x", "s": "f"}}})), ("b", json.dumps({"1": "y", "2": 3}))]
    files = spark.createDataFrame(raw, "chunk_key string, raw string").withColumn("mtime", F.current_timestamp())
    assert sorted((r.chunk_key, r.unit_no, r.text, r.source_fp) for r in checkpoints.imported(files).collect()) == [("a", 1, "x", "f"), ("b", 1, "y", None)]
    with pytest.raises(Exception, match="not a checkpoint"):
        checkpoints.imported(spark.createDataFrame([("c", "[1]")], "chunk_key string, raw string").withColumn("mtime", F.current_timestamp())).collect()
    store = str(tmp_path / "store")
    results = spark.createDataFrame([("k", 1, "t", "f")], "chunk_key string, unit_no int, text string, source_fp string")
    checkpoints.write(results, store, "s")
    assert checkpoints.newest(checkpoints.read(spark, store)).first().text == "t"


def test_stream_pays_once(spark, tmp_path):
    src, store = str(tmp_path / "in"), str(tmp_path / "store")
    t = stage.Transform("up", stage.upper, delay=0)
    for k in range(2):
        spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "text string").write.mode("append").parquet(src)
        resumable.start(spark, src, "text string", t, store, str(tmp_path / "p")).awaitTermination()
    assert sorted(r.text for r in checkpoints.read(spark, store).collect()) == ["A", "B"]


def test_packages(spark, tmp_path):
    book = epub.compiled("T & x", "A", "en", [("One", "<p>1</p>"), ("Two", "<p>2</p>")])
    (tmp_path / "b.epub").write_bytes(book)
    books = epub.read(spark, str(tmp_path / "*.epub"))
    found = epub.entries(books).cache()
    package = epub.packages(found)
    names = [r.name for r in epub.spine_documents(package, found).orderBy("pos").collect()]
    assert names == ["OPS/ch0001.xhtml", "OPS/ch0002.xhtml"] and [r.name for r in epub.nav_documents(package, found).collect()] == ["OPS/nav.xhtml"]
    assert epub.repacked(found).first().content == book
    opf = next(r.content for r in found.collect() if r.name.endswith(".opf"))
    once = epub.with_metadata(bytes(opf), "bg", "[BG]")
    assert b">bg<" in once and b"T &amp; x [BG]" in once and epub.with_metadata(once, "bg", "[BG]").count(b"[BG]") == 1
    for bad in ("../x", "/etc/x", "a/../../x"):
        with pytest.raises(epub.UnsafeEntry):
            epub.safe(bad)
    assert epub.safe("a/../b") == "b"
    with pytest.raises(ValueError, match="container"):
        epub.opf_path(b"<container/>")


def test_packages_are_translated(spark):
    from quire.plans import packages, prompts

    book = epub.compiled("Title", "A", "en", [("First chapter", "<p>Hello <b>there</b> friend</p>"), ("Second chapter", "<p>REFUSE</p>")])

    def model(system, text):
        assert "Bulgarian" in system or not system
        if "REFUSE" in text:
            raise stage.Blocked()
        return stage.pseudo(system, text)

    books = spark.createDataFrame([("a", book), ("b", book)], "book_id string, content binary")
    out = {r.book_id: epub.unpacked(bytes(r.content)) for r in packages.translate(books, stage.Transform("m", model, delay=0), suffix="[BG]").collect()}
    old, new = epub.unpacked(book), out["a"]
    assert out["a"] == out["b"] and set(old) == set(new) and new["OPS/ch0002.xhtml"] == old["OPS/ch0002.xhtml"]
    text = new["OPS/ch0001.xhtml"].decode()
    assert f"{stage.pseudo('', 'Hello')} <b>{stage.pseudo('', 'there')}</b>" in text and stage.pseudo("", "First chapter") in new["OPS/nav.xhtml"].decode()
    assert b">bg<" in new["OPS/package.opf"] and b"Title [BG]" in new["OPS/package.opf"]
    assert prompts.system(prompts.TRANSLATE, "de", "- a -> b").count("German") == 1


def test_chunks_on_the_wire(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def model(system, text):
        calls.add(1)
        if text.count("unit number") > 1:  # a chunk: its second unit is left out, its third comes back in Latin letters
            parts = text.split("<<<")
            return "<<<".join(p if p.startswith("3>>>") else stage.pseudo("", p) for p in parts if not p.startswith("2>>>"))
        return stage.pseudo("", text)

    rows = [(d, n, f"unit number {n} of document {d} with some more plain words", 11) for d in (1, 2) for n in range(1, 6)]
    rows += [(3, 1, "<<<2>>>\nlooks like the wire", 5), (3, 2, None, 0)]
    units_ = spark.createDataFrame(rows, "doc_id bigint, unit_no int, text string, n_words int").withColumn("source", F.col("text"))
    t, store = stage.Transform("m", model, delay=0), str(tmp_path / "store")
    gate = gates.translation_gate(target="'bg'")
    first = batches.in_chunks(units_, t, gate, target=33, store=store)
    out = {(r.doc_id, r.unit_no): r for r in first.collect()}
    assert len(out) == 12
    for d in (1, 2):
        assert [out[d, n].chunk_no for n in range(1, 6)] == [1, 1, 1, 2, 2]
        assert [out[d, n].status for n in range(1, 6)] == ["ok", "retried", "retried", "ok", "retried"]
        assert all(out[d, n].final == stage.pseudo("", out[d, n].text) for n in range(1, 6))
    assert out[3, 1].final == stage.pseudo("", rows[-2][2]) and out[3, 2].status == "verbatim" and out[3, 2].final is None
    asked = calls.value
    assert asked == 4 + 6 + 1
    again = batches.in_chunks(units_, t, gate, target=33, store=store)
    assert {(r.doc_id, r.unit_no): r.final for r in again.collect()} == {k: r.final for k, r in out.items()} and calls.value == asked
    some = batches.in_chunks(units_, t, gate, target=33, store=store, max_chunks=1)
    assert some.where("doc_id < 3").count() == 6


def test_packages_are_polished(spark):
    from quire.plans import packages

    def words(n, s):
        return " ".join([s] * n)

    source = epub.compiled("Title", "A", "bg", [("One", f"<p>{words(9, 'first')}</p><p>{words(9, 'second')}</p>"), ("Two", f"<p>{words(9, 'third')}</p>")])
    cyr = {w: stage.pseudo("", w) for w in ("first", "second", "third")}
    pre = epub.compiled("Title", "A", "bg", [("One", f"<p>{words(9, cyr['first'])}</p><p>{words(9, 'second')}</p>"), ("Two", f"<p>{words(9, cyr['third'])}</p>")])
    better = stage.Transform("p", lambda system, text: stage.pseudo("", text.replace(cyr["first"], cyr["first"] + "x")), delay=0)

    def frame(b):
        return spark.createDataFrame([("a", b)], "book_id string, content binary")

    out, results = packages.polish(frame(pre), better, frame(source), suffix="[P]")
    new = {k: v.decode() for k, v in epub.unpacked(bytes(out.first().content)).items() if k.endswith("html") or k.endswith("opf")}
    assert words(9, cyr["first"] + stage.pseudo("", "x")) in new["OPS/ch0001.xhtml"] and words(9, cyr["second"]) in new["OPS/ch0001.xhtml"]
    assert "Title [P]" in new["OPS/package.opf"] and words(9, cyr["third"]) in new["OPS/ch0002.xhtml"]
    assert {r.unit_no for r in results.where("was_untranslated").collect()} == {results.where(F.col("pre").startswith("second")).first().unit_no}
    # Earlier results over the original: those whose fingerprint fits count; only what is untranslated is asked for, all are applied.
    best = packages.to_polish(frame(source)).where(F.col("text").startswith("first") | F.col("text").startswith("third"))
    fp = F.when(F.col("text").startswith("first"), F.expr(T.fingerprint("text"))).otherwise("stale")
    prior = best.select("doc_id", "unit_no", F.translate("text", stage.T.LATIN, stage.T.CYRILLIC).alias("text"), fp.alias("source_fp"))
    out, results = packages.polish(frame(source), stage.Transform("q", stage.pseudo, delay=0), prior=prior, untranslated_only=True)
    new = epub.unpacked(bytes(out.first().content))
    assert words(9, cyr["first"]) in new["OPS/ch0001.xhtml"].decode() and words(9, cyr["third"]) in new["OPS/ch0002.xhtml"].decode()
    got = report.polish(results).first()
    assert got.retranslated == 2 and got.units == results.count()


def test_figures(spark):
    grid = [(100.0, 100.0 + 4 * i, 300.0, 101.0 + 4 * i) for i in range(40)]
    assert figures.clusters(grid, 400, 600) == [(96.0, 96.0, 306.0, 258.0)]
    assert figures.clusters([(0, 0, 50, 1)], 400, 600) == []
    assert figures.bands([(0, 50, 1, 60), (5, 0, 6, 35), (0, 200, 1, 210)]) == [(0, 0, 6, 60), (0, 200, 1, 210)]
    ops = spark.createDataFrame([("b", 0, *g) for g in grid], "book_id string, page int, x0 double, y0 double, x1 double, y1 double")
    texts = spark.createDataFrame([("b", 0, 290.0, 150.0, 350.0, 160.0, "label"), ("b", 0, 100.0, 200.0, 200.0, 210.0, "w " * 30), ("b", 0, 0.0, 500.0, 9.0, 510.0, "far")], "book_id string, page int, x0 double, y0 double, x1 double, y1 double, text string")
    none = texts.where("false").withColumn("w_px", F.lit(0)).withColumn("h_px", F.lit(0))
    pages = spark.createDataFrame([("b", 0, 400.0, 600.0)], "book_id string, page int, width double, height double")
    figs, inside = figures.plan(figures.regions(pages, ops, texts, none), ops, texts, none)
    f = figs.first()
    assert f.file_name == "fig-0001-00.png" and f.x1 == 350.0 and sorted(r.kind for r in inside.collect()) == ["body", "label"]


def test_markdown(spark, tmp_path):
    pages = spark.createDataFrame([("b", 0, "p0 \n"), ("b", 1, ""), ("b", 2, "p2")], "book_id string, page int, text string")
    figs = spark.createDataFrame([("b", 1, 0, "f.png")], "book_id string, page int, k int, file_name string")
    assert markdown.pages_with_figures(pages, figs).first().text == "p0\n\n![](images/f.png)\n\np2"
    (tmp_path / "g.json").write_text(json.dumps({"terms": {"Queen": "Кралица", "n": 1}}))
    assert wire.glossary_prompt(markdown.glossary(spark, str(tmp_path / "g.json"))) == "- Queen -> Кралица"
    (tmp_path / "h.json").write_text("{}")
    with pytest.raises(ValueError, match="no terms"):
        markdown.glossary(spark, str(tmp_path / "h.json"))


XHTML = """<?xml version='1.0' encoding='UTF-8'?>
<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.1//EN" "http://www.w3.org/TR/xhtml11/DTD/xhtml11.dtd">
<!-- top -->
<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>T</title><style>a &gt; b { x: "1" }</style><script><![CDATA[ if (a < b && c) {} ]]></script></head>
<body epub:type="bodymatter"><svg viewBox="0 0 1 1"><linearGradient id="g"/></svg><!-- c --><p>One <i class="x">two</i> &amp; <br/>three</p><p>Keep <b></b> me</p></body></html>
<!-- end -->
"""


def test_documents_are_written_as_they_were_read():
    assert units.applied(XHTML, {}) == XHTML
    new = units.applied(XHTML, {1: "[[1]]Deux[[/1]] < un [[2/]]"})
    assert new == XHTML.replace('One <i class="x">two</i> &amp; <br/>three', '<i class="x">Deux</i> &lt; un <br/>')
    named = '<!DOCTYPE html><html><body><p>caf&eacute;&nbsp;x &unknown; y</p></body></html>'
    assert units.units_of(named)[0][1] == "caf\u00e9\u00a0x  y" and units.applied(named, {}) == named.replace("&eacute;", "\u00e9").replace("&nbsp;", "\u00a0")


def test_documents_that_are_no_xml_keep_names_and_raw_text():
    html = '<!DOCTYPE html><html><head><style>a > b &gt; c</style></head><body><svg viewBox="0"><linearGradient></linearGradient></svg><!-- c --><p>One <b>bold<p>Two <br> three</body></html>'
    assert units.applied(html, {2: "Deux [[1/]] trois"}) == '<!DOCTYPE html><html><head><style>a > b &gt; c</style></head><body><svg viewBox="0"><linearGradient/></svg><!-- c --><p>One <b>bold</b></p><p>Deux <br/> trois</p></body></html>'
    assert len(units.units_of("<div>" * 30_000 + "x")) == 1 and units.applied("<b>" * 20_000 + "x" + "</p>" * 9, {}).count("<b>") == 20_000


def test_labels_of_any_kind():
    nav = "<nav><ol><li><a href='1'><span>Chapter</span>  <em>One</em></a></li><li><text> Two <a>in it</a></text></li><li><a> </a></li></ol></nav>"
    assert [t for _, t in units._labels(units.tree(nav))] == ["Chapter  One", "Two in it", "in it"]
    assert units.with_labels(nav, {1: "A", 3: "B"}).count("<em>") == 0 and "<a>B</a>" in units.with_labels(nav, {3: "B"})


def test_cleaning_resumes_and_says_how_it_drifted(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def model(system, text):
        (seen / str(len(list(seen.iterdir())))).write_text(system)
        if "half" in text:
            return "half" if system != "SHORT" else text
        return text + " more" * 99 if "long" in text else text

    docs = spark.createDataFrame([(1, "half of this text goes away at first"), (2, "fine"), (3, "a long one always drifts"), (4, "fine"), (5, None)], "doc_id bigint, text string").coalesce(1)
    ask = stage.Transform("m", model, delay=0)
    for attempts in ({1: 2, 2: 1, 3: 2, 4: 1, 5: 0}, {1: 0, 2: 0, 3: 2, 4: 0, 5: 0}):
        got = {r.doc_id: r for r in stage.cleaned(docs, ask, "CLEAN", "SHORT", "LONG", store=str(tmp_path / "store")).collect()}
        assert {k: r.attempts for k, r in got.items()} == attempts
        assert (got[1].status, got[1].cleaned, got[3].status, got[2].status, got[5].cleaned) == ("retried", "half of this text goes away at first", "drift", "ok", None)
    asked = [p.read_text() for p in seen.iterdir()]
    assert asked.count("SHORT") == 1 and asked.count("LONG") == 2 and asked.count("CLEAN") == 3 + 1
    with pytest.raises(Exception, match="drifted"):
        stage.strict(stage.cleaned(docs, ask, store=str(tmp_path / "store"))).collect()


def described(system, text):
    return '{"title": "From the text", "language": "de"}' if system else ""


def test_convert_reads_metadata(spark):
    docs = spark.createDataFrame([(1, "Some text."), (2, "Other text.")], "doc_id bigint, text string")
    known = spark.createDataFrame([(1, "Given", None, None)], "doc_id bigint, title string, author string, language string")
    out = {r.doc_id: r.text for r in pipelines.convert(docs, stage.Transform("id", stage.identity, delay=0), known, describe=stage.Transform("d", described, retries=1, delay=0)).collect()}
    assert 'title: "Given"' in out[1] and 'lang: "de"' in out[1] and 'author: "Unknown"' in out[1] and 'title: "From the text"' in out[2] and out[2].endswith("Other text.")


def test_clients():
    sent = []

    def answering(answer):
        def send(url, headers, body):
            sent.append((url, headers, body))
            return answer

        return send

    good = {"candidates": [{"finishReason": "STOP", "content": {"parts": [{"text": "thinking", "thought": True}, {"text": "hello"}]}}]}
    assert clients.generate("m", base="http://x", send=answering(good))("sys", "in") == "hello"
    assert sent[-1][0] == "http://x/models/m:generateContent" and sent[-1][2]["systemInstruction"]["parts"][0]["text"] == "sys"
    for bad in ({"promptFeedback": {"blockReason": "OTHER"}}, *({"candidates": [{"finishReason": r}]} for r in stage.REFUSALS)):
        with pytest.raises(stage.Blocked):
            clients.generate("m", send=answering(bad))("", "in")
    for empty in ({}, {"candidates": [{"finishReason": "STOP"}]}):
        with pytest.raises(stage.Empty):
            clients.generate("m", send=answering(empty))("", "in")
    assert clients.chat("m", "http://x/", send=answering({"choices": [{"message": {"content": "hi"}}]}))("", "in") == "hi" and sent[-1][0] == "http://x/chat/completions"
    with pytest.raises(stage.Blocked):
        clients.chat("m", "http://x", send=answering({"choices": [{"finish_reason": "content_filter"}]}))("", "in")
    with pytest.raises(stage.Empty):
        clients.chat("m", "http://x", send=answering({"choices": []}))("", "in")
    assert (clients.chatting("m", "http://x").retries, clients.generating("m").max_delay) == (8, 120.0)


def test_calls_over_http():
    import http.server
    import threading

    codes = [503, 200, 400]

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            code = codes.pop(0)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": body["messages"][-1]["content"].upper()}}]}).encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    ask = stage.Transform("m", clients.chat("m", base), retries=3, delay=0)
    assert ask.call("", "abc") == "ABC" and codes == [400]
    with pytest.raises(Exception, match="400"):
        ask.call("", "abc")
    server.shutdown()
    server.server_close()
    with pytest.raises(stage.Retryable):
        clients.chat("m", base)("", "x")


def lettered(content):
    if content == b"none":
        return []
    return [c for c in content.decode()]


def test_pages_are_read_once(spark, tmp_path):
    from quire.sources import pdf

    files = spark.createDataFrame([("a", b"xy"), ("b", b"xy"), ("c", b"none")], "book_id string, content binary")
    want = {("a", 0, "x"), ("a", 1, "y"), ("b", 0, "x"), ("b", 1, "y")}
    assert {tuple(r) for r in pdf.extracted(files, lettered, str(tmp_path / "s")).collect()} == want

    def failing(content):
        raise RuntimeError("read again")

    assert {tuple(r) for r in pdf.extracted(files, failing, str(tmp_path / "s")).collect()} == want


def drawn(content, page, boxes, prose):
    if page == 1:
        raise RuntimeError("no such page")
    return [f"{content.decode()}:{b[0]}:{len(prose)}".encode() for b in boxes]


def test_figures_are_drawn_by_a_plug_in(spark):
    plan = spark.createDataFrame([("a", p, k, 1.0 * k, 0.0, 9.0, 9.0, f"f{p}{k}") for p in (0, 1) for k in (0, 1)], "book_id string, page int, k int, x0 double, y0 double, x1 double, y1 double, file_name string")
    texts = spark.createDataFrame([("a", 0, 0, 1.0, 1.0, 2.0, 2.0, "t", "body"), ("a", 0, 0, 1.0, 1.0, 2.0, 2.0, "t", "label")], "book_id string, page int, k int, x0 double, y0 double, x1 double, y1 double, text string, kind string")
    books = spark.createDataFrame([("a", b"B")], "book_id string, content binary")
    got = {(r.page, r.k): (r.image and bytes(r.image), r.status) for r in figures.rendered(books, plan, texts, drawn).collect()}
    assert got[0, 1] == (b"B:1.0:1", "ok") and got[1, 0] == (None, "RuntimeError: no such page") and len(got) == 4


def test_markdown_blocks_and_runs():
    from quire.sources import book

    assert book.inline("a **b *c*** `x<y` \\*no\\* [l](u) ![p](i.png) snake_case_word _em_ <&>  \nnext") == (
        'a <strong>b <em>c</em></strong> <code>x&lt;y</code> *no* <a href="u">l</a> <img src="i.png" alt="p"/> snake_case_word <em>em</em> &lt;&amp;&gt;<br/>\nnext'
    )
    md = "Para one\nstill one\n\n> quote\n> **more**\n\n1. a\n2. b\n   - c\n   - d\n\n| h | k |\n|---|---|\n| 1 | 2 |\n\n```py\n# no <heading>\n```\n\n---\n\n### Head {#sec-0009}\n* x"
    assert book.blocks(md.split("\n")) == (
        "<p>Para one\nstill one</p><blockquote><p>quote\n<strong>more</strong></p></blockquote><ol><li>a</li><li>b<ul><li>c</li><li>d</li></ul></li></ol>"
        "<table><thead><tr><th>h</th><th>k</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table><pre><code># no &lt;heading&gt;</code></pre><hr/>"
        '<h3 id="sec-0009">Head</h3><ul><li>x</li></ul>'
    )


def test_markdown_becomes_a_package(spark):
    from xml.etree import ElementTree as ET

    from quire.sources import book

    text = '---\ntitle: "A \\"B\\" & C"\nauthor: "X"\nlang: "bg"\n---\n\nIntro ![f](images/f.png)\n\n# One {#s1}\n\ntext\n\n### Deep {#s2}\n\n## Two & 2 {#s3}\n\n```\n# no\n```\n'
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    images = spark.createDataFrame([(1, "images/f.png", b"PNG")], "doc_id bigint, name string, content binary")
    files = {r.doc_id: epub.unpacked(bytes(r.content)) for r in book.packages(docs, images).collect()}
    assert files[1]["OPS/images/f.png"] == b"PNG" and sum(n.startswith("OPS/ch") for n in files[1]) == 3 and sum(n.startswith("OPS/ch") for n in files[2]) == 1
    for found in files.values():
        for name, data in found.items():
            if name.endswith((".xhtml", ".opf", ".xml")):
                ET.fromstring(data)
    opf, nav = files[1]["OPS/package.opf"].decode(), files[1]["OPS/nav.xhtml"].decode()
    assert '<dc:title>A &quot;B&quot; &amp; C</dc:title>' in opf and "<dc:language>bg</dc:language>" in opf and 'href="images/f.png" media-type="image/png"' in opf
    assert '<ol><li><a href="ch0002.xhtml#s1">One</a><ol><li><a href="ch0002.xhtml#s2">Deep</a></li></ol></li><li><a href="ch0003.xhtml#s3">Two &amp; 2</a></li></ol>' in nav or (
        '<ol><li><a href="ch0002.xhtml#s1">One</a><ol><li><a href="ch0002.xhtml#s2">Deep</a></li><li><a href="ch0003.xhtml#s3">Two &amp; 2</a></li></ol></li></ol>' in nav
    )
    found = epub.entries(book.packages(docs).withColumnRenamed("doc_id", "book_id"))
    again = epub.spine_documents(epub.packages(found), found).groupBy("book_id").agg(F.count("*").alias("n")).collect()
    assert {r.book_id: r.n for r in again} == {"1": 3, "2": 1}


def test_stored_tables_pass(spark):
    import os

    from quire.functions import lineage

    rows = spark.range(5).toDF("n")
    with lineage.passing(spark):
        inner = lineage.stored(rows)
        path = inner.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert inner.count() == 5 and os.path.isdir(path)
    assert not os.path.exists(path)
    kept = lineage.stored(rows)
    assert kept.count() == 5 and kept.dtypes == rows.dtypes
