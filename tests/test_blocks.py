import random

import pytest

from quire.operators import blocks as B
from quire.operators import pack


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def texts(rows, order="block_no", col="text"):
    return [r[col] for r in sorted(rows.collect(), key=lambda r: (r.doc_id, r[order]))]


def test_page_artifacts(spark):
    rows = B.lines(docs(spark, "a\n---\n\n 12 \n\nb\n7\nc\n-----\n3"))
    assert texts(B.without_page_artifacts(rows), "line_no", "line") == ["a", "", "", "b", "7", "c"]
    assert texts(B.without_page_artifacts(B.lines(docs(spark, "7\nx\n9"))), "line_no", "line") == ["7", "x", "9"]


@pytest.mark.parametrize(
    ("blocks", "expected"),
    [
        (["One two", "three four."], ["One two three four."]), (["Done.", "next"], ["Done.", "next"]), (["hyphen-", "ated word"], ["hyphenated word"]), (["One", "Two"], ["One", "Two"]),
        (["# Head", "lower"], ["# Head", "lower"]), (["a", "![x](y)", "b"], ["a", "![x](y)", "b"]), (["a", "b", "c"], ["a b c"]), (["He said:", "ok"], ["He said:", "ok"]), (["x", "ªb"], ["x ªb"]),
    ],
)
def test_merged_paragraphs(spark, blocks, expected):
    assert texts(B.merged_paragraphs(B.blocks(docs(spark, "\n\n".join(blocks))))) == expected


TOC = [
    (["Intro", "## Contents", "One ..... 3", "# Book", "Two ..... 9", "## Chapter", "Text."], ["Intro", "## Chapter", "Text."]),
    (["# **Table of contents**", "|a|1|\n|b|2|", "**6**", "Prose here."], ["Prose here."]), (["# Contents", "Real prose."], ["# Contents", "Real prose."]),
    (["# Contents", "# Short", "Prose."], ["# Contents", "# Short", "Prose."]), (["A ..... 3", "B"], ["A ..... 3", "B"]), (["# Contents", "A ... 1", "# H1", "# H2", "C … 2", "D…… 3", "P"], None),
]


@pytest.mark.parametrize(("blocks", "expected"), TOC[:-1])
def test_contents(spark, blocks, expected):
    assert texts(B.without_contents(B.blocks(docs(spark, "\n\n".join(blocks))))) == expected


def test_watermarks(spark):
    hosts = spark.createDataFrame([("www.site.org",)], "host string")
    rows = B.blocks(docs(spark, "*https://site.org/x*\n\nsite.org said\n\nSITE.ORG\n\nsite.organic"))
    assert texts(B.without_watermarks(rows, hosts)) == ["site.org said", "site.organic"]


def brute_headings(text):
    import re

    inside, n, out = False, 0, []
    for line in text.split("\n"):
        s = line.strip()
        if re.fullmatch(r"(`{3,}|~{3,})\s*", s):
            inside = not inside
        elif re.fullmatch(r"`{3,}[^`]*|~{3,}.*", s):
            inside = True
        elif not inside and re.match(r"#{1,6}[ \t]+.+", line):
            n += 1
            line = f"{line.rstrip()} {{#sec-{n:04d}}}"
        out.append(line)
    return out


def test_heading_ids_against_a_scan(spark):
    rng = random.Random(3)
    made = ["\n".join(rng.choice(["# A", "## B c  ", "```", "~~~", "```py", "~~~x", "text", "", "``` not a fence `"]) for _ in range(12)) for _ in range(60)]
    got = B.with_heading_ids(B.lines(docs(spark, *[m + "\nend" for m in made]))).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.line_no)):
        by.setdefault(r.doc_id, []).append(r.line)
    assert [by[i] for i in range(60)] == [brute_headings(m + "\nend") for m in made]


def greedy(ns, target):
    out, chunk, size, some = [], 1, 0, False
    for n in ns:
        if some and size + n > target:
            chunk, size = chunk + 1, 0
        size, some = size + n, True
        out.append(chunk)
    return out


@pytest.mark.parametrize("pack_by", [pack.packed, pack.packed_natively])
def test_packing(spark, pack_by):
    rng = random.Random(1)
    lists = [[40, 40, 40], [500], [100, 10], [100, 90], [30] * 5, [0, 0, 200, 0], [rng.randint(0, 99) for _ in range(200)]]
    rows = spark.createDataFrame([(d, i, n) for d, ns in enumerate(lists) for i, n in enumerate(ns)], "doc_id bigint, block_no int, n_words bigint")
    got = {}
    for r in sorted(pack_by(rows, 100).collect()):
        got.setdefault(r.doc_id, []).append(r.chunk_no)
    assert [got[d] for d in range(len(lists))] == [greedy(ns, 100) for ns in lists]


def test_tail_merge(spark):
    rows = spark.createDataFrame([(1, 0, 100), (1, 1, 10), (2, 0, 100), (2, 1, 90), (3, 0, 5)], "doc_id bigint, block_no int, n_words bigint")
    got = sorted((r.doc_id, r.block_no, r.chunk_no) for r in pack.with_tail_merged(pack.packed(rows, 100), 100).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 0, 1), (2, 1, 2), (3, 0, 1)]
