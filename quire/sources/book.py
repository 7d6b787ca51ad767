"""Finished Markdown as e-book packages: chapters, table of contents, pictures.

A document is split before headings of level 1 and 2.  The Markdown is that of
the pipelines: front matter, headings with ids, paragraphs, quotes, lists, pipe
tables, fenced code, rules, images, links, emphasis.  What is no markup is text.
"""

from __future__ import annotations

import re
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import epub

#: Headings up to this level begin a file.
SPLIT = 2

_HEADING = re.compile(r"(#{1,6})[ \t]+(.+?)[ \t]*(?:\{#([\w.-]+)\})?[ \t]*$")
_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})[ \t]*([^`]*)$")
_RULE = re.compile(r"[ \t]*([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_ITEM = re.compile(r"([ \t]*)([-*+]|\d{1,9}[.)])[ \t]+(.*)$")
_TABLE = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_META = re.compile(r'(\w+):[ \t]*"((?:[^"\\]|\\.)*)"[ \t]*$')
_INLINE = re.compile(
    r"\\([!-/:-@\[-`{-~])|(`+)(.+?)(?<!`)\2(?!`)|(!?)\[((?:[^\[\]\\]|\\.)*)\]\(\s*<?([^\s()<>]*(?:\([^\s()]*\)[^\s()<>]*)*)>?(?:\s+\"[^\"]*\")?\s*\)"
    r"|(\*\*|__)(?=\S)(.+?)(?<=\S)\7(?![*_])|(\*|_)(?=\S)(.+?)(?<=\S)\9| {2,}\n", re.S
)


def inline(text: str) -> str:
    """XHTML of a run of text."""
    out, at = [], 0
    for m in _INLINE.finditer(text):
        # An underscore within a word is no emphasis.
        if (m.group(7) or m.group(9) or "")[:1] == "_" and (text[m.start() - 1 : m.start()].isalnum() or text[m.end() : m.end() + 1].isalnum()):
            continue
        out.append(escape(text[at : m.start()], quote=False))
        at = m.end()
        if m.group(1):
            out.append(escape(m.group(1), quote=False))
        elif m.group(2):
            out.append(f"<code>{escape(m.group(3).strip(), quote=False)}</code>")
        elif m.group(6) is not None:
            label, to = m.group(5), escape(m.group(6))
            out.append(f'<img src="{to}" alt="{escape(label)}"/>' if m.group(4) else f'<a href="{to}">{inline(label)}</a>')
        elif m.group(7):
            out.append(f"<strong>{inline(m.group(8))}</strong>")
        elif m.group(9):
            out.append(f"<em>{inline(m.group(10))}</em>")
        else:
            out.append("<br/>\n")
    return "".join(out) + escape(text[at:], quote=False)


def _cells(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))]


def _list(lines: list[str], at: int) -> tuple[str, int]:
    """(XHTML, next line) of the list that begins at a line; what is indented deeper belongs to its item."""
    first = _ITEM.match(lines[at])
    deep, ordered, items = len(first.group(1)), first.group(2)[0].isdigit(), []
    while at < len(lines):
        m = _ITEM.match(lines[at])
        if m is None or len(m.group(1)) < deep or (len(m.group(1)) == deep and m.group(2)[0].isdigit() != ordered):
            break
        if len(m.group(1)) > deep:
            inner, at = _list(lines, at)
            items[-1][1].append(inner)
            continue
        text, at = [m.group(3)], at + 1
        while at < len(lines) and lines[at].strip() and not _ITEM.match(lines[at]) and not _HEADING.match(lines[at]) and not _FENCE.match(lines[at]):
            text.append(lines[at].strip())
            at += 1
        items.append(("\n".join(text), []))
        if at + 1 < len(lines) and not lines[at].strip() and (n := _ITEM.match(lines[at + 1])) and len(n.group(1)) >= deep:
            at += 1  # a loose list
    tag = "ol" if ordered else "ul"
    return f"<{tag}>" + "".join(f"<li>{inline(t)}{''.join(more)}</li>" for t, more in items) + f"</{tag}>", at


def blocks(lines: list[str], heads: list[tuple[int, str, str]] | None = None) -> str:
    """XHTML of lines; headings are added to ``heads`` as (level, id, text)."""
    out, at = [], 0
    while at < len(lines):
        line = lines[at]
        if not line.strip():
            at += 1
        elif m := _FENCE.match(line):
            end = next((i for i in range(at + 1, len(lines)) if lines[i].strip().startswith(m.group(1)) and not lines[i].strip().strip(m.group(1)[0])), len(lines))
            out.append(f"<pre><code>{escape(chr(10).join(lines[at + 1 : end]), quote=False)}</code></pre>")
            at = end + 1
        elif m := _HEADING.match(line):
            ident = m.group(3) or f"h-{len(heads or []) + 1}"
            if heads is not None:
                heads.append((len(m.group(1)), ident, m.group(2)))
            out.append(f'<h{len(m.group(1))} id="{ident}">{inline(m.group(2))}</h{len(m.group(1))}>')
            at += 1
        elif _RULE.match(line):
            out.append("<hr/>")
            at += 1
        elif line.lstrip().startswith(">"):
            end = next((i for i in range(at, len(lines)) if not lines[i].lstrip().startswith(">")), len(lines))
            out.append(f"<blockquote>{blocks([re.sub(r'^[ \t]*> ?', '', x) for x in lines[at:end]])}</blockquote>")
            at = end
        elif _ITEM.match(line):
            made, at = _list(lines, at)
            out.append(made)
        elif "|" in line and at + 1 < len(lines) and "-" in lines[at + 1] and "|" in lines[at + 1] and _TABLE.match(lines[at + 1]):
            end = next((i for i in range(at + 2, len(lines)) if "|" not in lines[i]), len(lines))
            rows = ["".join(f"<td>{inline(c)}</td>" for c in _cells(x)) for x in lines[at + 2 : end]]
            head = "".join(f"<th>{inline(c)}</th>" for c in _cells(line))
            out.append(f"<table><thead><tr>{head}</tr></thead><tbody>{''.join(f'<tr>{r}</tr>' for r in rows)}</tbody></table>")
            at = end
        else:
            end = at + 1
            while end < len(lines) and lines[end].strip() and not any(p.match(lines[end]) for p in (_HEADING, _FENCE, _RULE, _ITEM)) and not lines[end].lstrip().startswith(">"):
                end += 1
            out.append(f"<p>{inline(chr(10).join(x.strip() if i == end - at - 1 else x.lstrip() for i, x in enumerate(lines[at:end])))}</p>")
            at = end
    return "".join(out)


def parsed(text: str) -> tuple[dict[str, str], list[tuple[str, str]], list[tuple[int, str, int, str]]]:
    """(front matter, chapters as (heading, XHTML), contents as (level, text, chapter from 1, id)) of a document."""
    lines, meta = text.split("\n"), {}
    if lines[0].strip() == "---" and (end := next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), None)):
        for line in lines[1:end]:
            if m := _META.match(line):
                meta[m.group(1)] = re.sub(r"\\(.)", r"\1", m.group(2))
        lines = lines[end + 1 :]
    starts, fence = [], None
    for i, line in enumerate(lines):
        m = _FENCE.match(line)
        if m and (fence is None or (line.strip().startswith(fence) and not line.strip().strip(fence[0]))):
            fence = m.group(1) if fence is None else None
        elif fence is None and (m := _HEADING.match(line)) and len(m.group(1)) <= SPLIT:
            starts.append(i)
    bounds = sorted({0, *starts, len(lines)})
    chapters, contents = [], []
    heads: list[tuple[int, str, str]] = []
    for lo, hi in zip(bounds, bounds[1:]):
        before = len(heads)
        body = blocks(lines[lo:hi], heads)
        if body:
            own = heads[before:]
            chapters.append((re.sub(r"<[^>]+>", "", inline(own[0][2])) if own else escape(meta.get("title", ""), quote=False), body))
            contents += [(level, re.sub(r"<[^>]+>", "", inline(t)), len(chapters), ident) for level, ident, t in own]
    return meta, chapters or [("", "<p></p>")], contents


def to_package(text: str, images: dict[str, bytes] | None = None) -> bytes:
    """A package of a finished Markdown document; ``images`` by the path that the document uses."""
    meta, chapters, contents = parsed(text)
    return epub.compiled(meta.get("title", "Untitled"), meta.get("author", "Unknown"), meta.get("lang", "en"), chapters, contents, images, marked_up=True)


def packages(docs: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(doc_id, content): packages of documents (doc_id, text), with the pictures (doc_id, name, content) of each.

    A document is one package and so one row, with all its pictures.  Null texts make empty books.
    """
    rows = docs.select("doc_id", "text")
    if images is not None:
        by = images.groupBy("doc_id").agg(F.collect_list(F.struct("name", "content")).alias("images"))
        rows = rows.join(by, "doc_id", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                has = {x["name"]: x["content"] for x in (row.column(2)[0].as_py() or [])} if row.num_columns > 2 else {}
                yield pa.RecordBatch.from_arrays([row.column(0), pa.array([to_package(row.column(1)[0].as_py() or "", has)], pa.binary())], names=["doc_id", "content"])

    return rows.mapInArrow(run, f"doc_id {kind}, content binary")
