"""XHTML as translation units, and back.

A unit is a block element without block descendants and with text.  Its inline
elements become numbered placeholders, and their tags and attributes go to a map
column, so units can be validated and rebuilt as SQL.

Documents are read as XML first, which keeps names as they are written, comments,
CDATA, what stands before and after the root element, and every text; they are
written back with nothing changed but the units that were replaced.  Only what is
no XML is repaired by HTML's rules: a block start ends an open paragraph, a block's
end ends inlines left open.  Names, comments and raw text stay there too.
"""

from __future__ import annotations

import re
import sys
from html import escape
from html.entities import html5
from html.parser import HTMLParser
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame

# Elements by role.
BLOCKS = frozenset(
    "address article aside blockquote body caption dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
SKIPS = frozenset("script style svg math head title".split())
VOIDS = frozenset("br img hr wbr area col input source".split())
_ALSO_VOID = frozenset("meta link embed base param track".split())
_TOKEN = re.compile(r"\[\[(/?)(\d+)(/?)\]\]")
_LABELS = frozenset(["text", "a"])
#: Tag of what is kept as it is written: comments, instructions, declarations.
KEPT = "!"
_DEEP = 1_000_000  # calls between Python functions take no stack of the machine


class El:
    """``name`` as written, ``tag`` its local part in lower case, ``kids`` elements and texts, ``raw`` what is written as it is."""

    __slots__ = ("name", "tag", "attrs", "kids", "parent", "holds", "raw")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, parent=None, raw: str | None = None):
        self.name, self.attrs, self.kids, self.parent, self.holds, self.raw = name, attrs or {}, [], parent, False, raw
        self.tag = KEPT if raw is not None else name.rpartition(":")[2].lower()
        if parent is not None:
            parent.kids.append(self)


class CData(str):
    """Text that is written as a CDATA section."""


class Raw(str):
    """Text of a script or style that was read by HTML's rules, and is written as it is."""


def _local(name: str) -> str:
    return name.rpartition(":")[2].lower()


class _Html(HTMLParser):
    """A tree by HTML's rules; ``order`` has all elements in order of their starts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = El("")
        self.stack, self.order, self.open = [self.root], [], {}

    def _made(self, attrs) -> El:
        """The element at hand, with names as they are written (the parser gives them in lower case)."""
        text = self.get_starttag_text() or ""
        name = re.match(r"<([^\s/>]+)", text).group(1)
        written = {k.lower(): k for k in re.findall(r"[\s\"'/]([^\s=\"'/>]+)", text)}
        el = El(name, {written.get(k, k): v or "" for k, v in attrs}, self.stack[-1])
        self.order.append(el)
        return el

    def handle_starttag(self, tag, attrs):
        tag = _local(tag)
        if tag in BLOCKS:
            self._end(("p", "h1", "h2", "h3", "h4", "h5", "h6") if tag != "body" else (), BLOCKS - {"p", "h1", "h2", "h3", "h4", "h5", "h6"})
        if tag in ("li", "td", "th", "tr", "dt", "dd"):
            self._end({"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}.get(tag, ("dt", "dd")), frozenset(["ul", "ol", "table", "dl"] + (["tr"] if tag in ("td", "th") else [])))
        el = self._made(attrs)
        if tag not in VOIDS and tag not in _ALSO_VOID:
            self.stack.append(el)
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self._made(attrs)

    def handle_endtag(self, tag):
        tag = _local(tag)
        self._end((tag,), frozenset() if tag in BLOCKS else BLOCKS)

    def handle_data(self, data):
        self.stack[-1].kids.append(Raw(data) if self.stack[-1].tag in ("script", "style") else data)

    def handle_comment(self, data):
        El("", parent=self.stack[-1], raw=f"<!--{data}-->")

    def handle_decl(self, decl):
        El("", parent=self.stack[-1], raw=f"<!{decl}>")

    def unknown_decl(self, data):
        self.stack[-1].kids.append(CData(data[6:])) if data.startswith("CDATA[") else El("", parent=self.stack[-1], raw=f"<![{data}]>")

    def handle_pi(self, data):
        El("", parent=self.stack[-1], raw=f"<?{data}>")

    def _end(self, tags, stops):
        if not any(self.open.get(t) for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                for el in self.stack[i:]:
                    self.open[el.tag] -= 1
                del self.stack[i:]
                return
            if self.stack[i].tag in stops:
                return


def _xml_tree(text: str) -> tuple[El, list[El]]:
    """(root, all elements in order) of a document that is XML; what is around its root element is kept as it is."""
    data = text.encode("utf-8", "surrogatepass")
    parser, top, order = expat.ParserCreate("utf-8"), El(""), []
    parser.buffer_text, parser.ordered_attributes = True, True
    parser.UseForeignDTD(True)  # names of characters that no declaration here explains are no errors
    parser.ExternalEntityRefHandler = lambda *_: 1
    stack, cdata, ends = [top], [False], [0]

    def start(name, attrs):
        if not order:
            El("", parent=top, raw=data[: parser.CurrentByteIndex].decode("utf-8", "surrogatepass"))
        el = El(name, dict(zip(attrs[::2], attrs[1::2], strict=True)), stack[-1])
        order.append(el)
        stack.append(el)

    def end(_):
        stack.pop()
        if len(stack) == 1:
            at = parser.CurrentByteIndex
            ends[0] = data.index(b">", at) + 1 if data[at : at + 2] == b"</" else None

    def skipped(name, is_parameter):
        if not is_parameter:
            known = html5.get(f"{name};")
            stack[-1].kids.append(known) if known else El("", parent=stack[-1], raw=f"&{name};")

    def chars(text):
        stack[-1].kids.append(CData(text) if cdata[0] else text)

    def section(on):
        cdata[0] = on

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, chars
    parser.CommentHandler = lambda x: El("", parent=stack[-1], raw=f"<!--{x}-->") if len(stack) > 1 else None
    parser.ProcessingInstructionHandler = lambda t, x: El("", parent=stack[-1], raw=f"<?{t} {x}?>") if len(stack) > 1 else None
    parser.StartCdataSectionHandler, parser.EndCdataSectionHandler = (lambda: section(True)), (lambda: section(False))
    parser.SkippedEntityHandler = skipped
    parser.Parse(data, True)
    if ends[0]:
        El("", parent=top, raw=data[ends[0] :].decode("utf-8", "surrogatepass"))
    return top, order


def tree(xhtml: str | None) -> El:
    """A document's tree; its elements know whether they hold a block."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), _DEEP))
    try:
        root, order = _xml_tree(xhtml or "")
    except (expat.ExpatError, ValueError):
        parser = _Html()
        parser.feed(xhtml or "")
        parser.close()
        root, order = parser.root, parser.order
    for el in reversed(order):
        if el.holds or el.tag in BLOCKS:
            el.parent.holds = True
    return root


def serialised(el: El) -> tuple[str, dict[int, El]]:
    """(text with placeholders, inline elements by number); skipped elements and comments leave no text."""
    found: dict[int, El] = {}

    def inner(node: El) -> str:
        out = []
        for k in node.kids:
            if isinstance(k, str):
                out.append(k)
            elif k.tag not in SKIPS and k.tag != KEPT:
                n = len(found) + 1
                found[n] = k
                body = inner(k)
                out.append(f"[[{n}/]]" if k.tag in VOIDS or not k.kids else f"[[{n}]]{body}[[/{n}]]")
        return "".join(out)

    return inner(el), found


def _units(root: El) -> list[tuple[El, str, dict[int, El]]]:
    """(element, text, inline elements) of the units of a tree in order."""
    out, stack = [], [root]
    while stack:
        el = stack.pop()
        if el.tag in SKIPS or el.tag == KEPT:
            continue
        if el.parent is None or el.holds:
            stack.extend(k for k in reversed(el.kids) if not isinstance(k, str))
            continue
        text, found = serialised(el)
        if _TOKEN.sub("", text).strip():
            out.append((el, text, found))
    return out


def units_of(xhtml: str | None) -> list[tuple[El, str, dict[int, El]]]:
    return _units(tree(xhtml))


UNIT = "doc_id bigint, unit_no int, tag string, text string, n_words int, unsafe boolean, inlines map<int,struct<tag:string,attrs:map<string,string>>>"


def units(pages: DataFrame, doc_id: str = "doc_id", html: str = "html") -> DataFrame:
    """Rows of UNIT in document order; unsafe marks text that held placeholder-like strings of its own."""
    kind = pa.map_(pa.int32(), pa.struct({"tag": pa.string(), "attrs": pa.map_(pa.string(), pa.string())}))
    schema = pa.schema([("doc_id", pa.int64()), ("unit_no", pa.int32()), ("tag", pa.string()), ("text", pa.string()), ("n_words", pa.int32()), ("unsafe", pa.bool_()), ("inlines", kind)])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = []
                for d, h in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns), strict=True):
                    for n, (el, text, found) in enumerate(units_of(h), 1):
                        own = len(_TOKEN.findall(text)) != sum(1 if k.tag in VOIDS or not k.kids else 2 for k in found.values())
                        inl = [(i, {"tag": k.name, "attrs": list(k.attrs.items())}) for i, k in found.items()]
                        rows.append({"doc_id": d, "unit_no": n, "tag": el.tag, "text": text, "n_words": len(_TOKEN.sub(" ", text).split()), "unsafe": own, "inlines": inl})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return pages.selectExpr(f"cast({doc_id} as bigint) as doc_id", html).mapInArrow(run, UNIT)


def _full(el: El) -> str:
    return "".join(k if isinstance(k, str) else _full(k) for k in el.kids)


def _labels(root: El) -> list[tuple[El, str]]:
    """(element, text) of the labels of a tree in order: every text and a element with text, also one in another."""
    out, stack = [], [root]
    while stack:
        el = stack.pop()
        if el.tag in _LABELS and (text := _full(el).strip()):
            out.append((el, text))
        stack.extend(k for k in reversed(el.kids) if not isinstance(k, str))
    return out


def nav_labels(pages: DataFrame, doc_id: str = "doc_id", html: str = "html") -> DataFrame:
    """(doc_id, label_no, text): the labels of each document, in order."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                rows = [(d, n, t) for d, h in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns), strict=True) for n, (_, t) in enumerate(_labels(tree(h)), 1)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.string()))], names=["doc_id", "label_no", "text"])

    return pages.selectExpr(f"cast({doc_id} as bigint) as doc_id", html).mapInArrow(run, "doc_id bigint, label_no int, text string")


def _value(text: str) -> str:
    return escape(text).replace("\n", "&#10;").replace("\t", "&#9;")


def _xml(root: El) -> str:
    out, stack = [], [(root, False)]
    while stack:
        x, foreign = stack.pop()
        if isinstance(x, Raw):
            out.append(x)
        elif isinstance(x, CData):
            out.append(f"<![CDATA[{x}]]>")
        elif isinstance(x, str):
            out.append(x if foreign is None else escape(x, quote=False))
        elif x.raw is not None:
            out.append(x.raw)
        elif x.parent is None and not x.name:
            stack.extend((k, False) for k in reversed(x.kids))
        else:
            foreign = foreign or x.tag in ("svg", "math")
            head = x.name + "".join(f' {k}="{_value(v)}"' for k, v in x.attrs.items())
            if not x.kids and (foreign or x.tag in VOIDS or x.tag in _ALSO_VOID):
                out.append(f"<{head}/>")
                continue
            out.append(f"<{head}>")
            stack.append((f"</{x.name}>", None))
            stack.extend((k, foreign) for k in reversed(x.kids))
    return "".join(out)


def applied(xhtml: str | None, texts: dict[int, str]) -> str:
    """The document with the texts of some units (by number) replaced; a text that does not nest leaves its unit as it is."""
    root = tree(xhtml)
    for n, (el, _, found) in enumerate(_units(root), 1):
        kids = built(texts[n], found) if texts.get(n) is not None else None
        if kids is not None:
            el.kids = kids
    return _xml(root)


def built(text: str, found: dict[int, El]) -> list | None:
    """Kids of a unit from its text; None if a placeholder is unknown, crosses another or stays open."""
    top: list = []
    stack: list[tuple[int, list]] = [(0, top)]
    at = 0
    for m in _TOKEN.finditer(text):
        if m.start() > at:
            stack[-1][1].append(text[at : m.start()])
        at = m.end()
        n = int(m.group(2))
        if n not in found:
            return None
        if m.group(1):
            if stack[-1][0] != n or len(stack) == 1:
                return None
            stack.pop()
            continue
        el = El(found[n].name, dict(found[n].attrs))
        el.parent = found[n].parent
        stack[-1][1].append(el)
        if not m.group(3):
            stack.append((n, el.kids))
    if at < len(text):
        stack[-1][1].append(text[at:])
    return top if len(stack) == 1 else None


def with_labels(xhtml: str | None, texts: dict[int, str]) -> str:
    """The navigation document with the texts of some labels (by number) replaced; what a label held goes."""
    root = tree(xhtml)
    for n, (el, _) in enumerate(_labels(root), 1):
        if texts.get(n) is not None:
            el.kids = [texts[n]]
    return _xml(root)


def rewritten(pages: DataFrame, results: DataFrame) -> DataFrame:
    """(doc_id, html) of ``pages`` (doc_id, html) with ``results`` (doc_id, unit_no, text) applied."""
    from pyspark.sql import functions as F

    by = results.groupBy("doc_id").agg(F.collect_list(F.struct("unit_no", "text")).alias("units"))
    both = pages.select("doc_id", "html").join(by, "doc_id", "left")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                made = [applied(h, {u["unit_no"]: u["text"] for u in us or []}) for h, us in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.string())], names=["doc_id", "html"])

    kind = pages.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(run, f"doc_id {kind}, html string")
