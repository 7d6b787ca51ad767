"""Main-text extraction by wrapper induction.

Pages are parsed once, into trees of block elements (tag soup is repaired as
browsers do: a block start ends an open paragraph, an end tag closes what is open
inside it).  Like siblings are one repeated node: runs of them, and of a label
that comes back among its siblings all runs between the first and the last one.
So a node has at most three kids of a label, whatever the length of a page.

Induction, per host: the distinct tree shapes of its pages are aligned by simple
tree matching (the largest order-preserving mapping of nodes with equal labels)
and merged into one wrapper tree, in a tree of merges of ``FAN`` shapes each, so
no task holds the shapes of a host.  The nodes of every shape are aligned to the
wrapper, and the text at each wrapper node is summed up over all pages of the
host: nodes with one text on three or more different pages are template, the
others are slots.

Extraction: the text of slots is content unless the node's role says otherwise
(menus, headers, footers, sidebars, notices, adverts, forms, comments: by tag,
role, class and id, or a menu's share of link text).  Where a page marks its
article (``article`` or ``main``), what is inside is its text, constant headings
included; there only a marked region that is constant as a whole is template.
A page that would have no text left keeps what is constant.

Parsing is the only work on the pages' source.  It writes the blocks of text and
their places as a table in the shared folder; all that follows reads places and
hashes of it, and the result is put together from it.
"""

from __future__ import annotations

import re
import sys
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, stored

#: Shapes merged at a time into a wrapper.
FAN = 64
#: Tables of at most this size are sent to every executor, and joined beyond it.
BROADCAST_BYTES = 8 << 20
#: Pages worked on at a time.
ROWS = 64

# HTML elements by how they are parsed and used.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
BLOCK = frozenset(
    "html head body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul xmp".split()
)
ENDS_P = BLOCK - frozenset("html head body option optgroup caption td th tr tbody thead tfoot legend summary".split())
SKIPPED = frozenset("head script style textarea title noscript template iframe noframes nav footer aside menu dialog button select object canvas audio video option datalist".split())
#: The same unless they hold most of the page.
FORMS = frozenset(["form", "fieldset"])
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
_KNOWN = r"(?:(?:site|main|primary|secondary|top|bottom|left|right|side|global|mobile|sticky|page|post|entry|article|blog|user|reader|footer|header|banner|google|wp)[-_])?"
_REST = r"(?:[-_](?!(?:open|opened|closed|on|off|enabled|disabled|active|free)(?:\s|$))[^\s]*)?(?:\s|$)"
#: Whole class and id values, alone or with a known word before or any after, that mark what is not article text;
#: what they say of a block's state (comments-open) marks nothing.
NOISE = re.compile(
    rf"(?:^|\s){_KNOWN}(?:ad|ads|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookie\w*|consent|gdpr|notice|notices|popup|modal|overlay|newsletter|subscri\w*|signup|login"
    r"|nav|navbar|navigation|menu|menus|breadcrumb\w*|sidebar\w*|side-bar|widget\w*|footer|topbar|social|share|sharing|pagination|pager|toolbar|skip-link)" + _REST
)
#: The same outside of an article only: in it, these hold its title.
HEADS = re.compile(rf"(?:^|\s)(?!(?:page|post|entry|article|blog)[-_]){_KNOWN}(?:header|masthead){_REST}")
#: The same for texts by others, which may be longer than the article.
OTHERS = re.compile(rf"(?:^|\s){_KNOWN}(?:comment|comments|commentlist|disqus|respond|replies|related|recommend\w*){_REST}")
#: Articles that are a reader's comment, and those that point to another page.
COMMENT = re.compile(r"(?:^|\s)(?:(?:node|post|user|reader|entry|article|blog|wp)[-_])?(?:comment|reply)" + _REST)
TEASER = re.compile(r"(?:^|\s)(?:(?:node|post|entry|article|blog|item)[-_])?(?:teaser|related|recommend\w*|promo\w*|sponsor\w*|advert\w*)" + _REST)
#: Elements that hold the prose of a page.
PROSE = frozenset("p pre blockquote article main".split())
ARTICLE = frozenset(["article", "main"])

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|itemprop|href|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s\"'>]+))?", re.I)


_ITEM_END = frozenset("ul ol dl menu select table td th".split())
_CELL_END = frozenset(["tr", "table"])
_TABLE = frozenset(["table"])
_ENDED = ("p", "h1", "h2", "h3", "h4", "h5", "h6")
_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in RAW}


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): unescape((v or "").strip("\"'")) for k, v in _ATTR.findall(raw)} if raw else {}


class Page:
    """A parsed page: elements in order of their starts, and ``items``: an element's number at its start, its complement at
    its end, and texts (references still encoded) between."""

    def __init__(self, html: str | None):
        self.tag, self.attrs, self.parent, self.items = ["#page"], [{}], [-1], []
        self._read(html or "")

    def _read(self, text: str) -> None:
        tags, items = self.tag, self.items
        stack, places, blocks, at = [0], {}, [], 0  # places: of a tag's open elements in the stack

        def pop():
            i = stack.pop()
            places[tags[i]].pop()
            if tags[i] in BLOCK:
                blocks.pop()
            items.append(~i)

        def close(tag: str, limit: int) -> None:
            """Ends the innermost open element of a tag, if it is above a place of the stack."""
            own = places.get(tag)
            if own and own[-1] > limit:
                upto = own[-1]
                while len(stack) > upto:
                    pop()

        def last(stop) -> int:
            return max((places[t][-1] for t in stop if places.get(t)), default=0)

        while True:
            m = _TOKEN.search(text, at)
            if m is None:
                if at < len(text):
                    items.append(text[at:])
                break
            if m.start() > at:
                items.append(text[at : m.start()])
            at = m.end()
            tag = m.group(2)
            if tag is None:
                if m.group().startswith("<![CDATA["):
                    items.append(m.group()[9:].removesuffix("]]>").replace("&", "&amp;"))
                continue
            tag = tag.lower().replace("(", "").replace(")", "")
            if m.group(1):
                close(tag, 0 if tag in BLOCK or not blocks else blocks[-1])
                continue
            if tag in ENDS_P and places.get("p") and blocks[-1] == places["p"][-1]:
                close("p", 0)
            if tag in ("li", "dt", "dd", "option"):
                for x in ("dt", "dd") if tag in ("dt", "dd") else (tag,):
                    close(x, last(_ITEM_END))
            elif tag in ("td", "th"):
                close("td", last(_CELL_END))
                close("th", last(_CELL_END))
            elif tag == "tr":
                close("tr", last(_TABLE))
            if tag in BLOCK:  # inline elements left open end with their block
                while len(stack) > 1 and tags[stack[-1]] not in BLOCK and (
                    tags[stack[-1]] not in ("a", "ins", "del", "span", "font", "custom") or any(places.get(t) for t in _ENDED)
                ):
                    pop()
            i = len(tags)
            tags.append(tag)
            self.attrs.append(attributes(m.group(3)))
            self.parent.append(stack[-1])
            items.append(i)
            if tag in VOID or m.group(3).endswith("/") and tag not in BLOCK:
                items.append(~i)
                continue
            if tag in RAW:
                end = _RAW_END[tag].search(text, at)
                stop = end.start() if end else len(text)
                if tag == "xmp":
                    items.append(text[at:stop].replace("&", "&amp;"))
                items.append(~i)
                close_at = text.find(">", stop)
                at = len(text) if end is None or close_at < 0 else close_at + 1
                continue
            places.setdefault(tag, []).append(len(stack))
            if tag in BLOCK:
                blocks.append(len(stack))
            stack.append(i)
        while len(stack) > 1:
            pop()


_noise: dict[str, tuple] = {}


def named(attrs: dict) -> str:
    """Class and id values in lower case."""
    return f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().strip() if attrs else ""


def _said(names: str) -> tuple:
    """What class and id values say: (noise, noise outside of an article, texts by others, comment, teaser)."""
    found = _noise.get(names)
    if found is None:
        others = bool(OTHERS.search(names))
        inside = others or bool(NOISE.search(names))
        found = (inside, inside or bool(HEADS.search(names)), others, bool(COMMENT.search(names)), bool(TEASER.search(names)))
        if len(_noise) > 50_000:
            _noise.clear()
        _noise[names] = found
    return found


_QUIET = (False,) * 5


class Roles:
    """What the elements of a page are by their tags, attributes and texts."""

    def __init__(self, page: Page):
        self.page, n = page, len(page.tag)
        self.said = [_said(names) if a and (names := named(a)) else _QUIET for a in page.attrs]
        self._sums = None
        self.hidden = [self._hidden(i) for i in range(n)]
        self.marked = self._marks()

    def _hidden(self, i: int) -> bool:
        a = self.page.attrs[i]
        return self.page.tag[i] in SKIPPED or bool(a) and (
            "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in ROLES or "comment" in a.get("itemprop", "").lower()
        )

    def sums(self):
        """By element: characters of prose and of all text outside of links, articles and mains (all without what is hidden),
        characters of text, of linked text, and whether a paragraph or title is in it."""
        if self._sums is None:
            tag, parent, n = self.page.tag, self.page.parent, len(self.page.tag)
            prose, text, articles, mains, total, linked, has = ([0] * n for _ in range(7))
            at = 0
            for x in self.page.items:
                if isinstance(x, str):
                    size = len(x.strip())
                    text[at] += size
                    total[at] += size
                else:
                    at = x if x >= 0 else parent[~x]
            for i in range(n - 1, 0, -1):
                up, t = parent[i], tag[i]
                total[up] += total[i]
                linked[up] += total[i] if t == "a" else linked[i]
                has[up] |= has[i] or t in ("p", "h1")
                if t != "a" and not self.hidden[i] and t != "header":
                    prose[up] += text[i] if t in PROSE else prose[i]
                    text[up] += text[i]
                    articles[up] += articles[i] + (t == "article")
                    mains[up] += mains[i] + (t == "main")
            self._sums = prose, text, articles, mains, total, linked, has
        return self._sums

    def _most(self, i: int) -> bool:
        prose, text, *_ = self.sums()
        return 2 * prose[i] > prose[0] and 2 * text[i] > text[0]

    def skipped(self, i: int, inside: bool) -> bool:
        """Whether an element is no article text by its role, class or id; ``inside``: an article is around it.

        A form, or an element whose class or id mark it, stays if it holds the page's main or most of its prose.
        """
        tag = self.page.tag[i]
        if self.hidden[i] or (tag == "header" and not inside):
            return True
        if tag in FORMS:
            _, _, articles, mains, *_ = self.sums()
            return not (mains[i] or articles[i] or self._most(i))
        said = self.said[i]
        if not said[0 if inside else 1] or tag in ("html", "body", "article", "main"):
            return False
        prose, _, articles, mains, *_ = self.sums()
        if mains[i]:
            return False
        return not (prose[i] and (articles[i] == 1 or not said[2]) and self._most(i))

    def commented(self, i: int) -> bool:
        """Whether an element is an article that is a reader's comment."""
        return self.page.tag[i] == "article" and self.said[i][3]

    def _marks(self) -> bool:
        """Whether the page marks its article: an article or main that is reached, and no comment or teaser."""
        tag, parent = self.page.tag, self.page.parent
        if "article" not in tag and "main" not in tag:
            return False
        reached = [True] * len(tag)
        for i in range(1, len(tag)):
            reached[i] = reached[parent[i]] and not self.skipped(i, False) and not self.commented(i)
            if reached[i] and (tag[i] == "main" or tag[i] == "article" and not self.said[i][4]):
                return True
        return False

    def menu(self, i: int) -> bool:
        """Whether an element is a menu by its share of link text."""
        *_, total, linked, has = self.sums()
        return self.page.tag[i] in ("ul", "ol", "div", "table") and total[i] > 0 and 2 * linked[i] > total[i] and not has[i]


def pieces(page: Page) -> list[tuple[int, int, str]]:
    """(element, marked region or -1, text) of the blocks of article text in page order, before induction."""
    roles = Roles(page)
    out = _pieces(page, roles, False)
    return out or _pieces(page, roles, True)  # a page of nothing but comments: they are its text


def _pieces(page: Page, roles: Roles, comments: bool) -> list[tuple[int, int, str]]:
    tag, marked, out, buffer = page.tag, roles.marked, [], []
    around = [(False, False, 0, -1)]  # of open elements: inside an article, dropped, block, region

    def flush():
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                out.append((around[-1][2], around[-1][3], text))

    for x in page.items:
        inside, dropped, block, region = around[-1]
        if isinstance(x, str):
            if not dropped and (inside or not marked):
                buffer.append(unescape(x))  # each text alone: a reference never goes on in the next element
        elif x < 0:
            if tag[~x] in BLOCK:
                flush()
            around.pop()
        elif dropped:
            around.append((inside, True, block, region))
        else:
            t = tag[x]
            if t in BLOCK:
                flush()
            if t in VOID:
                if t in ("br", "hr"):
                    buffer.append(" ")
            elif roles.skipped(x, inside) or not (inside or comments or not roles.commented(x)):
                dropped = True
            else:
                within = inside or t in ARTICLE
                if not within and not marked and roles.menu(x):
                    dropped = True
                region = x if marked and within and not inside else region
                inside = within
            around.append((inside, dropped, x if t in BLOCK else block, region))
    flush()
    return out


# ---- shapes and simple tree matching ------------------------------------------------


class Shape:
    """A label and kids; equal shapes are one object, as long as the tables are not cleared (``fresh``)."""

    __slots__ = ("label", "kids", "size", "number", "offsets")

    def __init__(self, label: str, kids: tuple, number: int):
        self.label, self.kids, self.number = label, kids, number
        self.offsets, at = [], 1
        for k in kids:
            self.offsets.append(at)
            at += k.size
        self.size = at


_shapes: dict[tuple, Shape] = {}
_matches: dict[tuple, int] = {}
_aligned: dict[tuple, list] = {}
_merged: dict[tuple, Shape] = {}
_count = iter(range(1 << 62))


def fresh(most: int = 200_000) -> None:
    """Clears the tables of shapes if they are large; shapes made before must not be used any more."""
    if len(_shapes) + len(_matches) + len(_aligned) + len(_merged) > most:
        for table in (_shapes, _matches, _aligned, _merged):
            table.clear()


def shape(label: str, kids) -> Shape:
    key = (label, *(k.number for k in kids))
    found = _shapes.get(key)
    if found is None:
        found = _shapes[key] = Shape(label, tuple(kids), next(_count))
    return found


def _chain(a: Shape, b: Shape) -> tuple[int, list[tuple[int, int]]]:
    """Weight and pairs of the heaviest order-preserving mapping of the kids of two shapes, those of one label only."""
    by: dict[str, list[int]] = {}
    for j, k in enumerate(b.kids):
        by.setdefault(k.label, []).append(j)
    best: list = [None] * (len(b.kids) + 1)  # a tree of maxima over places in b: (weight, i, j, before)

    for i, k in enumerate(a.kids):
        ready = []
        for j in by.get(k.label, ()):
            at, before = j, None
            while at:
                if best[at] is not None and (before is None or best[at][0] > before[0]):
                    before = best[at]
                at &= at - 1
            ready.append((match(k, b.kids[j]) + (before[0] if before else 0), i, j, before))
        for found in ready:
            at = found[2] + 1
            while at < len(best):
                if best[at] is None or best[at][0] < found[0]:
                    best[at] = found
                at += at & -at
    last, at = None, len(b.kids)
    while at:
        if best[at] is not None and (last is None or best[at][0] > last[0]):
            last = best[at]
        at &= at - 1
    weight, pairs = last[0] if last else 0, []
    while last:
        pairs.append((last[1], last[2]))
        last = last[3]
    return weight, pairs[::-1]


def match(a: Shape, b: Shape) -> int:
    """Size of the largest order-preserving mapping of two shapes with equal labels."""
    if a is b:
        return a.size
    if a.label != b.label:
        return 0
    if not a.kids or not b.kids:
        return 1
    key = (a.number, b.number)
    found = _matches.get(key)
    if found is None:
        found = _matches[key] = _chain(a, b)[0] + 1
    return found


def aligned(a: Shape, b: Shape) -> list[tuple[int, int]]:
    """Places of the kids of two shapes that are mapped to each other, in order."""
    if a is b:
        return [(i, i) for i in range(len(a.kids))]
    key = (a.number, b.number)
    found = _aligned.get(key)
    if found is None:
        found = _aligned[key] = _chain(a, b)[1]
    return found


def merged(a: Shape, b: Shape) -> Shape:
    """A shape that both shapes (of one label) embed in, along their alignment."""
    if a is b or not b.kids:
        return a
    if not a.kids:
        return b
    key = (a.number, b.number)
    found = _merged.get(key)
    if found is None:
        kids, i, j = [], 0, 0
        for x, y in [*aligned(a, b), (len(a.kids), len(b.kids))]:
            kids += a.kids[i:x]
            kids += b.kids[j:y]
            if x < len(a.kids):
                kids.append(merged(a.kids[x], b.kids[y]))
            i, j = x + 1, y + 1
        found = _merged[key] = shape(a.label, [g[0] for g in grouped([(k, []) for k in kids])])
    return found


def grouped(kids: list[tuple[Shape, list]]) -> list[tuple[Shape, list]]:
    """Repeated nodes among siblings (shape, members): runs of a label, and all its runs but the first and the last one."""
    while True:
        runs: list = []
        for s, members in kids:
            if runs and runs[-1][0].label == s.label:
                runs[-1][0] = merged(runs[-1][0], s)
                runs[-1][1].extend(members)
            else:
                runs.append([s, list(members)])
        places: dict[str, list[int]] = {}
        for i, (s, _) in enumerate(runs):
            places.setdefault(s.label, []).append(i)
        if all(len(p) <= 3 for p in places.values()):
            return [(s, m) for s, m in runs]
        gone = set()
        for p in places.values():
            for i in p[2:-1]:
                runs[p[1]][0] = merged(runs[p[1]][0], runs[i][0])
                runs[p[1]][1].extend(runs[i][1])
                gone.add(i)
        kids = [(s, m) for i, (s, m) in enumerate(runs) if i not in gone]


def dump(s: Shape) -> str:
    out, stack = [], [s]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        out.append(x.label + "(")
        stack.append(")")
        stack.extend(reversed(x.kids))
    return "".join(out)


def load(text: str) -> Shape:
    stack, at = [("", [])], 0
    for m in re.finditer(r"[()]", text):
        if m.group() == "(":
            stack.append((text[at : m.start()], []))
        else:
            label, kids = stack.pop()
            stack[-1][1].append(shape(label, kids))
        at = m.end()
    return stack[0][1][0]


_DIGITS = re.compile(r"\d+")


def label(tag: str, attrs: dict) -> str:
    """Tag, classes and ids; numbers in them are all alike, since ids of articles would make every page's tree another one."""
    names = named(attrs)
    if not names:
        return tag
    return f"{tag}.{' '.join(sorted(_DIGITS.sub('#', names.replace('(', '').replace(')', '')).split()))}"


def tree(page: Page) -> tuple[Shape, dict[int, int]]:
    """Shape of a page, and the place of its block elements in it (in order of starts; those that are not in it are left out)."""
    block_of, kids, blocks = [0] * len(page.tag), {0: []}, [0]
    for i in range(1, len(page.tag)):
        up = block_of[page.parent[i]]
        block_of[i] = up
        if page.tag[i] in BLOCK:
            block_of[i] = i
            kids[up].append(i)
            kids[i] = []
            blocks.append(i)
    shapes, groups = {}, {}
    for i in reversed(blocks):
        groups[i] = grouped([(shapes[k], [k]) for k in kids[i]])
        shapes[i] = shape(label(page.tag[i], page.attrs[i]), [s for s, _ in groups[i]])
    places, stack = {}, [(0, shapes[0], 0)]
    while stack:
        i, whole, at = stack.pop()
        places[i] = at
        for x, y in aligned(whole, shapes[i]):
            for k in groups[i][y][1]:
                stack.append((k, whole.kids[x], at + whole.offsets[x]))
    return shapes[0], places


def placed(own: Shape, wrapper: Shape) -> list[int]:
    """By node of a shape (in order of starts) its place in the wrapper, or -1."""
    out, stack = [-1] * own.size, [(own, 0, wrapper, 0)]
    while stack:
        s, at, w, to = stack.pop()
        out[at] = to
        for x, y in aligned(w, s):
            stack.append((s.kids[y], at + s.offsets[y], w.kids[x], to + w.offsets[x]))
    return out


def hash64(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def read(html: str | None) -> dict:
    """All that later steps need of a page: its shape and the shape's hash ``own``; the texts of its blocks with their slots (place in the shape, -1: none;
    below -1: minus 2 minus the place of the marked region that they are in); the hash of each slot's whole text."""
    fresh()
    page = Page(html)
    found = pieces(page)
    own, places = tree(page)
    slots = [places.get(block, -1) if region < 0 else -2 - places[region] if region in places else -1 for block, region, _ in found]
    texts = [t for _, _, t in found]
    whole: dict[int, list[str]] = {}
    for s, t in zip(slots, texts, strict=True):
        if s != -1:
            whole.setdefault(s, []).append(t)
    form = dump(own)
    return {"page": hash64(html or ""), "own": hash64(form), "shape": form, "slots": slots, "texts": texts, "keys": list(whole), "hashes": [hash64("\n".join(t)) for t in whole.values()]}


def extract(html: str | None) -> str:
    """Article text of one page alone."""
    return " ".join(read(html)["texts"])


# ---- Spark ---------------------------------------------------------------------------

HOST = r"lower(regexp_extract(url, r'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_DEEP = 1_000_000  # calls between Python functions take no stack of the machine


def parsed(pages: DataFrame) -> DataFrame:
    """One row per page of (page_id, url, host, html): page_id, url, host and the fields of ``read``; null html is empty."""
    kinds = {"page": pa.int64(), "own": pa.int64(), "shape": pa.string(), "slots": pa.list_(pa.int32()), "texts": pa.list_(pa.string()), "keys": pa.list_(pa.int32()), "hashes": pa.list_(pa.int64())}

    def run(batches):
        sys.setrecursionlimit(_DEEP)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                rows = [read(h) for h in batch.column(3).to_pylist()]
                cols = [pa.array([r[k] for r in rows], kind) for k, kind in kinds.items()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], names=["page_id", "url", "host", *kinds])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), "host", F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, host string, page bigint, own bigint, shape string, slots array<int>, texts array<string>, keys array<int>, hashes array<bigint>")


def _folded(rows: DataFrame) -> DataFrame:
    """(host, part, shape) with the rows of each (host, part) merged; they stream in order."""
    rows = rows.repartition("host", "part").sortWithinPartitions("host", "part", "shape")

    def run(batches):
        sys.setrecursionlimit(_DEEP)
        key, whole, out = None, None, []

        def emit():
            cols = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))]
            return pa.RecordBatch.from_arrays(cols, names=["host", "part", "shape"])

        for batch in batches:
            for host, part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == (host, part):
                    whole = merged(whole, load(text))
                    continue
                if key is not None:
                    out.append((*key, dump(whole)))
                fresh()
                key, whole = (host, part), load(text)
            if len(out) > 1000:
                yield emit()
                out = []
        if key is not None:
            out.append((*key, dump(whole)))
        yield emit()

    return rows.mapInArrow(run, "host string, part bigint, shape string")


def induced(shapes: DataFrame) -> DataFrame:
    """(host, wrapper) of distinct (host, shape), neither null: merged ``FAN`` at a time, in as many rounds as the host with most shapes needs."""
    most = shapes.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    rows = shapes.select("host", F.xxhash64("shape").alias("part"), "shape")
    width = -(-most // FAN)
    while width > 1:
        rows = cut(_folded(rows.withColumn("part", F.pmod("part", F.lit(width)))))
        width = -(-width // FAN)
    return cut(_folded(rows.withColumn("part", F.lit(0).cast("bigint")))).select("host", F.col("shape").alias("wrapper"))


def _sent(table: DataFrame, size) -> DataFrame:
    """A table marked to be sent to every executor if the sum of ``size`` is within ``BROADCAST_BYTES``."""
    return F.broadcast(table) if (table.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else table


def _places(shapes: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, own, places) of every distinct (host, shape): own is the hash of the shape, places where its nodes are in the wrapper."""

    def run(batches):
        sys.setrecursionlimit(_DEEP)
        for batch in batches:
            hosts, texts, trees = (c.to_pylist() for c in batch.columns)
            out = []
            for text, wrapper in zip(texts, trees, strict=True):
                fresh()
                out.append(placed(load(text), load(wrapper)))
            own = [hash64(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int64()), pa.array(out, pa.list_(pa.int32()))], names=["host", "own", "places"])

    joined = shapes.join(_sent(wrappers, F.length("wrapper") + 64), "host").select("host", "shape", "wrapper")
    return joined.mapInArrow(run, "host string, own bigint, places array<int>")


def template(blocks: DataFrame) -> DataFrame:
    """(host, own, dropped) from rows of ``parsed``: the slots that are template, where there are any."""
    shapes = cut(blocks.select("host", "shape").distinct())
    places = cut(_places(shapes, induced(shapes)))
    at = F.expr("if(key >= 0, get(places, key), if(get(places, -2 - key) >= 0, -2 - get(places, -2 - key), -1))")
    seen = blocks.select("host", "own", "page", F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("hashes").alias("hash"))).alias("s")).select("host", "own", "page", "s.*")
    per = seen.groupBy("host", "own", "key").agg(F.min("hash").alias("a"), F.max("hash").alias("b"), F.min("page").alias("p"), F.max("page").alias("q"))
    per = per.join(places, ["host", "own"]).withColumn("node", at).where("node != -1")
    nodes = per.groupBy("host", "node").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min("p").alias("p"), F.max("q").alias("q"))
    # One text on two pages or more; a page between the least and the greatest is a third one.
    same = nodes.where("a = b and p < q").select("host", "node", "p", "q")
    slots = cut(per.select("host", "own", "key", "node").join(same, ["host", "node"]))
    third = seen.join(_sent(slots, F.length("host") + F.lit(64)), ["host", "own", "key"]).where(F.col("page").between(F.col("p") + 1, F.col("q") - 1))
    chosen = third.select("host", "node").distinct()
    return cut(slots.join(chosen, ["host", "node"]).groupBy("host", "own").agg(F.array_sort(F.collect_set("key")).alias("dropped")))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    Null html is empty; null or hostless urls share the host ''.  Ids may have any
    type and be null.  Repeated pages give repeated rows and count once towards
    the three that make template; an empty table gives no rows; other columns are
    not read.
    """
    rows = pages.select("page_id", "url", F.expr(f"coalesce({HOST}, '')").alias("host"), "html")
    blocks = stored(parsed(rows))
    dropped = template(blocks)
    joined = blocks.select("page_id", "url", "host", "own", "slots", "texts")
    if dropped.isEmpty():
        joined = joined.withColumn("dropped", F.lit(None).cast("array<int>"))
    else:
        joined = joined.join(_sent(dropped, F.length("host") + 4 * F.size("dropped") + 64), ["host", "own"], "left")
    left = "filter(texts, (t, i) -> not coalesce(array_contains(dropped, get(slots, i)), false))"
    text = F.expr(f"element_at(transform(array({left}), k -> array_join(if(size(k) > 0, k, texts), ' ')), 1)")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
