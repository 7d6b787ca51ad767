"""Benchmark decontamination by winnowing.

Texts are read as bytes in vectorised chunks: word bounds, word hashes and
hashes of ``K`` consecutive words (k-grams) for a whole chunk at once.  Of every
``WINDOW - K + 1`` consecutive k-grams the least hash is kept, on both sides, so
any shared span of ``WINDOW`` words shares a kept fingerprint.  Fingerprints of
the documents are joined to the sorted fingerprints of the benchmark; a hit is
extended to the windows of ``WINDOW`` words that hold it, as far as they are
windows of an item too, and these are compared word by word with one place where
the benchmark has them.  So work follows the words of a text and its hits, also
where texts and items repeat themselves.  Items shorter than a window have no
such guarantee and are looked up whole, by all runs of their length.

The benchmark is sent in blocks of at most ``BLOCK_BYTES`` of text (an item
longer than that is a block), one after the other; with more than one block the
documents are read once per block and the hits are merged by document.  No
document row is shuffled with one block.  An index is built once per Python
worker and block.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, texts_of

WINDOW = 10
K = 5
#: Text bytes worked on at a time; a longer text is taken in overlapping pieces.
CHUNK = 1 << 20
#: Largest text of a benchmark block that is sent to all executors.
BLOCK_BYTES = 32 << 20

NONE = np.uint64(2**64 - 1)
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Words of a chunk of bytes and their hashes; holds the tables that all chunks share."""

    def __init__(self, size: int):
        self.letters = _mixed(np.arange(1, 257, dtype=np.uint64) * STEP)
        self.is_word = np.zeros(256, bool)
        self.is_word[np.r_[0x30:0x3A, 0x61:0x7B, 0x80:0x100]] = True
        self.grow(size)

    def grow(self, size: int) -> None:
        self.up, self.down = np.full(size, STEP, np.uint64), np.full(size + 1, BACK, np.uint64)
        self.down[0] = 1
        np.multiply.accumulate(self.up, out=self.up)
        np.multiply.accumulate(self.down, out=self.down)

    def words(self, data: bytes):
        """(starts, ends, hashes) of the words of lower-cased bytes."""
        raw = np.frombuffer(data, np.uint8)
        if len(raw) > len(self.up):
            self.grow(len(raw))
        on = np.zeros(len(raw) + 2, np.int8)
        on[1:-1] = self.is_word[raw]
        turn = np.flatnonzero(on[1:] != on[:-1])
        starts, ends = turn[::2], turn[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.letters[raw] * self.up[: len(raw)], out=sums[1:])
        return starts, ends, _mixed((sums[ends] - sums[starts]) * self.down[starts])


def grams(words: np.ndarray, k: int, owner: np.ndarray | None = None) -> np.ndarray:
    """Hash of each k consecutive words; ``NONE`` where they have more than one owner."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, power = np.zeros(n, np.uint64), 1
    for i in range(k):
        power = power * 0xD6E8FEB86659FD93 % 2**64
        out += words[i : i + n] * np.uint64(power)
    out = np.minimum(_mixed(out), NONE - np.uint64(1))
    if owner is not None:
        out[owner[:n] != owner[k - 1 :]] = NONE
    return out


def kept(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the least of some ``width`` consecutive ones (all of a tie)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.flatnonzero(hashes != NONE)
    low = hashes[:n].copy()
    for i in range(1, width):
        np.minimum(low, hashes[i : i + n], out=low)
    on = np.zeros(len(hashes), bool)
    for i in range(width):
        on[i : i + n] |= hashes[i : i + n] == low
    return np.flatnonzero(on & (hashes != NONE))


def gram_at(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The hashes of ``grams`` at some places."""
    out, power = np.zeros(len(at), np.uint64), 1
    for i in range(k):
        power = power * 0xD6E8FEB86659FD93 % 2**64
        out += words[at + i] * np.uint64(power)
    return np.minimum(_mixed(out), NONE - np.uint64(1))


class Index:
    """Fingerprints and windows of a block of benchmark items: list of (item id as a string, text)."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW, k: int = K, chunk: int = CHUNK):
        self.window, self.k, self.chunk = window, k, chunk
        self.hasher = Hasher(chunk)
        self.ids, self.texts_of = [], []
        short = defaultdict(lambda: defaultdict(set))
        keys, windows, owners, firsts = ([np.zeros(0, t)] for t in (np.uint64, np.uint64, np.int64, np.int64))
        for item, text in items:
            data = (text or "").encode().lower()
            starts, ends, h = self.hasher.words(data)
            if not len(h):
                continue
            if len(h) < window:
                short[len(h)][int(grams(h, len(h))[0])].add(item)
                continue
            g = grams(h, k)
            keys.append(np.unique(g[kept(g, window - k + 1)]))
            own, first = np.unique(grams(h, window), return_index=True)
            windows.append(own)
            owners.append(np.full(len(own), len(self.ids)))
            firsts.append(first)
            self.ids.append(item)
            self.texts_of.append((data, starts.astype(np.int32), ends.astype(np.int32)))
        self.keys = np.unique(np.concatenate(keys))
        windows, owners, firsts = (np.concatenate(x) for x in (windows, owners, firsts))
        order = np.argsort(windows, kind="stable")
        self.windows, self.bounds = np.unique(windows[order], return_index=True)
        self.bounds = np.r_[self.bounds, len(order)]
        self.owners, self.firsts = owners[order], firsts[order]  # of each window, from one bound to the next
        self.short = {n: (np.array(sorted(d), np.uint64), [sorted(d[x]) for x in sorted(d)]) for n, d in sorted(short.items())}

    @staticmethod
    def found(keys: np.ndarray, hashes: np.ndarray):
        """Places in ``hashes`` whose value is in the sorted ``keys``, and where in them."""
        if not len(keys) or not len(hashes):
            return np.zeros(0, int), np.zeros(0, int)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        hit = np.flatnonzero(keys[at] == hashes)
        return hit, at[hit]

    def scan(self, data: bytes, bounds: np.ndarray):
        """Words, hits and items of the texts that lie at ``bounds`` in lower-cased ``data``.

        Returns (starts, owner of each word, hit of each word, items by owner).
        """
        starts, ends, h = self.hasher.words(data)
        owner = np.searchsorted(bounds, starts, "right") - 1
        hit, items = np.zeros(len(h), bool), defaultdict(set)
        for n, (keys, ids) in self.short.items():
            where, which = self.found(keys, grams(h, n, owner))
            for i in range(n):
                hit[where + i] = True
            for o, w in np.unique(np.stack([owner[where], which], axis=1), axis=0):
                items[int(o)].update(ids[w])
        if len(self.keys):
            all_grams = grams(h, self.k, owner)
            at = kept(all_grams, self.window - self.k + 1)
            where, _ = self.found(self.keys, all_grams[at])
            at, which = self.extended(data, starts, ends, h, owner, at[where])
            for i in range(self.window):
                hit[at + i] = True
            for o, w in np.unique(np.stack([owner[at], which], axis=1), axis=0):
                items[int(o)].update(self.ids[x] for x in self.owners[self.bounds[w] : self.bounds[w + 1]])
        return starts, owner, hit, items

    def extended(self, data, starts, ends, h, owner, seeds):
        """(starts of the windows around the k-grams at ``seeds`` that items have too, numbers of these windows)."""
        at = np.unique((seeds[:, None] - np.arange(self.window - self.k + 1)).ravel())
        at = at[(at >= 0) & (at + self.window <= len(h))]
        at = at[owner[at] == owner[at + self.window - 1]]
        where, which = self.found(self.windows, gram_at(h, at, self.window))
        at, words, same = at[where], {}, np.ones(len(where), bool)
        for i, (a, w) in enumerate(zip(at.tolist(), which.tolist(), strict=True)):
            if w not in words:
                raw, lo, hi = self.texts_of[self.owners[self.bounds[w]]]
                first = self.firsts[self.bounds[w]]
                words[w] = [raw[x:y] for x, y in zip(lo[first : first + self.window].tolist(), hi[first : first + self.window].tolist(), strict=True)]
            same[i] = words[w] == [data[x:y] for x, y in zip(starts[a : a + self.window].tolist(), ends[a : a + self.window].tolist(), strict=True)]
        return at[same], which[same]

    def texts(self, texts):
        """For each of some texts (or null) number of words, hit of each word, items; they are taken in chunks."""
        part, size = [], 0
        for text in texts:
            raw = (text or "").encode().lower()
            if part and size + len(raw) >= self.chunk:
                yield from self._chunk(part)
                part, size = [], 0
            if len(raw) > self.chunk:
                yield self.long_text(raw)
            else:
                part.append(raw)
                size += len(raw) + 1
        if part:
            yield from self._chunk(part)

    def _chunk(self, raw: list[bytes]):
        bounds = np.cumsum([0, *(len(x) + 1 for x in raw)])[:-1]
        _, owner, hit, items = self.scan(b"\0".join(raw), bounds)
        ends = np.searchsorted(owner, np.arange(len(raw) + 1))
        for i in range(len(raw)):
            yield int(ends[i + 1] - ends[i]), hit[ends[i] : ends[i + 1]], items.get(i, set())

    def long_text(self, data: bytes):
        """The same in pieces that share ``window`` words, so that no window is cut."""
        lo, base, size, items = 0, 0, self.chunk, set()
        marks = np.zeros(len(data) // 2 + 2, bool)  # by word
        while True:
            hi = min(len(data), lo + size)
            while hi < len(data) and self.hasher.is_word[data[hi - 1]] and self.hasher.is_word[data[hi]]:
                hi += 1  # to the end of the word
            starts, _, hit, more = self.scan(data[lo:hi], np.zeros(1, int))
            if len(hit) <= self.window and hi < len(data):
                size *= 2  # few and very long words
                continue
            items |= more.get(0, set())
            marks[base : base + len(hit)] |= hit
            if hi == len(data):
                return base + len(hit), marks[: base + len(hit)], items
            base, lo, size = base + len(hit) - self.window, lo + int(starts[-self.window]), self.chunk


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    turn = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    return list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))


SPANS = "array<struct<lo:bigint,hi:bigint>>"


def _index(sent) -> Index:
    """The index of a block; the worker keeps what was sent, and so the index, from task to task."""
    held = sent.value
    if "index" not in held:
        held["index"] = Index(held["items"])
    return held["index"]


def _scan(docs: DataFrame, sent) -> DataFrame:
    """(docs' columns but the last, its text, n_words, spans of hit words, items) under one block of the benchmark."""

    def run(batches):
        index = _index(sent)
        for batch in batches:
            found = [(n, _spans(hit), sorted(items)) for n, hit, items in index.texts(texts_of(batch.column(batch.num_columns - 1)))]
            cols = [
                *batch.columns[:-1],
                pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([[{"lo": a, "hi": b} for a, b in s] for _, s, _ in found], pa.list_(pa.struct({"lo": pa.int64(), "hi": pa.int64()}))),
                pa.array([x for _, _, x in found], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], "n_words", "spans", "items"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(run, f"{kinds}, n_words bigint, spans {SPANS}, items array<string>")


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark's (item_id, text) in blocks of at most ``block_bytes``, or of one row."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size, n = F.sum(F.octet_length("text")), 1
    while True:
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")
        most = items.groupBy(block.alias("block")).agg(size.alias("size"), F.countDistinct("item_id", "text").alias("rows")).where("rows > 1").agg(F.max("size")).first()[0] or 0
        if most <= block_bytes:
            return [items.where(block == i) if n > 1 else items for i in range(n)]
        n *= max(2, -(-most // block_bytes))


def _send(docs: DataFrame, block: DataFrame):
    return docs.sparkSession.sparkContext.broadcast({"items": [tuple(r) for r in block.distinct().collect()]})


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items) of every row of ``docs`` (doc_id, text).

    spans: the half-open ranges of hit words; items: the ids (as strings,
    sorted) of items with a window in the text.  Null and empty texts have no
    words.  Items without words or id have no windows; repeated items count
    once by id.  Repeated documents give repeated rows; empty tables work.
    Columns other than doc_id, text, item_id are not read.
    """
    blocks = _blocks(benchmark, block_bytes)
    n = len(blocks)
    if n == 1:
        return _scan(docs.select("doc_id", "text"), _send(docs, blocks[0]))
    # More than one block: hits are merged by a key of the document.
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n"), "text")
    parts = None
    for block in blocks:
        sent = _send(docs, block)
        part = cut(_scan(keyed, sent))
        sent.destroy()  # the next block takes its place
        parts = part if parts is None else parts.union(part)
    per = parts.groupBy("doc_id", "h", "n").agg(F.count(F.lit(1)).alias("rows"), F.first("n_words").alias("n_words"))
    hits = parts.where("size(items) > 0").groupBy("doc_id", "h", "n").agg(
        F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )
    merged = F.expr(
        "aggregate(array_sort(spans), cast(array() as " + SPANS + "), (a, s) -> if(size(a) > 0 and element_at(a, -1).hi >= s.lo,"
        " concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).lo as lo, greatest(element_at(a, -1).hi, s.hi) as hi))), concat(a, array(s))))"
    )
    same = per.doc_id.eqNullSafe(hits.doc_id) & per.h.eqNullSafe(hits.h) & per.n.eqNullSafe(hits.n)
    out = per.join(hits, same, "left").select(per.doc_id, "n_words", F.coalesce(merged, F.expr(f"cast(array() as {SPANS})")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"), (F.col("rows") / n).cast("int").alias("rows"))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), "rows"))).drop("__copy", "rows")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) whose text has no window of any item; columns as they are.

    Every row is judged by its own text, also where rows share an id or have none.  With one block of the benchmark rows are
    filtered where they lie, without a shuffle, and only their texts go to Python.
    """
    blocks = _blocks(benchmark, block_bytes)
    if len(blocks) > 1:
        key = F.struct("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("n"))
        found = contamination(docs.select(key.alias("doc_id"), "text"), benchmark, block_bytes).where("size(spans) > 0").select("doc_id.*").distinct()
        rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__h"), F.length("text").alias("__n"))
        same = rows["__id"].eqNullSafe(found["doc_id"]) & (rows["__h"] == found["h"]) & (rows["__n"] == found["n"])
        return rows.join(found, same, "left_anti").select("__row.*")
    sent = _send(docs, blocks[0])

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = _index(sent)
        for part in texts:
            yield pa.array([not hit.any() for _, hit, _ in index.texts(texts_of(part))], pa.bool_())

    return docs.where(clean("text"))


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
