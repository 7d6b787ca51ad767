"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared inside buckets of fingerprints that agree on all but
``radius`` of eight bytes: two fingerprints with ``radius`` or fewer differing
bits always share such a bucket, and for radius 2 a bucket has 16 free bits, so
it never holds more than 65,536 different fingerprints however many copies or
near copies the corpus has.  Inside a bucket the bits are stored as vertical
planes (one long integer per bit position, one bit per member); the distances
from one member to all others are counted at once with carry-save adders, and
a block of members is abandoned as soon as all of it exceeds the radius.
Only a spanning set of the links is emitted: each member is linked to the one
that reached it first, which loses no connection.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, texts_of
from .graph import components

BITS = 64
BLOCKS = 8
RADIUS = 2
SHINGLE = 3
SEED = 42
#: Shingles hashed at a time, so that memory does not follow the length of a text.
PIECE = 65536
#: Members of a bucket that are compared in one pass of long integers.
BLOCK = 8192
#: Keys of rows that are sent to every executor at most, about 40 bytes each.
SENT = 200_000


def fingerprint(text: str | None, n: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit fingerprint: a bit is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < n:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for lo in range(0, len(words) - n + 1, PIECE):
        part = words[lo : lo + PIECE + n - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(n)), strict=False))
        h = np.array([digest(x, seed) for x in grams], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.int32)
    on = total * 2 > len(words) - n + 1
    return int(np.packbits(on, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE) -> DataFrame:
    """(doc_id, fp BIGINT) for every row; null and empty texts have fingerprint 0."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, n) for t in texts_of(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, fp bigint")


def masks(radius: int, blocks: int = BLOCKS) -> list[int]:
    """Masks that keep all but ``radius`` of the blocks, as signed 64-bit numbers."""
    width, out = BITS // blocks, []
    for free in combinations(range(blocks), radius):
        m = 2**BITS - 1 - sum((2**width - 1) << (width * b) for b in free)
        out.append(m - 2**BITS if m >= 2 ** (BITS - 1) else m)
    return out


def bucket_links(values: list[int], radius: int, block: int = BLOCK):
    """Spanning links (i, j) of the members of one bucket within ``radius`` bits of each other."""
    n, varying = len(values), 0
    for x in values:
        varying |= x ^ values[0]
    places = [b for b in range(BITS) if varying >> b & 1]
    spans = [(lo, min(n, lo + block)) for lo in range(0, n, block)]
    planes = [[int("".join("1" if x >> b & 1 else "0" for x in reversed(values[lo:hi])), 2) for b in places] for lo, hi in spans]
    left = [(1 << (hi - lo)) - 1 for lo, hi in spans]  # members that nothing has reached yet
    width = (radius + 1).bit_length()

    def near(x: int, k: int) -> int:
        """Bit vector of the members of block k within the radius of x."""
        alive, count = left[k], [0] * width
        for b, plane in zip(places, planes[k], strict=True):
            carry = (~plane if x >> b & 1 else plane) & alive
            for level in range(width):
                count[level], carry = count[level] ^ carry, count[level] & carry
            over = alive
            for level in range(width):
                over &= count[level] if (radius + 1) >> level & 1 else ~count[level]
            alive &= ~over
            if not alive:
                break
        return alive

    for first in range(n):
        k, i = divmod(first, block)
        if not left[k] >> i & 1:
            continue
        left[k] &= ~(1 << i)
        stack = [first]
        while stack:
            at = stack.pop()
            for k, (lo, _) in enumerate(spans):
                if left[k]:
                    found = near(values[at], k)
                    left[k] &= ~found
                    while found:
                        low = found & -found
                        found ^= low
                        j = lo + low.bit_length() - 1
                        yield at, j
                        stack.append(j)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that connect all fingerprints of column ``fp`` within ``radius`` bits; no value may repeat."""
    keep = masks(radius)
    key = F.element_at(F.array(*map(F.lit, keep)), F.col("tag") + 1).bitwiseAND(F.col("fp"))
    rows = distinct.select(F.explode(F.array(*[F.lit(i) for i in range(len(keep))])).alias("tag"), "fp")
    rows = rows.select("tag", "fp", key.alias("key")).repartition("tag", "key").sortWithinPartitions("tag", "key")

    def run(batches):
        def emit(tag, key, fp):
            edge = np.flatnonzero((tag[1:] != tag[:-1]) | (key[1:] != key[:-1])) + 1
            lo, hi = np.r_[0, edge], np.r_[edge, len(fp)]
            for k in np.flatnonzero(hi - lo > 1):
                values = fp[lo[k] : hi[k]].tolist()
                values_u = [v & (2**BITS - 1) for v in values]
                for i, j in bucket_links(values_u, radius):
                    yield values[i], values[j]

        rest = [np.zeros(0, t) for t in (np.int32, np.int64, np.int64)]

        def out(pairs):
            pairs = list(pairs)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            tag, fp, key = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            have = [np.concatenate(x) for x in zip(rest, (tag, key, fp), strict=True)]
            if not len(have[0]):
                continue
            same = (have[0] == have[0][-1]) & (have[1] == have[1][-1])
            last = int(np.argmax(same))  # the last bucket may go on in the next batch
            rest = [x[last:] for x in have]
            if last:
                yield out(emit(*(x[:last] for x in have)))
        if len(rest[0]):
            yield out(emit(*rest))

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, n: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the least doc_id that links lead to, itself included).

    Null and empty texts share fingerprint 0 and link like any other.  Repeated
    rows give repeated results; a null doc_id never names a component unless all
    ids of it are null.  An empty table gives no rows.  Extra columns are not read.
    """
    fps = cut(fingerprints(docs, doc_id, text, n))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(classes.select("fp"), radius))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, sent: int = SENT) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) without all but one row of each near-duplicate group.

    A row with the least doc_id of the group stays (null: only where all are
    null); of several such rows one with the least hash of its text, and of rows
    that repeat id and text one.  Rows of one id, or without id, that are in
    different groups are judged each in its own.  Columns are those of ``docs``.

    What goes, or stays once of several, is known by id, hash and length.  Up to
    ``sent`` such keys (counted) are sent to every executor, so that rows with
    texts stay where they lie; more are joined.  Only rows that repeat id and text
    are gathered by key.
    """
    h, size = F.xxhash64("text"), F.length("text")
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), h.alias("h"), size.alias("n"))
    found = near_duplicates(docs.select(key.alias("key"), "text"), doc_id="key").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("first")
    )
    found = cut(found.where("n > 1 or not first").select(F.col("doc_id.id").alias("__gi"), F.col("doc_id.h").alias("__gh"), F.col("doc_id.n").alias("__gn"), F.col("first").alias("__once")))
    small = found.limit(sent + 1).count() <= sent
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__id"), h.alias("__h"), size.alias("__n"))

    def without(keys: DataFrame, how: str) -> DataFrame:
        same = rows["__id"].eqNullSafe(keys["__gi"]) & (rows["__h"] == keys["__gh"]) & rows["__n"].eqNullSafe(keys["__gn"])
        return rows.join(F.broadcast(keys) if small else keys, same, how)

    once = found.where("__once")
    kept = without(found, "left_anti").select("__row.*")
    if once.isEmpty():
        return kept
    return kept.union(without(once, "left_semi").dropDuplicates(["__id", "__h", "__n"]).select("__row.*"))
