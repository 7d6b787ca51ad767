"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole.  The byte length of every token gives
its span, running sums turn bytes into code points, and the spans are joined to
the sections of the document as intervals, with two binary searches per section
over the sorted token starts and ends.  Sections may nest, overlap or leave
gaps.  A token that crosses a section's bound is allocated by a rule:

``start``  to the sections that hold its first code point (default)
``major``  to the sections that hold its middle code point
``share``  to every section it touches, by the share of its code points there

Tokens that belong to no code point of their own (a character cut into several
tokens) have the span of that character.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A public byte-level vocabulary; any file of ranks in this format will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's tokenizer cuts text before merging.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "major", "share")
#: Characters encoded at a time.  A longer text is cut before white space that follows something else: every alternative of
#: ``SPLIT`` that begins earlier ends there, so the pieces have the tokens of the whole.
PIECE = 1 << 20


class Encoder:
    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("corpus", pat_str=SPLIT, mergeable_ranks=table, special_tokens={})
        self.lengths = np.zeros(max(table.values()) + 1, np.int64)
        for token, rank in table.items():
            self.lengths[rank] = len(token)

    def byte_ends(self, text: str) -> np.ndarray:
        """End of each token of a whole text, in bytes."""
        pieces, lo = [], 0
        while lo < len(text):
            hi = lo + PIECE
            while hi < len(text) and (text[hi] not in " \n" or text[hi - 1].isspace()):
                hi += 1
            pieces.append(np.array(self.encoding.encode_ordinary(text[lo:hi]), np.int64))
            lo = hi
        return np.cumsum(self.lengths[np.concatenate(pieces)]) if pieces else np.zeros(0, np.int64)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the tokens in code points."""
        ends = self.byte_ends(text)
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) == len(text):
            return np.r_[0, ends][:-1], ends
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        starts = np.r_[0, ends][:-1]
        return char[starts], char[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str = "start"):
    """(tokens, tokens that cross a bound) of each section [lo, hi)."""
    at = starts if rule != "major" else (starts + ends - 1) // 2
    whole = np.searchsorted(at, hi) - np.searchsorted(at, lo)
    # Tokens overlapping each bound: started before it and ended after it.  One that overlaps both counts once.
    before_lo, past_lo = np.searchsorted(starts, lo), np.searchsorted(ends, lo, "right")
    before_hi, past_hi = np.searchsorted(starts, hi), np.searchsorted(ends, hi, "right")
    both = np.maximum(before_lo - past_hi, 0)
    first, last = past_lo, before_hi
    empty = hi <= lo
    crossing = np.where(empty, 0, (before_lo - past_lo) + (before_hi - past_hi) - both)
    if rule != "share":
        return np.where(empty, 0, whole).astype(float), crossing
    size = np.maximum(ends - starts, 1)
    out = np.zeros(len(lo))
    for i, (a, b) in enumerate(zip(first, last, strict=True)):
        if b > a and not empty[i]:
            part = np.minimum(ends[a:b], hi[i]) - np.maximum(starts[a:b], lo[i])
            out[i] = (np.maximum(part, 0) / size[a:b]).sum()
    return out, crossing


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sections of a text by line, each with its line end, so that they cover the text."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), np.uint32) == 10) + 1
    ends = ends if len(ends) and ends[-1] == len(text) else np.r_[ends, len(text)]
    return np.r_[0, ends][:-1], ends


_FIELDS = [("section", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("n_tokens", pa.float64()), ("n_crossing", pa.int64())]
_LIST = pa.list_(pa.struct(dict(_FIELDS)))
#: Rows given to Arrow at a time.
ROWS = 512


def vocabulary(spark: SparkSession, path: str) -> bytes:
    """The file of ranks, read on the driver: its size is that of a vocabulary, not of data."""
    with open(path, "rb") as f:
        return f.read()


def section_tokens(docs: DataFrame, path: str = VOCABULARY, rule: str = "start", sections: str | None = None) -> DataFrame:
    """One row per document of (doc_id, text): doc_id, doc_tokens and an array of sections with their tokens.

    ``sections``: a column of array<struct<lo,hi>> in code points, by default
    the lines.  Null and empty texts have no tokens and no sections of their
    own; null bounds and bounds outside the text are cut to it.  Repeated rows
    give repeated results; other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary(spark, path))

    def run(batches):
        encoder = Encoder(sent.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                given = batch.column(2).to_pylist() if sections else None
                totals, found = [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    text = text or ""
                    starts, ends = encoder.spans(text)
                    if given is None:
                        a, b = line_sections(text)
                    else:
                        own = given[i] or []
                        a, b = (np.clip(np.array([d if s[k] is None else s[k] for s in own], np.int64), 0, len(text)) for k, d in (("lo", 0), ("hi", len(text))))
                    n, crossing = attribute(starts, ends, a, b, rule)
                    totals.append(len(starts))
                    found.append([dict(zip((k for k, _ in _FIELDS), x, strict=True)) for x in zip(range(len(a)), a.tolist(), b.tolist(), n.tolist(), crossing.tolist(), strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(found, _LIST)], names=["doc_id", "doc_tokens", "sections"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    cols = ["doc_id", "text", *([sections] if sections else [])]
    return docs.select(*cols).mapInArrow(run, f"doc_id {kind}, doc_tokens bigint, sections array<struct<section:bigint,lo:bigint,hi:bigint,n_tokens:double,n_crossing:bigint>>")


def by_section(docs: DataFrame, path: str = VOCABULARY, rule: str = "start") -> DataFrame:
    """One row per section (line) of every document; a document without sections has one row with nulls."""
    made = section_tokens(docs, path, rule)
    return made.select("doc_id", "doc_tokens", F.explode_outer("sections").alias("s")).select("doc_id", "doc_tokens", "s.*")
