"""WARC derivatives: metadata and plain-text conversion records linked to their responses.

``parsed`` reads WARC bytes (plain or gzip members), ``derive`` makes of every
response one metadata record (JSON: URI, status, HTTP headers, title, links) and,
if its payload is text, one conversion record (text/plain).  Both refer to the
response by WARC-Refers-To, keep its target URI, date and payload digest, and
carry a block digest of their own.  Payloads that were sent in chunks or
compressed (gzip, deflate, zstd) are read as the text that they hold; of others
the metadata say so.  Ids of derivatives are name-based, so a rerun, or a task
that runs twice, makes the same records.  Everything is one narrow pass: no
shuffle, one record in memory at a time.

Damaged input ends no job: a record with a bad header, a gzip member that can't
be read and a cut-off end are given with a status, and reading goes on at the
next record or member.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import uuid
import zlib
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = b"WARC/1.0"
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc-derivatives")
_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<(/?[a-zA-Z][^\s/>]*)(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time tt u var wbr".split())
_TITLE = re.compile(r"<title[^<>]*>(.*?)(?:</title|\Z)", re.S | re.I)
#: In an a tag alone.
_HREF = re.compile(r"(?<![\w-])href\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s\"'>]+))", re.I)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def dump(headers: dict[str, str], block: bytes) -> bytes:
    """One record as bytes; Content-Length and the block digest are added."""
    own = {**headers, "WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in own.items() if v is not None)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


_MAGIC = b"\x1f\x8b\x08"
#: Bytes of a header at most; what is longer is none.
HEADER = 1 << 20


def _inflated(stream):
    """Blocks of bytes of a stream that may be a row of gzip members; None where a member can't be read on."""
    raw = stream.read(3)
    if raw != _MAGIC:
        yield raw
        while block := stream.read(1 << 20):
            yield block
        return
    unzip, fresh = zlib.decompressobj(31), True
    while True:
        try:
            out, damaged = unzip.decompress(raw), False
        except zlib.error:
            out, damaged = b"", True
        if out:
            yield out
        if damaged:
            yield None
            at = raw.find(_MAGIC, 1 if fresh else 0)  # the next member, if it begins in what is left of this block
            while at < 0:
                block = stream.read(1 << 20)
                if not block:
                    return
                raw = raw[-2:] + block
                at = raw.find(_MAGIC)
            raw, unzip, fresh = raw[at:], zlib.decompressobj(31), True
            continue
        fresh = unzip.eof
        raw = unzip.unused_data
        if unzip.eof:
            unzip = zlib.decompressobj(31)
            raw = raw.lstrip(b"\0")  # padding
        if not raw:
            raw = stream.read(1 << 20)
            if not raw:
                if not fresh:
                    yield None
                return


def parsed(data: bytes | io.BufferedIOBase):
    """(headers, block, status) of every record; header names in lower case.

    Statuses: ``ok``; ``bad header`` (no WARC version, no or no valid length: the
    block is empty, and reading goes on at the next version line); ``damaged`` (a
    gzip member can't be read: what it held of a record); ``cut off`` (the input ends in the record).
    """
    source = _inflated(io.BytesIO(data) if isinstance(data, bytes) else data)
    buffer, broken, ended = bytearray(), False, False

    def more() -> bool:
        nonlocal broken, ended
        block = next(source, b"")
        broken, ended = block is None, block == b""
        if block:
            buffer.extend(block)
        return not (broken or ended)

    while True:
        size = len(buffer) - len(buffer.lstrip(b"\r\n"))
        del buffer[:size]
        end, from_ = -1, 0
        while (end := buffer.find(b"\r\n\r\n", from_)) < 0 and len(buffer) <= HEADER:
            from_ = max(0, len(buffer) - 3)
            if not more():
                break
        if end < 0 and not (broken or ended):
            end = 0  # no header within its bound
        if end < 0:
            if buffer.strip(b"\r\n") or broken:
                yield {}, b"", "damaged" if broken else "cut off"
            buffer.clear()
            if ended:
                return
            broken = False
            continue
        lines = re.sub(r"\r\n[ \t]+", " ", bytes(buffer[:end]).decode("utf-8", "replace")).split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = headers.get("content-length", "")
        if not lines[0].startswith("WARC/") or not re.fullmatch("[0-9]{1,15}", length):
            yield headers if lines[0].startswith("WARC/") else {}, b"", "bad header"
            del buffer[: max(end, 1)]
            while (at := buffer.find(b"\r\nWARC/")) < 0:
                del buffer[: max(0, len(buffer) - 6)]
                if not more():
                    break
            if at >= 0:
                del buffer[: at + 2]
            elif not broken:
                return
            else:
                buffer.clear()
                broken = False
            continue
        need = end + 4 + int(length)
        while len(buffer) < need and more():
            pass
        if len(buffer) < need:
            yield headers, bytes(buffer[end + 4 :]), "damaged" if broken else "cut off"
            buffer.clear()
            if ended:
                return
            broken = False
            continue
        block = bytes(buffer[end + 4 : need])
        del buffer[:need]
        yield headers, block, "ok"


def records(data: bytes | io.BufferedIOBase):
    """(headers, block) of every whole record."""
    for headers, block, status in parsed(data):
        if status == "ok":
            yield headers, block


def _text(html: str) -> str:
    html = _RAW.sub(" ", html)
    html = _TAG.sub(lambda m: "" if (m.group(1) or "b").lower().lstrip("/") in _INLINE else "\n", html)
    return "\n".join(x for x in (" ".join(unescape(line).split()) for line in html.split("\n")) if x)


def http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status, headers, payload) of a response's block."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    if not gap or not lines[0].startswith("HTTP/"):
        return "", [], block
    return (lines[0].split(" ", 2) + [""])[1], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], payload


_CHUNK = re.compile(rb"([0-9A-Fa-f]{1,8})[^\r\n]{0,200}\r\n")


def _unchunked(data: bytes) -> bytes:
    """A payload sent in chunks as a whole; what doesn't look like chunks stays."""
    out, at = [], 0
    while m := _CHUNK.match(data, at):
        size = int(m.group(1), 16)
        if not size:
            return b"".join(out)
        out.append(data[m.end() : m.end() + size])
        at = m.end() + size + 2
    return b"".join(out) if out and at >= len(data) else data


def _unpacked(data: bytes, encodings: str) -> tuple[bytes, str]:
    """(payload without its content encodings, what can't be undone or '')."""
    for name in reversed([e.strip().lower() for e in encodings.split(",") if e.strip()]):
        try:
            if name in ("gzip", "x-gzip"):
                data = zlib.decompressobj(31).decompress(data) if data else data
            elif name == "deflate":
                try:
                    data = zlib.decompressobj().decompress(data)
                except zlib.error:
                    data = zlib.decompressobj(-15).decompress(data)
            elif name == "zstd":
                import zstandard

                data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
            elif name != "identity":
                return data, name
        except Exception as e:  # the libraries have errors of their own
            return data, f"{name}: {type(e).__name__}"
    return data, ""


_TEXTS = re.compile(r"text/|application/(?:xhtml\+xml|xml|json|javascript|[\w.-]+\+(?:xml|json))", re.I)


def derive(headers: dict[str, str], block: bytes):
    """[metadata record, conversion record] of a response, each (headers, block); no conversion record if its payload is no text."""
    status, fields, raw = http(block)

    def field(name: str) -> str:
        return ", ".join(v for k, v in fields if k.lower() == name)

    payload, packed = _unpacked(_unchunked(raw) if "chunked" in field("transfer-encoding").lower() else raw, field("content-encoding"))
    kind = field("content-type")
    is_text = not packed and (bool(_TEXTS.match(kind)) if kind else b"\0" not in payload[:4096])
    found = _CHARSET.search(kind.encode("latin-1", "replace")) or _CHARSET.search(payload[:1024])
    html = ""
    if is_text:
        try:
            html = payload.decode(found.group(1).decode() if found else "utf-8", "replace")
        except LookupError:
            html = payload.decode("utf-8", "replace")
    uri, source = headers.get("warc-target-uri", ""), headers.get("warc-record-id", "")
    payload_digest = headers.get("warc-payload-digest") or digest(raw)
    title = _TITLE.search(html)
    links = []
    for tag in _TAG.finditer(_RAW.sub(" ", html)):
        m = _HREF.search(tag.group()) if (tag.group(1) or "").lower() == "a" else None
        if m is None:
            continue
        to = unescape(m.group(1) or m.group(2) or m.group(3) or "")
        try:
            links.append(urljoin(uri, to))
        except ValueError:
            links.append(to)
    meta = {"uri": uri, "status": status, "headers": fields, "title": " ".join(unescape(title.group(1)).split()) if title else "", "links": links}
    if packed:
        meta["undecoded"] = packed
    meta_block = json.dumps(meta, ensure_ascii=False).encode("utf-8", "replace")
    text = (html if kind.lower().startswith("text/plain") else _text(html)).encode("utf-8", "replace")
    shared = {"WARC-Date": headers.get("warc-date"), "WARC-Target-URI": uri, "WARC-Refers-To": source, "WARC-Payload-Digest": payload_digest}
    out = []
    for what, body, content in (("metadata", meta_block, "application/json"), ("conversion", text, "text/plain"))[: 1 + is_text]:
        own = {"WARC-Type": what, "WARC-Record-ID": record_id(what, source, payload_digest), **shared, "Content-Type": content}
        out.append((own, body))
    return out


FIELDS = "url string, response_id string, metadata_id string, conversion_id string, metadata_refers_to string, conversion_refers_to string, payload_digest string, metadata_digest string, conversion_digest string, n_links bigint, title string, text string, n_chars bigint"


def response(page_id, url: str | None, html: str | None) -> bytes:
    """A stored page as a response record; null html is an empty payload."""
    payload = (html or "").encode()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    uri = re.sub(r"[\r\n]+", " ", url or "")
    own = {"WARC-Type": "response", "WARC-Record-ID": record_id("response", str(page_id), uri, digest(payload)), "WARC-Date": DATE, "WARC-Target-URI": uri, "WARC-Payload-Digest": digest(payload), "Content-Type": "application/http; msgtype=response"}
    return dump(own, block)


def write_records(pages: DataFrame) -> DataFrame:
    """(page_id, url, warc) of every row of ``pages`` (page_id, url, html): the three records as bytes, response first.

    Written out in order of page_id they make a valid WARC file.  Null urls and
    html are empty, repeated rows make equal records with equal ids, an empty
    table gives no rows; other columns are not read.
    """

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                b = whole.slice(lo, 64)
                out = []
                for p, u, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    raw = response(p, u, h)
                    for head, block in records(raw):
                        raw += b"".join(dump(*x) for x in derive(head, block))
                    out.append(raw)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["page_id", "url", "warc"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, warc binary")


def derive_files(files: DataFrame) -> DataFrame:
    """(path, record, status, warc) of WARC files read as ``binaryFile`` (path, content), a row per response and per record that can't be read.

    record: number of the record in its file, from 0; warc: the derivative records
    of a whole response, else null (see ``parsed`` for the status).  Null and empty
    files give no rows, repeated files repeat, other columns are not read.
    """

    def run(batches):
        kinds = (pa.int64(), pa.string(), pa.binary())
        for whole in batches:
            for i in range(whole.num_rows):
                row = whole.slice(i, 1)
                for n, (head, block, status) in enumerate(parsed(row.column(1)[0].as_py() or b"")):
                    if status == "ok" and head.get("warc-type") != "response":
                        continue
                    made = b"".join(dump(*x) for x in derive(head, block)) if status == "ok" else None
                    cols = [pa.array([v], k) for v, k in zip((n, status, made), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([row.column(0), *cols], names=["path", "record", "status", "warc"])

    return files.select("path", "content").mapInArrow(run, "path string, record bigint, status string, warc binary")


def write_files(written: DataFrame, folder: str) -> DataFrame:
    """(path, rows, bytes) of the compressed WARC files made of column ``warc``, one per partition with rows, a gzip member per row.

    ``folder`` is a URI of a store that all executors share.  A file gets its name,
    that of its partition, when it is whole, so a task that is lost or runs twice leaves one file.
    Rows without records are left out.
    """

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, at = fs.FileSystem.from_uri(folder)
        path, rows, size = f"{at}/part-{task.partitionId():06d}.warc.gz", 0, 0
        draft, out = f"{at}/.part-{task.partitionId():06d}-{task.taskAttemptId()}", None
        for batch in batches:
            for record in batch.column(0):
                if not record.is_valid:
                    continue
                if out is None:
                    store.create_dir(at, recursive=True)
                    out = store.open_output_stream(draft, compression=None)
                member = gzip.compress(record.as_py(), mtime=0)
                out.write(member)
                rows, size = rows + 1, size + len(member)
        if out is not None:
            out.close()
            store.move(draft, path)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([rows], pa.int64()), pa.array([size], pa.int64())], names=["path", "rows", "bytes"])

    return written.select("warc").mapInArrow(run, "path string, rows bigint, bytes bigint")


def report(written: DataFrame) -> DataFrame:
    """Reads the records of ``write_records`` back: page_id and FIELDS, one row per page, with what the headers say.

    A page without conversion record has nulls for it and an empty text.
    """
    names = ["page_id", *(f.split()[0] for f in FIELDS.split(", "))]
    kinds = [pa.int64() if f.endswith("bigint") else pa.string() for f in FIELDS.split(", ")]

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                part, rows = whole.slice(lo, 64), []
                for url, raw in zip(*(part.column(k).to_pylist() for k in ("url", "warc")), strict=True):
                    (h, _), (m, meta), *rest = records(raw)
                    c, text = rest[0] if rest else ({}, b"")
                    info, body = json.loads(meta), text.decode()
                    rows.append((url, h["warc-record-id"], m["warc-record-id"], c.get("warc-record-id"), m["warc-refers-to"], c.get("warc-refers-to"),
                                 m["warc-payload-digest"], m["warc-block-digest"], c.get("warc-block-digest"), len(info["links"]), info["title"], body, len(body)))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), *(pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds))], names=names)

    kind = written.schema["page_id"].dataType.simpleString()
    return written.select("page_id", "url", "warc").mapInArrow(run, f"page_id {kind}, {FIELDS}")
