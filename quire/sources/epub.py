"""E-book packages as tables: unpack, spine, navigation, metadata, repack.

A package is one row of Spark's ``binaryFile`` source; its entries become rows,
so documents of many books are processed together.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPF = "{http://www.idpf.org/2007/opf}"
DC = "{http://purl.org/dc/elements/1.1/}"
CONTAINER = "META-INF/container.xml"
ENTRY = "book_id string, name string, content binary"


class UnsafeEntry(ValueError):
    """An entry's path leads out of its package."""


def read(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, path, content): one row per package; the id is the file's stem and 8 digits of its content's hash."""
    files = spark.read.format("binaryFile").load(path)
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return files.select(F.concat_ws("-", stem, F.substring(F.sha2("content", 256), 1, 8)).alias("book_id"), "path", "content")


def safe(name: str) -> str:
    path = posixpath.normpath(name.replace("\\", "/"))
    if path.startswith(("/", "../")) or path == ".." or ":" in path.split("/")[0]:
        raise UnsafeEntry(name)
    return path


def unpacked(content: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {safe(i.filename): z.read(i) for i in z.infolist() if not i.is_dir()}


#: Bytes of packages or entries that are given to Arrow at a time, or one of them.
PART = 4 << 20


def _in_parts(rows, schema: pa.Schema):
    """Batches of rows (tuples, the last value bytes) of about ``PART`` bytes."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[-1])
        if size >= PART:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], f.type) for i, f in enumerate(schema)], schema=schema)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], f.type) for i, f in enumerate(schema)], schema=schema)


def entries(books: DataFrame) -> DataFrame:
    """Rows of ENTRY of every package; an entry that leads out of its package fails the job."""
    schema = pa.schema([("book_id", pa.string()), ("name", pa.string()), ("content", pa.binary())])

    def run(batches):
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    book, content = (batch.column(k)[i].as_py() for k in (0, 1))
                    for name, data in unpacked(content).items():
                        yield book, name, data

        return _in_parts(rows(), schema)

    return books.selectExpr("cast(book_id as string) as book_id", "content").mapInArrow(run, ENTRY)


def opf_path(container: bytes) -> str:
    for el in ET.fromstring(container).iter():
        if el.tag.rpartition("}")[2] == "rootfile":
            if not el.get("full-path"):
                raise ValueError("the container names no package document")
            return el.get("full-path")
    raise ValueError("the container names no package document")


def packages(found: DataFrame) -> DataFrame:
    """(book_id, opf, items, spine) of each book's entries: items (id, href, media_type, properties), spine (pos, idref)."""
    small = found.where(F.col("name").endswith(".opf") | (F.col("name") == CONTAINER))
    by = small.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "content"))).alias("files"))
    schema = "book_id string, opf string, items array<struct<id:string,href:string,media_type:string,properties:string>>, spine array<struct<pos:int,idref:string>>"
    arrow = pa.schema([
        ("book_id", pa.string()), ("opf", pa.string()),
        ("items", pa.list_(pa.struct({k: pa.string() for k in ("id", "href", "media_type", "properties")}))),
        ("spine", pa.list_(pa.struct({"pos": pa.int32(), "idref": pa.string()}))),
    ])

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                files = dict(r["files"])
                if CONTAINER not in files:
                    raise ValueError(f"{r['book_id']} has no container")
                opf = opf_path(files[CONTAINER])
                root = ET.fromstring(files[opf])
                items = [{"id": i.get("id"), "href": i.get("href"), "media_type": (i.get("media-type") or "").lower(), "properties": (i.get("properties") or "").lower()} for i in root.iter(f"{OPF}item")]
                rows.append({"book_id": r["book_id"], "opf": opf, "items": items, "spine": [{"pos": n, "idref": i.get("idref")} for n, i in enumerate(root.iter(f"{OPF}itemref"))]})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return by.mapInArrow(run, schema)


def _path(opf: str, href: str) -> str:
    """SQL for an href below its package document's folder."""
    folder = rf"regexp_replace({opf}, r'[^/]*$', '')"
    whole = rf"concat({folder}, regexp_replace({href}, '#.*$', ''))"
    return rf"regexp_replace(regexp_replace({whole}, r'(^|/)(\./)+', '$1'), r'[^/]+/\.\./', '')"


def spine_documents(package: DataFrame, found: DataFrame) -> DataFrame:
    """(book_id, pos, name): content documents in reading order that exist; a document counts at its first place only."""
    items = package.select("book_id", "opf", F.explode("items").alias("i")).select("book_id", "opf", "i.id", "i.href").where("id is not null and href <> ''")
    items = items.withColumn("name", F.expr(_path("opf", "href"))).drop("opf", "href")
    refs = package.select("book_id", F.explode("spine").alias("s")).select("book_id", "s.pos", F.col("s.idref").alias("id"))
    docs = refs.join(items, ["book_id", "id"]).join(found.select("book_id", "name"), ["book_id", "name"], "left_semi")
    return deduplicated(docs, "book_id", "name", "pos")


def deduplicated(rows: DataFrame, book: str, name: str, pos: str) -> DataFrame:
    """The first row of each name in a book, numbered anew from 1."""
    first = rows.groupBy(book, name).agg(F.min(pos).alias("__pos"))
    return first.select(book, F.row_number().over(Window.partitionBy(book).orderBy("__pos")).alias(pos), name)


def nav_documents(package: DataFrame, found: DataFrame) -> DataFrame:
    """(book_id, name) of the tables of contents."""
    items = package.select("book_id", "opf", F.explode("items").alias("i")).select("book_id", "opf", "i.*")
    nav = (F.col("media_type") == "application/x-dtbncx+xml") | F.array_contains(F.split("properties", r"\s+"), "nav")
    return items.where(nav).select("book_id", F.expr(_path("opf", "href")).alias("name")).join(found.select("book_id", "name"), ["book_id", "name"], "left_semi")


def with_metadata(opf: bytes, language: str, suffix: str | None = None) -> bytes:
    """A package document with one dc:language and, once, a suffix to its title."""
    ET.register_namespace("", OPF[1:-1])
    ET.register_namespace("dc", DC[1:-1])
    root = ET.fromstring(opf)
    meta = root.find(f"{OPF}metadata")
    if meta is None:
        return opf
    langs = meta.findall(f"{DC}language")
    for extra in langs[1:]:
        meta.remove(extra)
    (langs[0] if langs else ET.SubElement(meta, f"{DC}language")).text = language
    title = meta.find(f"{DC}title")
    if suffix and title is not None and suffix not in (title.text or ""):
        title.text = f"{(title.text or '').strip()} {suffix}".strip()
    return ET.tostring(root, encoding="utf-8", xml_declaration=True)


def document(xhtml: str, doctype: str = "") -> bytes:
    """A content document as bytes: XML declaration, doctype if given, UTF-8."""
    return ("<?xml version='1.0' encoding='UTF-8'?>\n" + (f"{doctype}\n" if doctype else "") + xhtml).encode()


def packed(files: dict[str, bytes]) -> bytes:
    """A package: mimetype first and stored, then all by name, deflated, with fixed times so that reruns agree."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if "mimetype" in files:
            z.writestr(zipfile.ZipInfo("mimetype"), files["mimetype"], zipfile.ZIP_STORED)
        for name in sorted(n for n in files if n != "mimetype"):
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, files[name], compresslevel=zlib.Z_DEFAULT_COMPRESSION)
    return out.getvalue()


def repacked(found: DataFrame) -> DataFrame:
    """(book_id, content): one package per book from its entries; a book's entries meet in one row."""
    by = found.groupBy("book_id").agg(F.collect_list(F.struct("name", "content")).alias("files"))
    schema = pa.schema([("book_id", pa.string()), ("content", pa.binary())])

    def run(batches):
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    yield batch.column(0)[i].as_py(), packed({f["name"]: f["content"] for f in batch.column(1)[i].as_py()})

        return _in_parts(rows(), schema)

    return by.mapInArrow(run, "book_id string, content binary")


_PICTURES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp"}


def _nested(contents: list[tuple[int, str, str]]) -> str:
    """A nested list of (level, label as markup, href) in order; a deeper level goes into the entry before it."""
    out, levels = [], []
    for level, label, href in contents:
        if levels and level > levels[-1]:
            out.append("<ol>")
            levels.append(level)
        elif not levels:
            levels.append(level)
        else:
            out.append("</li>")
            while len(levels) > 1 and level < levels[-1] and level <= levels[-2]:
                out.append("</ol></li>")
                levels.pop()
        out.append(f'<li><a href="{href}">{label}</a>')
    out += ["</li></ol>"] * (len(levels) - 1)
    return "".join(out) + ("</li>" if levels else "")


def compiled(
    title: str, author: str, language: str, chapters: list[tuple[str, str]], contents: list[tuple[int, str, int, str]] | None = None, images: dict[str, bytes] | None = None, marked_up: bool = False,
) -> bytes:
    """A package of (heading, xhtml body) chapters with a table of contents.

    ``contents``: (level, label, chapter from 1, id), by default the chapters'
    headings; ``images``: pictures by their path; ``marked_up``: headings and
    labels have their character references.
    """
    from html import escape

    shown = (lambda x: x) if marked_up else escape
    page = '<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{}</title></head><body>{}</body></html>'
    files = {"mimetype": b"application/epub+zip"}
    files[CONTAINER] = b'<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    items, refs = [], []
    names = [f"ch{n:04d}.xhtml" for n in range(1, len(chapters) + 1)]
    for n, (name, (heading, body)) in enumerate(zip(names, chapters, strict=True), 1):
        files[f"OPS/{name}"] = document(page.format(shown(heading), body))
        items.append(f'<item id="c{n}" href="{name}" media-type="application/xhtml+xml"/>')
        refs.append(f'<itemref idref="c{n}"/>')
    if contents is None:
        entries_ = [(1, escape(heading), name) for name, (heading, _) in zip(names, chapters, strict=True)]
    else:
        entries_ = [(level, shown(label), f"{names[n - 1]}#{ident}") for level, label, n, ident in contents] or [(1, escape(title), names[0])]
    for n, (path, data) in enumerate(sorted((images or {}).items()), 1):
        files[f"OPS/{safe(path)}"] = data
        items.append(f'<item id="i{n}" href="{escape(safe(path))}" media-type="{_PICTURES.get(path.rpartition(".")[2].lower(), "application/octet-stream")}"/>')
    files["OPS/nav.xhtml"] = document(page.format("Contents", f'<nav xmlns:epub="http://www.idpf.org/2007/ops" epub:type="toc"><ol>{_nested(entries_)}</ol></nav>'))
    files["OPS/package.opf"] = document(
        f'<package xmlns="{OPF[1:-1]}" version="3.0" unique-identifier="id"><metadata xmlns:dc="{DC[1:-1]}"><dc:identifier id="id">{escape(title)}</dc:identifier>'
        f"<dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator><dc:language>{escape(language)}</dc:language></metadata>"
        f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{"".join(items)}</manifest><spine>{"".join(refs)}</spine></package>'
    )
    return packed(files)
