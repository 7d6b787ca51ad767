"""PDF files: page texts by a reader that is given as a function, and the places of what stands on the pages.

``reader(content) -> list of page texts`` runs on the executors over Spark's
``binaryFile`` source; ``pdf_reader.read`` is a small one.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut, stored
from ..operators import figures
from . import pdf_reader


def pages(files: DataFrame, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """(book_id, page from 0, text) of rows (book_id, content)."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                texts = reader(batch.column(1)[i].as_py())
                cols = [pa.array([batch.column(0)[i].as_py()] * len(texts), pa.string()), pa.array(range(len(texts)), pa.int32()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=["book_id", "page", "text"])

    return files.selectExpr("cast(book_id as string) as book_id", "content").mapInArrow(run, "book_id string, page int, text string")


def extracted(files: DataFrame, reader: Callable[[bytes], list[str]], store: str) -> DataFrame:
    """``pages`` with a store: files (book_id, content) whose bytes were read before are not read again.

    The store is a folder of Parquet with the pages by hash of the content; a
    file without pages has one row without a number, so that it counts as read.
    """
    spark = files.sparkSession
    schema = "content_hash string, page int, text string"
    try:
        kept = spark.read.schema(schema).parquet(store)
    except Exception as e:  # nothing has been read yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        kept = spark.createDataFrame([], schema)
    keyed = files.select("book_id", F.sha2("content", 256).alias("content_hash"), "content")
    todo = keyed.join(kept.select("content_hash").distinct(), "content_hash", "left_anti").dropDuplicates(["content_hash"])
    made = pages(todo.select(F.col("content_hash").alias("book_id"), "content"), reader).withColumnRenamed("book_id", "content_hash")
    made = todo.select("content_hash").join(made, "content_hash", "left")
    cut(made).write.mode("append").parquet(store)
    have = spark.read.schema(schema).parquet(store).where("page is not null")
    return keyed.select("book_id", "content_hash").join(have, "content_hash").select("book_id", "page", "text")


LAYOUT = "book_id string, page int, kind string, x0 double, y0 double, x1 double, y1 double, size double, text string, w_px int, h_px int"


def layout(files: DataFrame) -> DataFrame:
    """Rows of LAYOUT of files (book_id, content): what stands where on every page.

    Kinds: page (its bounds, and the book's body size), text (blocks), draw (painted paths), raster
    (pictures).  A file that can't be read fails the job.
    """
    schema = pa.schema([("book_id", pa.string()), ("page", pa.int32()), ("kind", pa.string()), *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1", "size")), ("text", pa.string()), ("w_px", pa.int32()), ("h_px", pa.int32())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = pdf_reader.read_pages(batch.column(1)[i].as_py())
                body, rows = pdf_reader.body_size(found), []
                for n, page in enumerate(found):
                    rows.append((n, "page", 0.0, 0.0, page.width, page.height, body, None, None, None))
                    rows += [(n, "text", *box, size, text, None, None) for box, size, text in pdf_reader.blocks(page)]
                    rows += [(n, "draw", *box, None, None, None, None) for box in page.draws]
                    rows += [(n, "raster", *box, None, None, w, h) for box, w, h in page.rasters]
                cols = [pa.array([batch.column(0)[i].as_py()] * len(rows), pa.string())]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array([r[k] for r in rows], f.type) for k, f in enumerate(list(schema)[1:]))], schema=schema)

    return files.selectExpr("cast(book_id as string) as book_id", "content").mapInArrow(run, LAYOUT)


def with_figures(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(page texts (book_id, page, text), figures, their texts) of files (book_id, content).

    Figures are planned from the pages' geometry; labels in them go into the
    pictures, so they are left out of the texts, and prose stays.
    """
    found = stored(layout(files))
    key, box = ["book_id", "page"], ["x0", "y0", "x1", "y1"]
    draws, rasters = found.where("kind = 'draw'").select(*key, *box), found.where("kind = 'raster'").select(*key, *box, "w_px", "h_px")
    texts = found.where("kind = 'text'").select(*key, *box, "text", "size")
    pages_ = found.where("kind = 'page'").select(*key, F.col("x1").alias("width"), F.col("y1").alias("height"), F.col("size").alias("body"))
    plain = texts.select(*key, *box, "text")
    planned, inside = figures.plan(cut(figures.regions(pages_, draws, plain, rasters)), draws, plain, rasters)
    planned, inside = cut(planned), cut(inside)
    labels = inside.where("kind = 'label'").select(*key, *box, "text").distinct()
    rest = texts.join(labels, [*key, *box, "text"], "left_anti").join(pages_.select(*key, "body"), key)
    level = F.when(F.col("size") >= 1.8 * F.col("body"), "# ").when(F.col("size") >= 1.4 * F.col("body"), "## ").when(F.col("size") >= 1.15 * F.col("body"), "### ").otherwise("")
    short = (level != "") & (F.size(F.split("text", "\n")) <= 3)
    part = F.when(short, F.concat(level, F.regexp_replace("text", r"\s+", " "))).otherwise(F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("y0", "x0", part.alias("part"))))
    return rest.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n").alias("text")), planned, inside
