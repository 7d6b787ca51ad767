"""Greedy packing of consecutive items into chunks of a word target.

A new chunk starts when the current one is not empty and would exceed the
target, so packing is a fold over a document's word counts.  ``packed`` folds a
sorted stream and never holds a document; ``packed_natively`` gathers only the
counts of a document, in one array of integers, and needs no Python.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def packed(rows: DataFrame, target: int, key: str = "doc_id", order: str = "block_no", words: str = "n_words") -> DataFrame:
    """``rows`` with chunk_no from 1 by ``key``; rows stream by key and order, one shuffle on the key."""
    cols = rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    at_key, at_words = cols.index(key), cols.index(words)

    def run(batches):
        current, chunk, size, some = object(), 1, 0, False
        for batch in batches:
            out = []
            for k, n in zip(batch.column(at_key).to_pylist(), batch.column(at_words).to_pylist(), strict=True):
                n = n or 0
                if k != current:
                    current, chunk, size = k, 1, n
                elif some and size + n > target:
                    chunk, size = chunk + 1, n
                else:
                    size += n
                some = True
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*cols, "chunk_no"])

    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, f"{kinds}, chunk_no int")


def packed_natively(rows: DataFrame, target: int, key: str = "doc_id", order: str = "block_no", words: str = "n_words") -> DataFrame:
    """The same in SQL functions: (key, order, n_words, chunk_no); for documents of moderate length."""
    items = F.array_sort(F.collect_list(F.struct(order, words)))
    fold = F.expr(
        f"aggregate(items, struct(cast(array() as array<int>) as c, 0L as n), (a, x) -> if(size(a.c) > 0 and a.n + x.{words} > {target},"
        f" struct(array_append(a.c, element_at(a.c, -1) + 1) as c, cast(x.{words} as bigint) as n),"
        f" struct(array_append(a.c, coalesce(try_element_at(a.c, -1), 1)) as c, a.n + x.{words} as n)), a -> a.c)"
    )
    out = rows.groupBy(key).agg(items.alias("items")).select(key, F.explode(F.arrays_zip("items", fold.alias("chunk"))).alias("x"))
    return out.select(key, f"x.items.{order}", f"x.items.{words}", F.col("x.chunk").alias("chunk_no"))


def with_tail_merged(rows: DataFrame, target: int, share: float = 0.3, key: str = "doc_id", words: str = "n_words") -> DataFrame:
    """Chunks with a last one of less than ``share`` of the target put into the one before."""
    w = Window.partitionBy(key)
    last = F.max("chunk_no").over(w)
    rows = rows.withColumn("__last", last).withColumn("__tail", F.sum(F.when(F.col("chunk_no") == F.col("__last"), F.col(words))).over(w))
    small = (F.col("chunk_no") == F.col("__last")) & (F.col("__last") > 1) & (F.col("__tail") < share * target)
    return rows.withColumn("chunk_no", F.when(small, F.col("chunk_no") - 1).otherwise(F.col("chunk_no"))).drop("__last", "__tail")


def numbered(rows: DataFrame, book: str, doc: str) -> DataFrame:
    """Adds job_no: chunks of a book counted over its documents in order."""
    return rows.withColumn("job_no", F.dense_rank().over(Window.partitionBy(book).orderBy(doc, "chunk_no")))


def chunk_texts(rows: DataFrame, key: str = "doc_id", order: str = "block_no", by: str = "\n\n") -> DataFrame:
    """(key, chunk_no, text, n_words, block_from, block_to) of packed rows."""
    ordered = F.array_sort(F.collect_list(F.struct(order, "text")))
    return rows.groupBy(key, "chunk_no").agg(
        F.array_join(F.transform(ordered, lambda x: x["text"]), by).alias("text"), F.sum("n_words").alias("n_words"),
        F.min(order).alias("block_from"), F.max(order).alias("block_to"),
    )


def first_chunks(rows: DataFrame, n: int) -> DataFrame:
    """Rows of the first ``n`` chunks, by number, so that it is the same ones on every run."""
    return rows.where(F.col("chunk_no") <= n)
