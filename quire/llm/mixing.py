"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in SQL functions only.

1. Targets.  Sources in code-point order (null last) weigh 5, 2, 1, repeating,
   and share all words; a target stops at ``CAP`` times the size of its source
   and the excess is shared anew by weight.  That is water filling, found with
   one running sum over sources ordered by cap over weight.
2. Blocks.  A keyed hash permutes the documents of a source and cuts them into
   ``BLOCKS`` blocks by ranges of the hash.  Every document is taken
   floor(target / size) times; what is left of the target is filled with blocks
   in order of the permutation, and one block at the edge is cut at the document
   nearest to the target.  The cut is found by ever finer ranges of the hash, so
   that no task sorts the documents of a block.
3. Tree.  The blocks to draw of each source are its exact quota.  A node of the
   tree holds such quotas for a range of shards; its units are dealt in random
   order, the first half goes to the left child and the rest to the right, which
   is a multivariate hypergeometric draw of the child's quotas.  After log2
   levels every shard has a quota of every source, and takes the next that many
   blocks of the source's permutation: blocks of different shards are disjoint.
4. Within a shard rows are ordered by another keyed hash.

The tree works on blocks (at most ``BLOCKS`` times ``CAP`` per source), never on
documents; windows without a key are over sources or blocks.  The documents are
read for the sizes of blocks and for the result; the table of blocks is sent to
every executor if it has at most ``SENT`` rows, which is measured, and then no
row with a text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, words_sql

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCKS = 128
SHARDS = 8
SEED = 20240607
_SPAN = 2**31
#: Bits of a place that each step of the cut looks at, after those of the block.
STEP = 8
#: Rows of the table of blocks that are sent to every executor; a larger one is joined.
SENT = 100_000


def _hash(*cols, seed: int):
    """31 uniform bits of the columns under a seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 33)


def slim(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size (words of the whole text, null: 0), place in the permutation and block of each row."""
    size = F.expr(f"cast(size({words_sql('text')}) as bigint)")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), _hash("doc_id", F.xxhash64("text"), seed=seed).alias("place"))
    return rows.withColumn("block", (F.col("place") * BLOCKS / _SPAN).cast("int"))


def targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """Adds weight and target to one row per source (source, source_size)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    ranked = sizes.withColumn("weight", turn.cast("double")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    # Sources fill up in this order; all that come before a source in it are full when it is.
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(upto), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    )
    ranked = ranked.withColumn("level", level).withColumn("full", F.col("most") <= F.col("level") * F.col("weight"))
    # The level of the first source that does not fill up holds for all that follow.
    level = F.min(F.when(~F.col("full"), F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(whole)["level"]
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * level)
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def _same(a: DataFrame, b: DataFrame):
    return a["source"].eqNullSafe(b["source"])


def plan(rows: DataFrame, weights=WEIGHTS, cap: float = CAP):
    """(targets by source, blocks): what is taken of every block of ``slim`` rows.

    Blocks have source, block, copies (of every document) and upto: documents of
    the block with a place up to it are taken once more (-1: none).
    """
    blocks = cut(rows.groupBy("source", "block").agg(F.sum("size").alias("block_size")))
    goal = cut(targets(blocks.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, cap))
    goal_b = goal.withColumnRenamed("source", "s")
    b = blocks.join(goal_b, blocks["source"].eqNullSafe(goal_b["s"])).drop("s")
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    b = b.withColumn("copies", times.cast("int")).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    before = F.sum("block_size").over(Window.partitionBy("source").orderBy("block")) - F.col("block_size")
    b = b.withColumn("before", before)
    b = cut(b.withColumn("whole", (F.col("rest") > 0) & (F.col("before") + F.col("block_size") <= F.col("rest"))))
    at = b.where("not whole and before < rest").select("source", (F.col("rest") - F.col("before")).alias("room"), F.col("block").cast("bigint").alias("range"))
    cutoff = _cut_places(rows, at).withColumnsRenamed({"source": "cs", "range": "cb"})
    out = b.join(cutoff, b["source"].eqNullSafe(F.col("cs")) & (b["block"] == F.col("cb")), "left")
    upto = F.when(F.col("whole"), F.lit(_SPAN)).otherwise(F.coalesce("upto", F.lit(-1)))
    return goal, cut(out.select("source", "block", "copies", upto.cast("bigint").alias("upto")))


def _cut_places(rows: DataFrame, edge: DataFrame) -> DataFrame:
    """(source, range, upto) for (source, room, range): the last place of a range so that the words up to it come nearest to room.

    The range is cut into finer ones, by the next bits of the place; all that fit
    are taken, and the first that does not is cut in turn.  Rows that share a
    place are taken or left together.
    """
    bits, here = (_SPAN - 1).bit_length() - (BLOCKS - 1).bit_length(), edge.withColumn("first", F.col("range"))
    while bits:
        here = cut(here)
        fine = max(bits - STEP, 0)
        e = here.select(F.col("source").alias("es"), F.col("range").alias("er"), "room", F.col("first").alias("ef"))
        inside = rows.join(F.broadcast(e) if _small(here) else e, rows["source"].eqNullSafe(F.col("es")) & (F.shiftright("place", bits) == F.col("er")))
        sums = inside.groupBy("source", F.shiftright("place", fine).alias("range")).agg(F.sum("size").alias("size"), F.first("room").alias("room"), F.first("ef").alias("first"))
        run = F.sum("size").over(Window.partitionBy("source").orderBy("range"))
        sums = sums.withColumn("run", run)
        if fine:
            over = sums.where("run > room").withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("range"))).where("n = 1")
            here = over.select("source", (F.col("room") - (F.col("run") - F.col("size"))).alias("room"), "range", "first")
        else:
            low = F.min("range").over(Window.partitionBy("source"))
            fits = F.max(F.when(F.col("run") - F.col("size") / 2 <= F.col("room"), F.col("range")))
            found = sums.withColumn("low", low).groupBy("source", F.col("first").alias("range")).agg(F.coalesce(fits, F.min("low") - 1).alias("upto"))
        bits = fine
    return found


def _small(table: DataFrame) -> bool:
    return table.limit(SENT + 1).count() <= SENT


def _dealt(rows: DataFrame, weights, cap: float, shards: int, seed: int):
    """(targets by source, blocks): ``plan``'s blocks that the tree drew, with the shard of each drawn copy (a map)."""
    goal, blocks = plan(rows, weights, cap)
    drawn = cut(split(blocks.select("source", "block", (F.col("copies") + (F.col("upto") >= 0).cast("int")).alias("draws")), shards, seed))
    shard = drawn.groupBy("source", "block").agg(F.map_from_entries(F.collect_list(F.struct("copy", "shard"))).alias("shard_of"))
    b = blocks.join(shard.withColumnsRenamed({"source": "ss", "block": "sb"}), F.col("source").eqNullSafe(F.col("ss")) & (F.col("block") == F.col("sb")))
    b = b.select(F.col("source").alias("__bs"), F.col("block").alias("__bb"), F.col("copies").alias("__times"), F.col("upto").alias("__upto"), "shard_of")
    return (F.broadcast(goal), F.broadcast(cut(b))) if _small(blocks) else (goal, b)


def _copies(place: str):
    """The drawn copies of a document, by its place, in a row joined with its block (null: no draw)."""
    n = F.col("__times") + (F.col(place) <= F.col("__upto")).cast("int")
    return F.filter(F.map_keys("shard_of"), lambda c: c <= n)


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: int = SEED, shards: int = SHARDS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row of ``docs`` (doc_id, text, source).

    Copies are those that the tree deals to a shard; documents without draws
    have 0.  Null texts have size 0; null is a source of its own, the last.  An
    empty table gives no rows; sources without words get target 0.  Rows that
    repeat id and text are taken together.  Reruns over the same rows agree.
    """
    rows = cut(slim(docs, seed))
    goal, blocks = _dealt(rows, weights, cap, shards, seed)
    goal = goal.withColumnRenamed("source", "s")
    out = rows.join(blocks, rows["source"].eqNullSafe(F.col("__bs")) & (rows["block"] == F.col("__bb")), "left")
    out = out.join(goal, out["source"].eqNullSafe(F.col("s"))).withColumn("copies", F.when(F.col("shard_of").isNull(), 0).otherwise(F.size(_copies("place"))))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def split(blocks: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Shard of every drawn copy of a block: (source, block, copy, shard); ``shards`` is a power of two.

    ``blocks``: source (null is one), block and draws, a row per block; null or no
    draws draw nothing, no blocks give no rows.
    """
    units = blocks.groupBy("source").agg(F.sum("draws").alias("quota"))
    units = units.where("quota > 0").select("source", F.explode(F.sequence(F.lit(1), F.col("quota").cast("int"))).alias("unit"))
    units = units.withColumn("node", F.lit(0))
    for depth in range((shards - 1).bit_length()):
        by = Window.partitionBy("node")
        rank = F.row_number().over(by.orderBy(_hash("source", "unit", seed=seed + 1 + depth), "source", "unit"))
        left = rank * 2 <= F.count(F.lit(1)).over(by)
        units = units.withColumn("node", F.col("node") * 2 + F.when(left, 0).otherwise(1))
    quotas = units.groupBy("source", "node").agg(F.count(F.lit(1)).alias("n"))
    last = F.sum("n").over(Window.partitionBy("source").orderBy("node"))
    quotas = quotas.select(F.col("source").alias("qs"), F.col("node").alias("shard"), (last - F.col("n")).alias("lo"), last.alias("hi"))
    drawn = blocks.where("draws > 0").select("source", "block", F.explode(F.sequence(F.lit(1), "draws")).alias("copy"))
    order = Window.partitionBy("source").orderBy("copy", _hash("block", "copy", seed=seed - 1), "block")
    drawn = drawn.withColumn("rank", F.row_number().over(order) - 1)
    fits = drawn["source"].eqNullSafe(F.col("qs")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return drawn.join(quotas, fits).select("source", "block", "copy", "shard")


def sharded(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: the columns of ``docs``, once per copy taken, with mix_copy, mix_shard and mix_order.

    mix_order sorts the rows of a shard; documents that are not taken, as those
    without words, are left out.  Rows that repeat id and text are taken together.
    An empty table gives no rows; added columns that clash get a final underscore.
    """
    rows = cut(slim(docs, seed))
    _, b = _dealt(rows, weights, cap, shards, seed)
    place = _hash("doc_id", F.xxhash64("text"), seed=seed)
    all_rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("source").cast("string").alias("__s"), place.alias("__place"))
    all_rows = all_rows.withColumn("__b", (F.col("__place") * BLOCKS / _SPAN).cast("int"))
    out = all_rows.join(b, F.col("__s").eqNullSafe(F.col("__bs")) & (F.col("__b") == F.col("__bb")))
    out = out.withColumn("__copy", F.explode(_copies("__place")))
    added = {"mix_copy": F.col("__copy"), "mix_shard": F.element_at("shard_of", F.col("__copy")), "mix_order": F.xxhash64(F.lit(seed), "__place", "__copy")}
    taken = {c.lower() for c in docs.columns}
    return out.select("__row.*", *(c.alias(k if k not in taken else f"{k}_") for k, c in added.items()))
