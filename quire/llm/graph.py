"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two joins on node ids, so no component, no
neighbourhood and no edge list ever meets in one task or on the driver.  Rounds
needed grow with the logarithm of the longest path.  As long as there are few
links (counted each round) the least neighbours are sent to every executor, so
that the links of a star's centre stay where they lie; many are joined, and a
centre with hundreds of megabytes of them is split by the adaptive join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links up to which the least neighbours of nodes are sent: at most two numbers for each end of a link.
SENT = 200_000


def _least(edges: DataFrame) -> DataFrame:
    """For each node u the least of its neighbours v and itself."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _sent(table: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(table) if few else table


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the least node id of its component.

    Self-links and repeated links are ignored, null ends too.  No links: no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    e = cut(e.distinct())
    before = _state(e)
    while before[0]:
        few = before[0] <= SENT
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_sent(_least(both), few), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = _least(large)
        small = (
            large.join(_sent(least, few), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        )
        e = cut(small.where("u != v").distinct())
        after = _state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
