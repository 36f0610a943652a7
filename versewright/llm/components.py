"""Connected components of a link table, by alternating stars.

Every round replaces each link by one to the smallest neighbour, first for
the larger and then for the smaller ends.  A round is two aggregations with
map-side combine and two equi-joins, so a hub with a third of all links is
split by adaptive execution like any skewed join, and no component is ever
gathered in one task or at the driver.  The number of rounds grows with the
logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frozen


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return int(row[0]), int(row[1] or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("node", "near")
    least = frozen(both.groupBy("node").agg(F.least(F.min("near"), F.first("node")).alias("least")))  # stored: the join can be split at a hub
    out = both.join(least, "node").where(F.col("near") > F.col("node"))
    return out.select(F.col("near").alias("hi"), F.col("least").alias("lo")).where("hi <> lo").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = frozen(edges.groupBy("hi").agg(F.min("lo").alias("least")))
    moved = edges.join(least, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo")).where("hi <> lo")
    own = least.select("hi", F.col("least").alias("lo"))
    return moved.union(own).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)``: for every node of ``edges`` the smallest node it reaches.

    ``a`` and ``b`` are comparable columns of one type.  Links with a null
    end, loops and repeated links add nothing; an empty table gives an empty
    result.  Only nodes with a link to another node are returned.  Rounds
    halve a chain, so ``max_rounds`` is beyond chains that a table can hold; if
    components have not settled by then it is an error, and a call with more
    rounds goes on from the start.
    """
    edges = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = frozen(edges.toDF("hi", "lo", "whole").where("whole and hi <> lo").select("hi", "lo").distinct())
    before = _signature(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = frozen(_small_star(frozen(_large_star(edges))))
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    own = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(own)
