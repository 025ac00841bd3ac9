"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the node, so no node's neighbours are ever gathered in one task, and the number
of rounds grows with the logarithm of the longest path.  Each round is written to the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import durable


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u")).toDF("u", "v")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", "m")).distinct()


def connected_components(edges: DataFrame, write=None, max_rounds: int = 50) -> DataFrame:
    """``node, component`` for every node that has an edge to another node; the component is its smallest node.

    edges: two integer columns, in either direction, repeats and self-loops allowed, nulls dropped.  ``write`` makes a
    durable copy of a DataFrame (default: a reliable checkpoint).
    """
    write = write or durable
    a, b = (F.col(c) for c in edges.columns[:2])
    e = write(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        e = write(_small_star(_large_star(e)))
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
