"""Deletion of nodes from a partition, and what it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import dense_index


def remove_nodes(membership: DataFrame, request: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(membership, reindex): the nodes leave every community, empty communities go, ids become dense in ascending order.

    reindex: ``old_c, new_c`` of the communities that stay.
    """
    rest = membership.join(request.select("node").distinct(), "node", "left_anti").select("community", "node")
    index = dense_index(rest, "community", "new_c").withColumnRenamed("community", "old_c")
    out = rest.join(index, F.col("community") == F.col("old_c")).select(F.col("new_c").alias("community"), "node")
    return out, index


def affected(membership: DataFrame, request: DataFrame) -> DataFrame:
    """``community``: those with a node of the request."""
    return membership.join(request.select("node").distinct(), "node", "left_semi").select("community").distinct()


def remap(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Community rows under their new ids; rows of communities that went are dropped."""
    cols = [c for c in rows.columns if c != "community"]
    return rows.join(index, F.col("community") == F.col("old_c")).select(F.col("new_c").alias("community"), *cols)


def affected_new(touched: DataFrame, index: DataFrame) -> DataFrame:
    return touched.join(index, F.col("community") == F.col("old_c")).select(F.col("new_c").alias("community"))


def influence(scores: DataFrame, touched: DataFrame) -> DataFrame:
    """Scored pairs with an affected community at either end."""
    a = scores.join(touched.toDF("src_c"), "src_c", "left_semi")
    b = scores.join(touched.toDF("dst_c"), "dst_c", "left_semi")
    return a.select("src_c", "dst_c", "score").union(b.select("src_c", "dst_c", "score")).distinct()


def memberships_by_node(membership: DataFrame) -> DataFrame:
    """``node, communities``: sorted list of each node's communities."""
    return membership.distinct().groupBy("node").agg(F.array_sort(F.collect_list("community")).alias("communities"))
