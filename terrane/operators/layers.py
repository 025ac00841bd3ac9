"""Graph layers with given weights, as joins and grouped sums; and node-classification scores.

All layers read ``nodes(node, feat)`` and directed ``edges(src, dst)`` and return ``node, feat``.  A node's own features count
only where a layer has a root term (SAGE): the mapped graph has no self-loops and none are added.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalise
from .graph import _vector_sum, neighbour_sums, to_vectors

Matrix = list[list[float]]


def times(vector: str | Column, weights: Matrix) -> Column:
    """Row vector times matrix (one row of ``weights`` for each input dimension)."""
    v = F.col(vector) if isinstance(vector, str) else vector
    columns = list(zip(*weights))
    return F.array(*[F.aggregate(F.zip_with(v, F.array(*[F.lit(float(x)) for x in c]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x) for c in columns])


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def relu(vector: str) -> Column:
    return F.transform(vector, lambda x: F.greatest(x, F.lit(0.0)))


def _zeros(width: int) -> Column:
    return F.array(*[F.lit(0.0)] * width)


def _filled(nodes: DataFrame, sums: DataFrame, width: int) -> DataFrame:
    got = sums.withColumnRenamed("dst", "node")
    return nodes.select("node").join(got, "node", "left").select("node", F.coalesce("feat", _zeros(width)).alias("feat"))


def _projection(weights: Matrix | None) -> Column:
    return times("feat", weights) if weights else F.col("feat")


def _mean_in(nodes: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """``node, mean``: the mean of the in-neighbours' features, zeros without any."""
    k = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("k"))
    sums = neighbour_sums(edges, nodes.select(F.col("node").alias("src"), F.col("feat").cast("array<double>").alias("feat")))
    sums = sums.join(k, "dst").select("dst", F.transform("feat", lambda x: x / F.col("k")).alias("feat"))
    return _filled(nodes, sums, width).withColumnRenamed("feat", "mean")


def gcn_layer(nodes: DataFrame, edges: DataFrame, weights: Matrix | None, width: int = 0) -> DataFrame:
    """Sum over in-edges of the source's projection, over the roots of its out-degree and the node's in-degree.

    Without weights ``feat`` is the projection, of ``width`` positions; so in the other layers.
    """
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("o"))
    into = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("i"))
    h = nodes.select(F.col("node").alias("src"), _projection(weights).alias("h")).join(out, "src")
    sums = neighbour_sums(edges, h.select("src", F.transform("h", lambda x: x / F.sqrt("o")).alias("feat")))
    sums = sums.join(into, "dst").select("dst", F.transform("feat", lambda x: x / F.sqrt("i")).alias("feat"))
    return _filled(nodes, sums, len(weights[0]) if weights else width)


def sage_layer(nodes: DataFrame, edges: DataFrame, own: Matrix, neighbours: Matrix) -> DataFrame:
    """The node's own projection plus the projection of its in-neighbours' mean."""
    return nodes.select("node", "feat").join(_mean_in(nodes, edges, len(own)), "node").select("node", plus(times("feat", own), times("mean", neighbours)).alias("feat"))


def gat_layer(nodes: DataFrame, edges: DataFrame, weights: Matrix | None, left: list[float], right: list[float], slope: float = 0.2) -> DataFrame:
    """One attention head: in-neighbours' projections weighted by a softmax of leaky sums of both ends' scores."""
    h = nodes.select("node", _projection(weights).alias("h"))
    score = lambda a: times("h", [[x] for x in a])[0]
    h = h.select("node", "h", score(left).alias("l"), score(right).alias("r"))
    e = edges.join(h.select(F.col("node").alias("src"), "h", "l"), "src").join(h.select(F.col("node").alias("dst"), "r"), "dst")
    z = F.col("l") + F.col("r")
    e = e.select("src", "dst", "h", F.when(z > 0, z).otherwise(slope * z).alias("z"))
    top = e.groupBy("dst").agg(F.max("z").alias("top"))
    e = e.join(top, "dst").select("dst", "h", F.exp(F.col("z") - F.col("top")).alias("a"))
    total = e.groupBy("dst").agg(F.sum("a").alias("all"))
    sums = _vector_sum(e.select("dst", F.transform("h", lambda x: x * F.col("a")).alias("h")), "dst", "h").join(total, "dst").select("dst", "pos", (F.col("x") / F.col("all")).alias("x"))
    return _filled(nodes, to_vectors(sums, "dst"), len(left))


def hashed_weights(rows: int, cols: int, seed: int, matrix: int = 0) -> np.ndarray:
    """A seeded matrix, uniform within the root of 6 / (rows + cols); each entry from the MD5 of ``seed:matrix:row:col``."""
    draw = lambda i, j: int(hashlib.md5(f"{seed}:{matrix}:{i}:{j}".encode()).hexdigest()[:8], 16) / 2**32
    unit = np.array([[draw(i, j) for j in range(cols)] for i in range(rows)]).reshape(rows, cols)
    return (2 * unit - 1) * math.sqrt(6 / (rows + cols))


def projected(nodes: DataFrame, weights: np.ndarray) -> DataFrame:
    """``node, feat`` times a matrix too wide for an expression; features must be as long as it has rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"node": b["node"], "feat": list(np.stack(b["feat"].to_numpy()).astype(float) @ weights)})

    return nodes.select("node", "feat").mapInPandas(run, "node long, feat array<double>")


def random_embedding(nodes: DataFrame, edges: DataFrame, backbone: str = "GCN", width: int = 128, seed: int = 0) -> DataFrame:
    """``node, feat``: one untrained layer of the backbone with seeded weights, each row over its norm.

    A node that nothing reaches has zeros, but for SAGE, whose root term remains.  No nodes give no rows.
    """
    if backbone not in ("GCN", "SAGE", "GAT"):
        raise ValueError("backbone must be GCN, SAGE or GAT")
    first = nodes.select(F.size("feat")).first()
    if first is None:
        return nodes.select("node", F.col("feat").cast("array<double>").alias("feat"))
    matrix = lambda k: hashed_weights(first[0], width, seed, k)
    h = projected(nodes, matrix(0))
    if backbone == "GCN":
        out = gcn_layer(h, edges, None, width)
    elif backbone == "GAT":
        left, right = (hashed_weights(1, width, seed, k)[0].tolist() for k in (1, 2))
        out = gat_layer(h, edges, None, left, right)
    else:
        out = h.join(_mean_in(projected(nodes, matrix(1)), edges, width), "node").select("node", plus(F.col("feat"), F.col("mean")).alias("feat"))
    return out.select("node", l2_normalise("feat").alias("feat"))


def class_count(nodes: DataFrame) -> DataFrame:
    """One row ``classes`` of the original label space."""
    return nodes.agg((F.coalesce(F.max("label"), F.lit(-1)) + 1).cast("long").alias("classes"))


def scores(predicted: DataFrame) -> DataFrame:
    """One row ``macro_f1, accuracy`` of ``label, pred`` rows; classes are those of either; NaN for no row."""
    cells = predicted.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))
    ends = cells.select(F.col("label").alias("c"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"))
    ends = ends.union(cells.select("pred", F.lit(0).cast("long"), F.lit(0).cast("long"), "n"))
    per = ends.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    nan = F.lit(float("nan"))
    return per.agg(F.coalesce(F.avg(2 * F.col("tp") / (F.col("t") + F.col("p"))), nan).alias("macro_f1"), F.coalesce(F.sum("tp") / F.sum("t"), nan).alias("accuracy"))
