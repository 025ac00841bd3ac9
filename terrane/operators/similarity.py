"""All-pairs vector similarity and exact nearest neighbours, block against block.

Vectors are dealt into blocks of a bounded size; every pair of blocks is one group whose matrix product runs in numpy, so a
task holds two blocks whatever the table's size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_ROWS = 2048


def _block_pairs(left: DataFrame, right: DataFrame, block_rows: int) -> DataFrame:
    """Rows ``i, j, side, node, feat``: each left block beside each right block."""
    n, m = (max(1, -(-df.count() // block_rows)) for df in (left, right))
    deal = lambda df, k: F.pmod(F.xxhash64("node"), F.lit(k)).cast("int")
    l = left.select(deal(left, n).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("j"), F.lit(0).alias("side"), "node", "feat")
    r = right.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), deal(right, m).alias("j"), F.lit(1).alias("side"), "node", "feat")
    return l.union(r.select("i", "j", "side", "node", "feat"))


def _sides(pdf: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for side in (0, 1):
        part = pdf[pdf["side"] == side].sort_values("node", kind="stable")
        out.append((part["node"].to_numpy(), np.stack(part["feat"].to_numpy()).astype(float) if len(part) else np.zeros((0, 0))))
    return out


def similar_pairs(nodes: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``a, b, cosine`` of ordered pairs of different nodes with a cosine of at least ``threshold``, in double precision."""

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        (a, x), (b, y) = _sides(pdf)
        if within := pdf["i"].iloc[0] == pdf["j"].iloc[0]:
            b, y = a, x
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        sim = (x @ y.T) / np.maximum(np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :], 1e-300)
        i, j = np.nonzero((sim >= threshold) & (a[:, None] != b[None, :]))
        one, other, cosine = a[i], b[j], sim[i, j]
        if within:
            return pd.DataFrame({"a": one, "b": other, "cosine": cosine})
        return pd.DataFrame({"a": np.concatenate([one, other]), "b": np.concatenate([other, one]), "cosine": np.concatenate([cosine, cosine])})

    known = nodes.where("feat is not null")
    n = max(1, -(-known.count() // block_rows))
    # Each pair of blocks once, the lower as side 0; a block beside itself is side 0 alone.
    own = known.select(F.pmod(F.xxhash64("node"), F.lit(n)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"), "node", "feat")
    pairs = own.select(F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), (F.col("own") > F.col("k")).cast("int").alias("side"), "node", "feat")
    return pairs.groupBy("i", "j").applyInPandas(product, "a long, b long, cosine double")


def nearest(queries: DataFrame, nodes: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``node, neighbour, distance, rank`` of the k nearest other nodes of each query (Euclidean; ties: smaller id)."""

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        (a, x), (b, y) = _sides(pdf)
        out = []
        for q, v in zip(a, x):
            if len(b):
                d = np.sqrt(((y - v) ** 2).sum(axis=1))
                keep = [t for t in np.lexsort((b, d))[: k + 1] if b[t] != q][:k]
                out += [(q, b[t], d[t]) for t in keep]
        return pd.DataFrame(out, columns=["node", "neighbour", "distance"])

    near = _block_pairs(queries.where("feat is not null"), nodes.where("feat is not null"), block_rows).groupBy("i", "j").applyInPandas(product, "node long, neighbour long, distance double")
    rank = F.row_number().over(Window.partitionBy("node").orderBy("distance", "neighbour"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)
