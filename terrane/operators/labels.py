"""Mapped labels of communities by votes of their members."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def majority(rows: DataFrame, key: str = "community") -> DataFrame:
    """``key, label``: the most frequent label, the smallest on ties.  Votes are counted map-side before they meet."""
    votes = rows.groupBy(key, "label").agg(F.count(F.lit(1)).alias("q"))
    return votes.groupBy(key).agg(F.max_by("label", F.struct(F.col("q"), -F.col("label").cast("long"))).alias("label"))


def elbows(dist: DataFrame) -> DataFrame:
    """``community, threshold``: the distance just below the widest gap between sorted distances (first on ties); null for
    one member."""
    order = Window.partitionBy("community").orderBy("distance", "node")
    gaps = dist.withColumn("gap", F.lead("distance").over(order) - F.col("distance")).withColumn("r", F.row_number().over(order))
    best = F.max_by("distance", F.when(F.col("gap").isNotNull(), F.struct(F.col("gap"), -F.col("r"))))
    return gaps.groupBy("community").agg(best.alias("threshold"))


def voters(dist: DataFrame) -> DataFrame:
    """The rows of ``dist`` within their community's threshold."""
    near = dist.join(elbows(dist), "community")
    return near.where(F.col("threshold").isNull() | (F.col("distance") <= F.col("threshold"))).drop("threshold")


def label_by_threshold(dist: DataFrame) -> DataFrame:
    return majority(voters(dist))


def two_means(x: np.ndarray, rounds: int = 50) -> np.ndarray:
    """0/1 cluster of each row by Lloyd's algorithm from the two rows farthest from the mean and from each other."""
    a = x[np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1))]
    b = x[np.argmax(((x - a) ** 2).sum(axis=1))]
    centers, of = np.stack([a, b]), None
    for _ in range(rounds):
        now = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        if of is not None and (now == of).all():
            break
        of = now
        for k in (0, 1):
            if (of == k).any():
                centers[k] = x[of == k].mean(axis=0)
    return of


def label_by_two_means(rows: DataFrame) -> DataFrame:
    """``community, label``: majority in the larger of two clusters of the members (ties: the first); all vote below two."""

    def vote(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        if len(pdf) > 1:
            of = two_means(np.stack(pdf["feat"].to_numpy()).astype(float))
            pdf = pdf[of == int((of == 1).sum() > (of == 0).sum())]
        top = pdf["label"].value_counts()
        return pd.DataFrame({"community": [pdf["community"].iloc[0]], "label": [int(top[top == top.max()].index.min())]})

    return rows.select("community", "node", "feat", "label").groupBy("community").applyInPandas(vote, "community long, label int")
