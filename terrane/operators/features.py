"""Mapped features of communities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import euclidean
from .graph import _vector_sum, to_vectors

PCA_ABOVE = 20  # members; smaller communities use the mean
PCA_SHARE = 0.05
EPS = 1e-12


def members(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """``community, node, feat, label``, once for each member."""
    return membership.distinct().join(nodes.select("node", "feat", "label"), "node").select("community", "node", "feat", "label")


def mean_features(rows: DataFrame) -> DataFrame:
    """``community, feat``: element-wise mean of the members' features; summed map-side by position."""
    sums = _vector_sum(rows, "community", "feat")
    size = rows.groupBy("community").agg(F.count(F.lit(1)).alias("k"))
    return to_vectors(sums, "community").join(size, "community").select("community", F.transform("feat", lambda x: x / F.col("k")).alias("feat"))


def pca_feature(x: np.ndarray, share: float = PCA_SHARE) -> np.ndarray:
    """Mean, for each feature dimension, of its coordinates on the leading ``ceil(share * members)`` components.

    Samples are the feature dimensions and variables the members.  A component's sign is that its entry of largest size is
    positive (ties: the first member), since the mean depends on it.
    """
    members_, width = x.shape
    k = min(max(1, int(np.ceil(share * members_))), width)
    z = x.T - x.T.mean(axis=0)
    _, _, axes = np.linalg.svd(z, full_matrices=False)
    axes = axes[:k]
    at = np.argmax(np.round(np.abs(axes), 12), axis=1)
    axes = axes * np.where(axes[np.arange(len(axes)), at] < 0, -1.0, 1.0)[:, None]
    return (z @ axes.T).mean(axis=1)


def pca_features(rows: DataFrame, above: int = PCA_ABOVE, share: float = PCA_SHARE) -> DataFrame:
    """``community, feat``: mean for communities of up to ``above`` members, :func:`pca_feature` for larger ones.

    A community's members meet in one task there, as the decomposition needs them; communities are bounded by the size cap.
    """
    size = rows.groupBy("community").agg(F.count(F.lit(1)).alias("k"))
    sized = rows.join(size, "community")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        feat = pca_feature(np.stack(pdf["feat"].to_numpy()).astype(float), share)
        return pd.DataFrame({"community": [pdf["community"].iloc[0]], "feat": [feat]})

    small = mean_features(sized.where(F.col("k") <= above).drop("k"))
    large = sized.where(F.col("k") > above).select("community", "node", "feat").groupBy("community").applyInPandas(fit, "community long, feat array<double>")
    return small.union(large)


def distances(rows: DataFrame, features: DataFrame) -> DataFrame:
    """``community, node, label, distance`` of each member to its community's feature."""
    return rows.join(features.withColumnRenamed("feat", "center"), "community").select("community", "node", "label", euclidean("feat", "center").alias("distance"))


def feature_robustness(dist: DataFrame) -> DataFrame:
    """``community, robustness``: members over the sum of distances (at least a tiny number)."""
    return dist.groupBy("community").agg((F.count(F.lit(1)) / F.greatest(F.sum("distance"), F.lit(EPS))).alias("robustness"))


def robust_features(features: DataFrame, robustness: DataFrame) -> DataFrame:
    """Features times ``1 + 0.1 * exp(-robustness)``."""
    return features.join(robustness, "community").select("community", F.transform("feat", lambda x: x * (1 + 0.1 * F.exp(-F.col("robustness")))).alias("feat"))


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same communities."""
    return old.join(new.select("community"), "community", "left_anti").select(*new.columns).union(new)


def energy(dist: DataFrame) -> DataFrame:
    """``community, energy``: sum of the members' distances to the feature."""
    return dist.groupBy("community").agg(F.sum("distance").alias("energy"))
