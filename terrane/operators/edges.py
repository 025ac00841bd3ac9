"""Edges between communities: counts, robustness-scored weights, thresholds, the mapped graph."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..durable import durable
from ..functions.vectors import cosine
from .graph import dense_index

REDUCTIONS = ("source", "max")
METHODS = (0, 1, 2, 3)


def edge_counts(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """``src_c, dst_c, n``: directed edges between different communities, an edge once for each pair of memberships.

    Repeated edges are summed before the joins, so a hub's edges don't multiply with its memberships more than once.
    """
    pre = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))
    a = membership.select(F.col("community").alias("src_c"), F.col("node").alias("src"))
    b = membership.select(F.col("community").alias("dst_c"), F.col("node").alias("dst"))
    return pre.join(a, "src").join(b, "dst").where("src_c <> dst_c").groupBy("src_c", "dst_c").agg(F.sum("w").alias("n"))


def community_degrees(counts: DataFrame) -> DataFrame:
    """``community, out_degree, in_degree`` of communities with an edge."""
    ends = counts.select(F.col("src_c").alias("community"), F.col("n").alias("o"), F.lit(0).cast("long").alias("i"))
    ends = ends.union(counts.select("dst_c", F.lit(0).cast("long"), "n"))
    return ends.groupBy("community").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def sizes(membership: DataFrame) -> DataFrame:
    return membership.groupBy("community").agg(F.count_distinct("node").alias("size"))


def intersections(membership: DataFrame, pairs: DataFrame) -> DataFrame:
    """``lo, hi, both`` for pairs of communities that share nodes and are among ``pairs(lo, hi)``."""
    m = membership.distinct()
    a, b = (m.select(F.col("community").alias(x), "node") for x in ("lo", "hi"))
    return a.join(b, "node").where("lo < hi").groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("both")).join(pairs, ["lo", "hi"], "left_semi")


def union_sizes(membership: DataFrame, pairs: DataFrame) -> DataFrame:
    """``lo, hi, union``: nodes in either community, for each of the pairs."""
    s = sizes(membership)
    out = pairs.join(s.toDF("lo", "sa"), "lo").join(s.toDF("hi", "sb"), "hi").join(intersections(membership, pairs), ["lo", "hi"], "left")
    return out.select("lo", "hi", (F.col("sa") + F.col("sb") - F.coalesce("both", F.lit(0))).alias("union"))


def robustness(s: Column, out_degree: Column, in_degree: Column, method: int) -> Column:
    """0: s over the root of both degrees; 1: logarithms, sum of degrees; 2: logarithms, root of degrees; 3: none."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    l, lo, li = (F.log1p(x.cast("double")) for x in (s, out_degree, in_degree))
    term = {0: lambda: (s / F.sqrt(out_degree)) * (s / F.sqrt(in_degree)), 1: lambda: l / (lo + li), 2: lambda: (l / F.sqrt(lo)) * (l / F.sqrt(li)), 3: lambda: F.lit(0.0)}[method]()
    return F.when((out_degree > 0) & (in_degree > 0), term).otherwise(F.lit(0.0))


def unordered_pairs(counts: DataFrame) -> DataFrame:
    return counts.where("src_c <> dst_c").select(F.least("src_c", "dst_c").alias("lo"), F.greatest("src_c", "dst_c").alias("hi")).distinct()


def pair_counts(counts: DataFrame, reduction: str) -> DataFrame:
    """``lo, hi, s``: the count from lo to hi (``source``) or the larger of both directions (``max``), where positive."""
    if reduction not in REDUCTIONS:
        raise ValueError(f"reduction must be one of {REDUCTIONS}")
    forward = F.col("src_c") < F.col("dst_c")
    rows = counts.select(F.least("src_c", "dst_c").alias("lo"), F.greatest("src_c", "dst_c").alias("hi"), F.when(forward | F.lit(reduction == "max"), F.col("n")).otherwise(0).alias("n"))
    return rows.groupBy("lo", "hi").agg(F.max("n").alias("s")).where("s > 0")


def score_edges(counts: DataFrame, membership: DataFrame, method: int = 2, reduction: str = "source", with_jaccard: bool = True) -> DataFrame:
    """``src_c, dst_c, score`` in both directions: robustness term plus count over the size of the union; zeros left out."""
    pairs = pair_counts(counts, reduction)
    d = community_degrees(counts)
    out = pairs.join(d.select(F.col("community").alias("lo"), "out_degree"), "lo", "left").join(d.select(F.col("community").alias("hi"), "in_degree"), "hi", "left")
    out = out.join(union_sizes(membership, pairs.select("lo", "hi")), ["lo", "hi"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = robustness(F.col("s"), zero("out_degree"), zero("in_degree"), method)
    if with_jaccard:
        score = score + F.col("s") / F.col("union").cast("double")
    return both_ways(out.select("lo", "hi", score.alias("score")).where("score <> 0"))


def both_ways(pairs: DataFrame) -> DataFrame:
    ways = F.explode(F.array(F.struct(F.col("lo").alias("src_c"), F.col("hi").alias("dst_c")), F.struct(F.col("hi").alias("src_c"), F.col("lo").alias("dst_c")))).alias("e")
    return pairs.select(ways, "score").select("e.src_c", "e.dst_c", "score")


def jaccard_ordered(counts: DataFrame, membership: DataFrame) -> DataFrame:
    """``src_c, dst_c, score``: each directed count over the union's size."""
    u = union_sizes(membership, unordered_pairs(counts))
    out = counts.select("*", F.least("src_c", "dst_c").alias("lo"), F.greatest("src_c", "dst_c").alias("hi")).join(u, ["lo", "hi"])
    return out.select("src_c", "dst_c", (F.col("n") / F.col("union").cast("double")).alias("score"))


def jaccard_symmetric(counts: DataFrame, membership: DataFrame) -> DataFrame:
    return score_edges(counts, membership, method=3, reduction="source")


def pair_cosines(counts: DataFrame, features: DataFrame) -> DataFrame:
    """``src_c, dst_c, n, cosine`` of the mapped features, for observed directed pairs only."""
    a, b = (features.select(F.col("community").alias(f"{x}_c"), F.col("feat").alias(f"f_{x}")) for x in ("src", "dst"))
    return counts.join(a, "src_c").join(b, "dst_c").select("src_c", "dst_c", "n", cosine("f_src", "f_dst").alias("cosine"))


def fitted_weights(counts: DataFrame, features: DataFrame, steps: int = 1000, rate: float = 0.01) -> DataFrame:
    """``src_c, dst_c, score``: minimises (w - n)^2 + (w - cosine)^2 by ``steps`` of Adam from 0; 0 steps give the optimum.

    Weights don't depend on one another, so the optimiser is a fold over its steps in each row, within the JVM.
    """
    rows = pair_cosines(counts, features)
    if not steps:
        return rows.select("src_c", "dst_c", ((F.col("n") + F.col("cosine")) / 2).alias("score")).where("score <> 0")

    def step(s: Column, t: Column) -> Column:
        g = 2 * (s["w"] - F.col("n")) + 2 * (s["w"] - F.col("cosine"))
        m, v = 0.9 * s["m"] + 0.1 * g, 0.999 * s["v"] + 0.001 * g * g
        w = s["w"] - rate * (m / (1 - F.pow(F.lit(0.9), t))) / (F.sqrt(v / (1 - F.pow(F.lit(0.999), t))) + 1e-8)
        return F.struct(w.alias("w"), m.alias("m"), v.alias("v"))

    zero = F.lit(0.0)
    fold = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(zero.alias("w"), zero.alias("m"), zero.alias("v")), step, lambda s: s["w"])
    return rows.select("src_c", "dst_c", fold.cast("float").cast("double").alias("score")).where("score <> 0")


def score_threshold(scores: DataFrame, share: float) -> DataFrame:
    """One row ``threshold``: 0 if share < 0; else the lower score at the widest gap among all scores (share 0) or among the
    top ``floor(share * rows)`` + 1 of them.  One or no score: 0.

    Distinct scores may be as many as linked community pairs: they are sorted in ranges, sums and gaps are found within ranges,
    and only a row for each range meets the others.
    """
    spark = scores.sparkSession
    if share < 0:
        return spark.range(1).select(F.lit(0.0).alias("threshold"))
    values = scores.groupBy("score").agg(F.count(F.lit(1)).alias("k")).repartitionByRange(F.desc("score")).sortWithinPartitions(F.desc("score"))
    values = durable(values.withColumn("__p", F.spark_partition_id()))
    ranges = values.groupBy("__p").agg(F.sum("k").alias("__k"), F.max("score").alias("__top"))
    over = Window.orderBy("__p")  # a row for each range
    ranges = ranges.select("__p", (F.sum("__k").over(over) - F.col("__k")).alias("__before"), F.lead("__top").over(over).alias("__below"), F.sum("__k").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    down = Window.partitionBy("__p").orderBy(F.desc("score"))
    ranked = values.join(F.broadcast(ranges), "__p").withColumn("upto", F.sum("k").over(down) + F.col("__before")).withColumn("lower", F.coalesce(F.lead("score").over(down), F.col("__below")))
    gaps = ranked.where("lower is not null").withColumn("gap", F.col("score") - F.col("lower"))
    if share > 0:
        gaps = gaps.where(F.col("upto") <= F.greatest(F.floor(F.col("n") * share), F.lit(1)))  # the lower score's rank
    return gaps.agg(F.coalesce(F.max_by("lower", F.struct(F.col("gap"), -F.col("lower"))), F.lit(0.0)).alias("threshold"))


def mapped_graph(scores: DataFrame, mapped_nodes: DataFrame, threshold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): edges whose score reaches the threshold, and the mapped nodes as they are."""
    kept = scores.crossJoin(F.broadcast(threshold)).where("score >= threshold").select("src_c", "dst_c", "score")
    return mapped_nodes, kept


def drop_unreached(mapped_nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without an edge into them go, once; edges that touched them go; ids become dense ranks."""
    kept = mapped_nodes.join(edges.select(F.col("dst_c").alias("community")).distinct(), "community", "left_semi")
    index = dense_index(kept, "community", "new_c")
    nodes = kept.join(index, "community").drop("community").withColumnRenamed("new_c", "community")
    e = edges.join(index.toDF("src_c", "s"), "src_c").join(index.toDF("dst_c", "d"), "dst_c").select(F.col("s").alias("src_c"), F.col("d").alias("dst_c"), "score")
    return nodes.select("community", *[c for c in mapped_nodes.columns if c != "community"]), e


def adam_closed(n: float, cosine_: float, steps: int = 1000, rate: float = 0.01) -> float:
    """The fold of :func:`fitted_weights` for one pair, in plain Python; for tests."""
    w = m = v = 0.0
    for t in range(1, steps + 1):
        g = 2 * (w - n) + 2 * (w - cosine_)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (math.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w
