"""Structural reports on a partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_COMMUNITIES = 8


def size_stats(sizes: DataFrame) -> DataFrame:
    """One row over ``community, size``: communities, smallest, median, mean, largest, singletons."""
    return sizes.agg(
        F.count(F.lit(1)).alias("communities"), F.min("size").alias("smallest"), F.expr("cast(percentile(size, 0.5) as double)").alias("median"),
        F.avg("size").alias("mean"), F.max("size").alias("largest"), F.count_if(F.col("size") == 1).alias("singletons"), F.count_if(F.col("size") <= 2).alias("up_to_two"),
    )


def _sizes(membership: DataFrame) -> DataFrame:
    return membership.groupBy("community").agg(F.count_distinct("node").alias("size"))


def _counts(membership: DataFrame) -> DataFrame:
    return membership.distinct().groupBy("node").agg(F.count(F.lit(1)).alias("k"))


def summary(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: sizes, coverage, compression, memberships of covered nodes, share of overlapping nodes."""
    n = nodes.agg(F.count_distinct("node").alias("nodes"))
    per = _counts(membership).join(nodes.select("node").distinct(), "node", "left_semi")
    c = per.agg(F.count(F.lit(1)).alias("covered"), F.avg("k").alias("memberships_mean"), F.coalesce(F.max("k"), F.lit(0)).alias("memberships_max"), F.count_if(F.col("k") > 1).alias("overlapping"))
    out = size_stats(_sizes(membership)).crossJoin(c).crossJoin(n)
    share = lambda a: F.when(F.col("nodes") > 0, F.col(a) / F.col("nodes")).otherwise(F.lit(0.0))
    return out.select("*", (F.col("nodes") - F.col("covered")).alias("uncovered"), share("covered").alias("coverage"), share("communities").alias("compression"), share("overlapping").alias("overlapping_fraction"))


def overlap_histogram(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """``bucket, nodes``: nodes in 0 to 5 communities, and ``6+``; empty buckets too."""
    k = nodes.select("node").distinct().join(_counts(membership), "node", "left").select(F.least(F.coalesce("k", F.lit(0)), F.lit(6)).cast("int").alias("k"))
    buckets = nodes.sparkSession.range(7).select(F.col("id").cast("int").alias("b"))
    got = buckets.join(k, F.col("b") == F.col("k"), "left").groupBy("b").agg(F.count("k").alias("nodes"))
    return got.select(F.when(F.col("b") == 6, F.lit("6+")).otherwise(F.col("b").cast("string")).alias("bucket"), "nodes")


def overlap_log(membership: DataFrame) -> DataFrame:
    """``communities, nodes``: nodes in 1, 2, 3, 4, and 5 or more communities, where there are any."""
    return _counts(membership).groupBy(F.least("k", F.lit(5)).cast("int").alias("communities")).agg(F.count(F.lit(1)).alias("nodes"))


def label_purity(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """One row ``purity``: mean over communities of the share of their commonest label."""
    rows = membership.distinct().join(nodes.select("node", "label"), "node")
    votes = rows.groupBy("community", "label").agg(F.count(F.lit(1)).alias("q"))
    return votes.groupBy("community").agg((F.max("q") / F.sum("q")).alias("p")).agg(F.avg("p").alias("purity"))


def primary(nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """``node, community``: the lowest id, -1 for none."""
    low = membership.groupBy("node").agg(F.min("community").alias("community"))
    return nodes.select("node").join(low, "node", "left").select("node", F.coalesce("community", F.lit(-1).cast("long")).alias("community"))


def modularity(assigned: DataFrame, undirected: DataFrame) -> DataFrame:
    """One row ``modularity`` of ``node, community`` (negative: none) over ``u, v`` edges; NaN without edges."""
    a = assigned.where("community >= 0")
    e = undirected.join(a.toDF("u", "cu"), "u").join(a.toDF("v", "cv"), "v").select("cu", "cv")
    ends = F.explode(F.array(F.struct(F.col("cu").alias("c"), (F.col("cu") == F.col("cv")).cast("int").alias("i")), F.struct(F.col("cv").alias("c"), F.lit(0).alias("i")))).alias("x")
    per = e.select(ends).groupBy("x.c").agg(F.count(F.lit(1)).alias("vol"), F.sum("x.i").alias("inside"))
    # sum of inside / m - (volume / 2m)^2, with 2m the sum of volumes
    t = per.agg(F.sum("inside").alias("i"), F.sum("vol").cast("double").alias("v"), F.sum(F.col("vol").cast("double") * F.col("vol")).alias("q"))
    return t.select(F.when(F.col("v") > 0, F.col("i") / (F.col("v") / 2) - F.col("q") / (F.col("v") * F.col("v"))).otherwise(F.lit(float("nan"))).alias("modularity"))


def health(report: DataFrame, min_communities: int = MIN_COMMUNITIES) -> DataFrame:
    """One row ``healthy, too_few, uncovered``: a partition needs enough communities and every node in one."""
    few, open_ = F.col("communities") < min_communities, F.col("coverage") < 1.0
    return report.select((~few & ~open_).alias("healthy"), few.alias("too_few"), open_.alias("uncovered"))


def content_hash(membership: DataFrame) -> DataFrame:
    """One row ``hash``: 16 hex digits that depend only on the set of memberships; rows are hashed and summed where they are."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", "community", "node").cast("binary"), 256), 1, 14), 16, 10).cast("decimal(38,0)")
    total = membership.distinct().agg(F.sum(h).alias("s"), F.count(F.lit(1)).alias("n"))
    return total.select(F.substring(F.sha2(F.concat_ws(":", "n", F.coalesce("s", F.lit(0))).cast("binary"), 256), 1, 16).alias("hash"))


def describe(report: dict) -> str:
    """A text block from the summary row."""
    width = max(map(len, report))
    return "\n".join(f"{k.replace('_', ' '):<{width}}  {v:.4f}" if isinstance(v, float) else f"{k.replace('_', ' '):<{width}}  {v}" for k, v in report.items())
