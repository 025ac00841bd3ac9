"""Graphs over the driver's tables: similar vectors (sim), customers and suppliers (trade), users one after another (flow)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import Graph
from ..operators.similarity import similar_pairs

EVENT_TYPES = 5


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _members(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.toDF("community", "node").distinct()


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("feat"), F.col("label").cast("int").alias("label"))


def sim(spark: SparkSession, sf_dir: str) -> Graph:
    nodes = vectors(spark, sf_dir)
    edges = similar_pairs(nodes, 0.3).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    by_id = nodes.select((F.col("node") % 25).cast("long"), "node")
    by_label = nodes.where("node % 4 = 0").select((F.col("label") + 25).cast("long"), "node")
    return Graph(nodes, edges, _members(by_id, by_label))


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    c, s = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    orders, items = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    supplier = F.col("s_suppkey") + 1000000
    nodes = c.select(F.col("c_custkey").alias("node"), F.array("c_acctbal").alias("feat"), F.col("c_nationkey").cast("int").alias("label"))
    nodes = nodes.union(s.select(supplier, F.array("s_acctbal"), F.col("s_nationkey").cast("int")))
    edges = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_suppkey") + 1000000).alias("dst")).distinct()
    m = _members(
        c.select(F.col("c_nationkey").cast("long"), "c_custkey"), s.select((F.col("s_nationkey") + 25).cast("long"), supplier),
        c.where("c_custkey % 2 = 0").select((F.col("c_custkey") % 5 + 50).cast("long"), "c_custkey"),
    )
    return Graph(nodes, edges, m)


def flow(spark: SparkSession, sf_dir: str) -> Graph:
    """One order over all events is the fixture's definition, so this window has a single partition."""
    e = _t(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    before = F.lag("user_id").over(Window.orderBy("ts", "event_id"))
    edges = e.select(before.alias("src"), F.col("user_id").alias("dst")).where("src is not null")
    kind = F.dense_rank().over(Window.orderBy("event_type")) - 1
    kinds = e.select("event_type").distinct().withColumn("k", kind)
    counts = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(kinds), "event_type")
    feat = F.array(*[F.sum(F.when(F.col("k") == i, F.col("n")).otherwise(0)).cast("double") for i in range(EVENT_TYPES)])
    most = F.max_by("k", F.struct("n", -F.col("k"))).cast("int")
    nodes = counts.groupBy("user_id").agg(feat.alias("feat"), most.alias("label")).withColumnRenamed("user_id", "node")
    users = e.select(F.col("user_id").alias("u")).distinct()
    m = _members(users.select((F.col("u") % 16).cast("long"), "u"), users.where("u % 3 = 0").select((F.col("u") % 5 + 16).cast("long"), "u"))
    return Graph(nodes, edges, m)


GRAPHS = {"sim": sim, "trade": trade, "flow": flow}

#: DuckDB: common table expressions ``nodes(node, feat, label)``, ``edges(src, dst)``, ``m(c, n)`` of the same graphs.
SQL = {
    "sim": """
emb as (select vec_id, cast(embedding as double[]) x, label from embeddings),
nodes as (select vec_id node, x feat, label from emb),
edges as (select a.vec_id src, b.vec_id dst from emb a, emb b where a.vec_id <> b.vec_id and list_cosine_similarity(a.x, b.x) >= 0.3),
m as (select distinct c, n from (select cast(vec_id % 25 as bigint) c, vec_id n from emb union all select cast(25 + label as bigint), vec_id from emb where vec_id % 4 = 0))""",
    "trade": """
nodes as (select c_custkey node, [c_acctbal] feat, c_nationkey label from customer union all select 1000000 + s_suppkey, [s_acctbal], s_nationkey from supplier),
edges as (select distinct o_custkey src, 1000000 + l_suppkey dst from lineitem join orders on o_orderkey = l_orderkey),
m as (select distinct c, n from (select cast(c_nationkey as bigint) c, c_custkey n from customer union all select cast(25 + s_nationkey as bigint), 1000000 + s_suppkey from supplier
  union all select cast(50 + c_custkey % 5 as bigint), c_custkey from customer where c_custkey % 2 = 0))""",
    "flow": """
kinds as (select event_type, row_number() over (order by event_type) - 1 k from (select distinct event_type from events)),
cnt as (select user_id, k, count(*) n from events join kinds using (event_type) group by user_id, k),
nodes as (select user_id node, [cast(coalesce(sum(n) filter (k = 0), 0) as double), cast(coalesce(sum(n) filter (k = 1), 0) as double), cast(coalesce(sum(n) filter (k = 2), 0) as double),
  cast(coalesce(sum(n) filter (k = 3), 0) as double), cast(coalesce(sum(n) filter (k = 4), 0) as double)] feat, cast(arg_max(k, n * 100 - k) as int) label from cnt group by user_id),
edges as (select src, dst from (select lag(user_id) over (order by ts, event_id) src, user_id dst from events) where src is not null),
m as (select distinct c, n from (select user_id % 16 c, user_id n from events union all select 16 + user_id % 5, user_id from events where user_id % 3 = 0))""",
}
