"""Readers of graph files, and the artifact store of runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators.graph import degrees, nodes_of

ARTIFACTS = ("membership", "mapped_nodes", "mapped_edges", "masks", "graph_nodes", "graph_edges", "request", "reindex", "embedding", "weights", "posteriors", "params", "summary", "train_masks", "record")


def read_edges_csv(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst`` from the first two columns of a CSV file with a header."""
    raw = spark.read.csv(path, header=True)
    return raw.select(F.col(raw.columns[0]).cast("long").alias("src"), F.col(raw.columns[1]).cast("long").alias("dst"))


def dense_features(triples: DataFrame, width: int | None = None) -> DataFrame:
    """``node, feat`` from ``node_id, feature_id, value`` triples; repeated triples add up, absent ones are 0."""
    rows = triples.groupBy("node_id", "feature_id").agg(F.sum("value").alias("value"))
    width = width if width is not None else (triples.agg(F.max("feature_id")).first()[0] or 0) + 1
    packed = rows.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("feature_id").cast("int"), "value"))).alias("m"))
    feat = F.transform(F.sequence(F.lit(0), F.lit(int(width) - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    return packed.select(F.col("node_id").alias("node"), feat.alias("feat"))


def read_features_csv(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    schema = "node_id long, feature_id int, value double"
    return dense_features(spark.read.csv(path, header=True, schema=schema), width)


def read_target_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=False).select(F.col("target").cast("int").alias("target"))


def graph_from_edges(edges: DataFrame) -> Graph:
    """Nodes are the ends of edges."""
    return Graph(nodes_of(edges), edges)


def read_graph(spark: SparkSession, nodes_path: str, edges_path: str) -> Graph:
    return Graph(spark.read.parquet(nodes_path), spark.read.parquet(edges_path))


def degree_features(nodes: DataFrame, adj: DataFrame, width: int) -> DataFrame:
    """``node, feat``: one-hot of the degree, the last position for all degrees from ``width - 1`` up."""
    at = F.least("degree", F.lit(width - 1))
    return degrees(nodes, adj).select("node", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i == at).cast("double")).alias("feat"))


class ArtifactStore:
    """Tables of runs as Parquet under ``root/kind/run_id=...``; the run id holds the seed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, kind: str, run_id: str) -> str:
        if kind not in ARTIFACTS:
            raise ValueError(f"kind must be one of {ARTIFACTS}")
        return f"{self.root}/{kind}/run_id={run_id}"

    def save(self, kind: str, run_id: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(kind, run_id))
        return self.load(kind, run_id)

    def load(self, kind: str, run_id: str) -> DataFrame:
        return self.spark.read.parquet(self.path(kind, run_id))

    def under(self, name: str) -> ArtifactStore:
        """The store of one dataset."""
        return ArtifactStore(self.spark, f"{self.root}/{name}")

    def has(self, kind: str, run_id: str) -> bool:
        """Whether a whole table is there; a write that was cut short doesn't count."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(kind, run_id) + "/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def runs(self, kind: str) -> DataFrame:
        """All runs' rows of one kind, with their ``run_id``."""
        return self.spark.read.parquet(f"{self.root}/{kind}")


def write_metrics(spark: SparkSession, path: str | None, metrics: dict) -> None:
    """One JSON line; nothing without a path."""
    if path:
        spark.createDataFrame([(json.dumps(metrics, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("append").text(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
