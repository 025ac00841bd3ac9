"""A feed of deletion requests, applied to the stored membership a micro-batch at a time (an extension).

Each micro-batch removes its nodes from the newest version of the membership and writes the next version; versions are
numbered by batch, so a batch that is run again after a failure overwrites its own version and nothing is applied twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.unlearn import remove_nodes

SCHEMA = "node long, request_id string"


def version_path(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/version={version}"


def latest(spark: SparkSession, root: str, below: int | None = None) -> tuple[int, DataFrame]:
    """(version, membership) of the newest version, or of the newest below a number."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if s.getPath().getName().startswith("version=")]
    newest = max(v for v in found if below is None or v < below)
    return newest, spark.read.parquet(version_path(root, newest))


def apply_feed(spark: SparkSession, requests_path: str, root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start the feed; ``version=0`` under ``root`` is the membership to begin with."""

    def batch(requests: DataFrame, number: int) -> None:
        _, membership = latest(spark, root, below=number + 1)
        after, _ = remove_nodes(membership, requests.where("node is not null"))
        after.write.mode("overwrite").parquet(version_path(root, number + 1))

    stream = spark.readStream.schema(SCHEMA).json(requests_path)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
