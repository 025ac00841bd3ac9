"""Durable intermediate results for iterative programs."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The checkpoint folder.  Where the session has none, as in local tests, a temporary one is set."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="terrane-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut at a reliable checkpoint in ``spark.checkpoint.dir``."""
    _folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the checkpoint folder, for tables of edges: some bytes a row, where a checkpoint takes tens.

    The shuffles behind it are let go.
    """
    path = f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release_shuffles(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the driver collects the plans that made them; ask for it between large steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
