"""Shared plumbing of the corpus operators: the shared folder, written intermediates, words, ranks.

Intermediates that several jobs read are written as Parquet under ``spark.checkpoint.dir``, which every executor
sees; no operator keeps state in an executor's own folder, so a lost executor costs only a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..durable import release_shuffles

#: Word pattern of the contracts: runs without ASCII white space.  ``bytes.split()`` cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of text in one Arrow batch; with very long texts a batch stays some tens of MB.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``; a temporary one in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        path = "file://" + tempfile.mkdtemp(prefix="terrane-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    """(FileSystem, Path) of the JVM for a path of any scheme."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and later jobs do not redo the work."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """:func:`materialize`, and let Spark drop the shuffles behind it."""
    out = materialize(df, name)
    release_shuffles(df.sparkSession)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from :func:`materialize` that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}:
        delete_path(tables[0].sparkSession, path)


def forget(*tables: DataFrame) -> None:
    """:func:`discard` tables, and let Spark drop old shuffles."""
    discard(*tables)
    release_shuffles(tables[0].sparkSession)


def text_batches(spark: SparkSession) -> None:
    """Bound Arrow batches for plans that move whole texts to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def ranked(df: DataFrame, group: list[str], bucket: Column, order: list[Column], rank: str, total: str | None = None) -> DataFrame:
    """Add the 0-based ``rank`` of each row within ``group`` without gathering a group in one task.

    ``bucket`` is a small integer that never falls as ``order`` grows (at most some thousands of values), so a hot group
    is spread over its buckets: rows are counted by bucket, counts are summed up over buckets, and only the rows of one
    bucket are sorted together.  Group columns must not be null.  ``total`` names a column for the group's row count.
    """
    df = df.withColumn("__b", bucket.cast("int"))
    upto = Window.partitionBy(*group).orderBy("__b")
    counts = df.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__before", F.sum("__n").over(upto) - F.col("__n"))
    counts = counts.withColumn("__total", F.sum("__n").over(Window.partitionBy(*group)))
    out = df.join(counts.drop("__n"), [*group, "__b"])
    within = Window.partitionBy(*group, "__b").orderBy(*order)
    out = out.withColumn(rank, F.row_number().over(within) - 1 + F.col("__before"))
    if total:
        out = out.withColumn(total, F.col("__total"))
    return out.drop("__b", "__before", "__total")
