"""Proportional stratified interleaving of documents into shards.

Rows are shuffled within each source by a seeded hash and ranked; sorting all rows by fractional rank
``(rank + 0.5) / rows of the source`` interleaves the sources in proportion, so every contiguous cut has the mixture of
the whole corpus (each source to within one row a cut).  The law held is ``rows``: shard sizes differ by one at most.

Ranks come from :func:`terrane.llm.common.ranked`, in hash buckets, so a source with a third of all rows is never in one
task.  Only ids, hashes and sizes are shuffled; texts stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked

BUCKETS = 4096


def assign_shards(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """``doc_id, source, size, text_crc32, law, shard, slot, grown_shard`` for each row of ``docs``.

    size: UTF-8 bytes of the text plus 1.  A null text counts as empty, a null source is a source of its own, null ids sort
    first.  Rows equal in all of these are interchangeable.  Rows of equal text are not kept together: a group may be larger
    than a shard, which the law forbids.  An empty table gives an empty result; other columns are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.md5(key.cast("binary")).alias("__h"), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("__s"),
    )
    rows = ranked(rows, ["__s"], F.conv(F.substring("__h", 1, 3), 16, 10), [F.col(c) for c in ("__h", "doc_id", "text_crc32", "size")], "__r", "__n")
    rows = rows.withColumn("__f", (F.col("__r") + 0.5) / F.col("__n")).withColumn("__one", F.lit(1))
    rows = ranked(rows, ["__one"], F.least(F.floor(F.col("__f") * BUCKETS), F.lit(BUCKETS - 1)), [F.col("__f"), F.col("__s")], "__p", "__all")
    rows = rows.withColumn("shard", F.expr(f"cast(__p * {shards} div __all as int)"))
    slot = F.expr(f"cast(__p - (shard * __all + {shards - 1}) div {shards} as bigint)")
    return rows.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 17, rows_per_file: int = 1_000_000) -> None:
    """Write ``docs`` as Parquet folders ``shard=0`` and so on, rows in slot order within files.  ``doc_id`` must be unique."""
    placed = assign_shards(docs.select("doc_id", "text", "source"), shards, seed).select("doc_id", "shard", "slot")
    full = docs.join(placed, "doc_id").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    full.write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)
