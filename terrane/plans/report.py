"""Tables over run records."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig

DATASET_ORDER = ("cora", "citeseer", "pubmed", "cs")


def grid(**choices: Iterable) -> list[EngineConfig]:
    """All combinations of the given options, in order."""
    return [EngineConfig(**dict(zip(choices, x))) for x in product(*choices.values())]


def variant(run_id: str = "run_id"):
    """The options in a run id but its seed, joined by commas; ``baseline`` if there are none."""
    parts = F.filter(F.split(F.col(run_id), "__"), lambda p: p.contains("=") & ~p.startswith("seed="))
    return F.when(F.size(parts) > 0, F.array_join(parts, ",")).otherwise(F.lit("baseline"))


def seed_of(run_id: str = "run_id"):
    return F.regexp_extract(run_id, r"(?:^|__)seed=(\d+)", 1).try_cast("long")


def mean_std(runs: DataFrame, by: list[str], metric: str) -> DataFrame:
    """``by..., mean, std, runs``: population deviation; null and NaN values are left out."""
    ok = runs.where(F.col(metric).isNotNull() & ~F.isnan(F.col(metric).cast("double")))
    return ok.groupBy(*by).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.count(F.lit(1)).alias("runs"))


def metric_table(runs: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """``by..., runs, <metric>_mean, <metric>_std...``: population deviation; null and NaN values of a metric are left out."""
    ok = {m: F.when(~F.isnan(F.col(m).cast("double")), F.col(m)) for m in metrics}
    cols = [f(ok[m]).alias(f"{m}_{name}") for m in metrics for f, name in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), *cols)


def utility_table(runs: DataFrame, by: tuple[str, ...] = ("dataset", "method")) -> DataFrame:
    """Scores of finished runs, before and after their deletion."""
    return metric_table(finished(runs), list(by), ["macro_f1", "accuracy", "unlearned_macro_f1"])


def efficiency_table(runs: DataFrame, by: tuple[str, ...] = ("dataset", "method")) -> DataFrame:
    """Seconds of finished runs' phases, and how many times a deletion is faster than partition, mapping and training anew."""
    anew, again = F.col("partition_s") + F.col("mapping_s") + F.col("train_s"), F.col("update_s") + F.col("retrain_s")
    rows = finished(runs).withColumn("speedup", F.when(again > 0, anew / again))
    return metric_table(rows, list(by), ["partition_s", "mapping_s", "train_s", "update_s", "retrain_s", "speedup"])


def partition_table(runs: DataFrame, by: tuple[str, ...] = ("dataset", "method")) -> DataFrame:
    """Communities of finished runs, and the share of all runs that failed."""
    failed = runs.groupBy(*by).agg(F.avg(F.coalesce(F.col("failed"), F.lit(False)).cast("int")).alias("failed"))
    return failed.join(metric_table(finished(runs), list(by), ["communities", "partition_s"]), list(by), "left")


def seed_spread(runs: DataFrame, by: list[str], metric: str, seeds: list[int]) -> DataFrame:
    """``by..., seed_<n>..., spread``: the metric's mean for each seed and the range between them."""
    wide = runs.groupBy(*by).pivot("seed", seeds).agg(F.avg(metric))
    cols = [F.col(str(s)) for s in seeds]
    return wide.select(*by, *[c.alias(f"seed_{s}") for c, s in zip(cols, seeds)], (F.greatest(*cols) - F.least(*cols)).alias("spread"))


def ordered(table: DataFrame, dataset: str = "dataset", order: tuple[str, ...] = DATASET_ORDER, then: str = "method") -> DataFrame:
    """Rows in the given order of datasets, unknown ones last."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(dataset))
    return table.orderBy(F.when(at > 0, at).otherwise(F.lit(len(order) + 1)), dataset, then)


def finished(runs: DataFrame) -> DataFrame:
    """Runs that neither failed nor lack a score."""
    return runs.where(~F.coalesce(F.col("failed"), F.lit(False)) & F.col("macro_f1").isNotNull())


def to_markdown(table: DataFrame) -> str:
    """A small table as text; for reports of a few rows."""
    rows = [table.columns, ["---"] * len(table.columns)] + [[f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in table.collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def environment(spark) -> dict:
    import platform

    return {"spark": spark.version, "python": platform.python_version(), "master": spark.sparkContext.master, **{k: v for k, v in spark.sparkContext.getConf().getAll() if k.startswith("spark.sql.")}}
