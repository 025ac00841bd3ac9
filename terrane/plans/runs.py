"""Runs of the whole engine: one cell, and a grid of cells that goes on where it was stopped."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame

from ..config import EngineConfig
from ..graph import Graph
from ..sources.files import ArtifactStore
from . import stages

#: Options, outcome and seconds of a cell.
RECORD = (
    "run_id string, dataset string, method string, backbone string, seed long, failed boolean, error string, communities long, "
    "macro_f1 double, accuracy double, unlearned_macro_f1 double, partition_s double, mapping_s double, train_s double, update_s double, retrain_s double"
)


def run_cell(dataset: str, graph: Graph, config: EngineConfig, store: ArtifactStore) -> DataFrame:
    """The record of one cell, a row: all three stages, their artifacts in the dataset's part of the store.

    A cell whose record is there and didn't fail is not run again.  An error in a stage ends the cell, and is its record.
    """
    own, name = store.under(dataset), config.run_id()
    if own.has("record", name) and not (done := own.load("record", name)).first()["failed"]:
        return done
    record = {"run_id": name, "dataset": dataset, "method": config.partition, "backbone": config.target_model, "seed": config.random_seed, "failed": False, "error": None}
    try:
        made = stages.run_stage("partition", graph, config, own)
        record |= {"partition_s": made["partition_s"], "mapping_s": made["mapping_s"], "communities": own.load("mapped_nodes", name).count()}
        trained = stages.run_stage("train", graph, config, own)
        record |= {k: trained[k] for k in ("macro_f1", "accuracy", "train_s")}
        forgot = stages.run_stage("unlearn", graph, config, own)
        record |= {"unlearned_macro_f1": forgot["macro_f1"], "update_s": forgot["update_s"], "retrain_s": forgot["train_s"]}
    except Exception as e:  # a grid goes on; the record says what went wrong
        record |= {"failed": True, "error": f"{type(e).__name__}: {e}"[:1000]}
    columns = [c.split()[0] for c in RECORD.split(", ")]
    return own.save("record", name, store.spark.createDataFrame([tuple(record.get(c) for c in columns)], RECORD))


def run_grid(graphs: dict[str, Graph], configs: Iterable[EngineConfig], store: ArtifactStore) -> DataFrame:
    """Records of every dataset under every configuration, one cell after another; each cell is distributed in itself."""
    return reduce(DataFrame.union, [run_cell(name, graph, config, store) for config in configs for name, graph in graphs.items()])
