"""The tables that describe an attributed graph and a partition of it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

NODES = "node long, feat array<double>, label int"
EDGES = "src long, dst long"
MEMBERSHIP = "community long, node long"
MAPPED_NODES = "community long, feat array<double>, label int, train boolean, val boolean, test boolean"
MAPPED_EDGES = "src_c long, dst_c long, score double"


@dataclass(frozen=True)
class Graph:
    """``nodes``, directed ``edges`` (repeats and self-loops allowed) and ``membership`` (the only record of communities)."""

    nodes: DataFrame
    edges: DataFrame
    membership: DataFrame | None = None
