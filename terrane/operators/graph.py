"""Projections, degrees, subgraphs, propagation and walks over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..durable import durable, release_shuffles, written
from ..functions.vectors import l2_normalise, shuffle_key
from .components import connected_components


def adjacency(edges: DataFrame) -> DataFrame:
    """``u, v``: simple undirected graph in both directions, without loops and repeats."""
    e = edges.where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return e.union(e.select("v", "u")).distinct()


def undirected_edges(edges: DataFrame) -> DataFrame:
    """``u, v`` with u < v, once for each edge."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def degrees(nodes: DataFrame, adj: DataFrame) -> DataFrame:
    d = adj.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("node").join(d, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    ids = nodes.select("node").distinct()
    out = edges.join(ids.withColumnRenamed("node", "src"), "src", "left_semi")
    return out.join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def dense_index(ids: DataFrame, column: str, name: str) -> DataFrame:
    """``column, name``: 0-based rank of each distinct id.  Ids are range-partitioned and ranked within partitions;
    only the partitions' sizes meet in one place."""
    ordered = ids.select(column).distinct().repartitionByRange(column).sortWithinPartitions(column)
    ordered = durable(ordered.withColumn("__p", F.spark_partition_id()))
    sizes = ordered.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).drop("__n")
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(column)) - 1
    return ordered.withColumn("__r", rank).join(F.broadcast(before), "__p").select(column, (F.col("__r") + F.col("__before")).cast("long").alias(name))


def filter_edges(edges: DataFrame, nodes: DataFrame, reindex: bool = False) -> DataFrame:
    """Edges inside ``nodes``; with ``reindex`` ids become ranks among the given nodes."""
    inside = induced(edges, nodes)
    if not reindex:
        return inside
    index = dense_index(nodes, "node", "i")
    out = inside.join(index.withColumnRenamed("i", "s"), inside["src"] == F.col("node")).drop("node")
    return out.join(index.withColumnRenamed("i", "d"), F.col("dst") == F.col("node")).select(F.col("s").alias("src"), F.col("d").alias("dst"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node) for every node, isolated ones too."""
    got = connected_components(edges)
    return nodes.select("node").join(got, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def neighbour_table(nodes: DataFrame, adj: DataFrame, width: int, seed: int) -> DataFrame:
    """``node, slot, neighbour``: exactly ``width`` neighbours each: a seeded sample, repeated in turn where there are fewer;
    null where there is none."""
    order = Window.partitionBy("u").orderBy(shuffle_key("v", seed), "v")
    picked = adj.withColumn("r", F.row_number().over(order) - 1).where(F.col("r") < width)
    d = picked.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    slots = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("slot")).join(d, F.col("node") == d["u"], "left").drop("u")
    taken = picked.select(F.col("u").alias("node"), F.col("r").cast("int").alias("at"), F.col("v").alias("neighbour"))
    return slots.withColumn("at", (F.col("slot") % F.col("d")).cast("int")).join(taken, ["node", "at"], "left").select("node", "slot", "neighbour")


def neighbour_sample(adj: DataFrame, fanout: int, seed: int) -> DataFrame:
    """At most ``fanout`` neighbours of each node, picked by seeded order."""
    order = Window.partitionBy("u").orderBy(shuffle_key("v", seed), "v")
    return adj.withColumn("r", F.row_number().over(order)).where(F.col("r") <= fanout).drop("r")


def sampled_hops(seeds: DataFrame, adj: DataFrame, fanouts: list[int], seed: int) -> DataFrame:
    """``hop, u, v``: edges of a layered neighbour sample around the seeds."""
    frontier, out = seeds.select(F.col("node").alias("u")).distinct(), None
    for hop, fanout in enumerate(fanouts):
        got = neighbour_sample(adj.join(frontier, "u", "left_semi"), fanout, seed + hop).select(F.lit(hop).alias("hop"), "u", "v")
        out = got if out is None else out.union(got)
        frontier = got.select(F.col("v").alias("u")).distinct()
    return out


def _vector_sum(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Sum of vectors by key, as ``key, pos, x``: positions are summed map-side, so a hub is never one task's list."""
    return rows.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.sum("x").alias("x"))


def to_vectors(rows: DataFrame, key: str, name: str = "feat") -> DataFrame:
    """``key, name``: the vector of ``pos, x`` rows; positions are bounded by the vector's width."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(name))


SUM_ROWS = 8192  # nodes whose sums a task holds


def neighbour_sums(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """``dst, feat``: sum of the vectors (``src, feat``) over a node's in-edges, an edge's repeats counted.

    Edges are dealt into cells by both ends.  A cell gets each vector that it needs once and keeps the sums of at most about
    ``SUM_ROWS`` nodes, so neither an edge's vector nor its positions become rows, and a hub's edges are spread over cells.
    """
    blocks = max(4, -(-vectors.count() // SUM_ROWS))
    deal = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    links = edges.where("src is not null and dst is not null").select((deal("dst") * blocks + deal("src")).alias("cell"), "src", "dst")
    known = links.select("cell", "src").distinct().join(vectors.where("feat is not null").select("src", "feat"), "src")
    both = known.select("cell", "src", F.lit(None).cast("long").alias("dst"), "feat").union(links.select("cell", "src", F.col("dst").cast("long"), F.lit(None).cast("array<double>")))
    names, types = ["dst", "feat"], [pa.int64(), pa.list_(pa.float64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, last, held, at, sums, width = None, None, None, {}, None, 0  # held: the vector of the source ``last``

        def out() -> Iterator[pa.RecordBatch]:
            nodes = list(at)
            for i in range(0, len(nodes), 1000):
                yield pa.record_batch([pa.array(c, t) for c, t in zip((nodes[i : i + 1000], list(sums[i : i + 1000][: len(nodes) - i])), types)], names)

        for b in batches:
            cells, src = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(cells)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if lo == hi:
                    continue
                if cells[lo] != cell:
                    yield from out()
                    cell, last, held, at, sums = cells[lo], None, None, {}, None
                part, ids = b.slice(lo, hi - lo), src[lo:hi]
                is_vector = part.column(2).is_null().to_numpy(zero_copy_only=False)
                given = part.column(3).filter(pa.array(is_vector))
                if len(given):
                    width = len(given[0])
                if not width:
                    continue  # only sources without a vector so far
                group = np.cumsum(np.diff(ids, prepend=ids[0] if last is None else last) != 0)
                table = np.zeros((group[-1] + 1, width))
                if held is not None:
                    table[0] = held
                np.add.at(table, group[is_vector], given.flatten().to_numpy().reshape(-1, width))
                last, held = ids[-1], table[-1]
                if is_vector.all():
                    continue
                to, inverse = np.unique(part.column(2).drop_null().to_numpy(), return_inverse=True)
                row = np.array([at.setdefault(u, len(at)) for u in to.tolist()])
                if sums is None or len(at) > len(sums):
                    sums = np.concatenate([*([] if sums is None else [sums]), np.zeros((max(1024, len(at)), width))])
                order = np.argsort(inverse, kind="stable")
                starts = np.searchsorted(inverse[order], np.arange(len(to)))
                sums[row] += np.add.reduceat(table[group[~is_vector][order]], starts)
        yield from out()

    dealt = both.repartition("cell").sortWithinPartitions("cell", "src", F.asc_nulls_first("dst"))
    parts = dealt.mapInArrow(run, "dst long, feat array<double>")
    total = lambda all_: F.transform(F.sequence(F.lit(0), F.size(F.element_at(all_, 1)) - 1), lambda i: F.aggregate(all_, F.lit(0.0), lambda s, v: s + v[i]))
    return parts.groupBy("dst").agg(F.collect_list("feat").alias("parts")).select("dst", total(F.col("parts")).alias("feat"))


def propagate(nodes: DataFrame, adj: DataFrame, steps: int) -> DataFrame:
    """``node, feat`` after ``steps`` multiplications by the symmetric-normalised adjacency with self-loops."""
    feats = nodes.select("node", "feat")
    if steps <= 0:
        return feats
    d = degrees(nodes, adj).withColumn("s", F.sqrt(F.col("degree") + 1)).select("node", "s")
    hops = adj.union(nodes.select(F.col("node").alias("u"), F.col("node").alias("v")))
    for _ in range(steps):
        scaled = feats.join(d, "node").select(F.col("node").alias("v"), F.transform("feat", lambda x: x / F.col("s")).alias("x"))
        sums = _vector_sum(hops.join(scaled, "v"), "u", "x").withColumnRenamed("u", "node")
        feats = to_vectors(sums, "node").join(d, "node").select("node", F.transform("feat", lambda x: x / F.col("s")).alias("feat"))
    return feats


def representations(nodes: DataFrame, adj: DataFrame, steps: int) -> DataFrame:
    """Propagated, then L2-normalised features."""
    return propagate(nodes, adj, steps).select("node", l2_normalise("feat").alias("feat"))


def conductance(blocks: DataFrame, adj: DataFrame) -> DataFrame:
    """``block, conductance``: cut over the smaller side's volume; 0 where a side has none.  blocks: ``block, node``, disjoint."""
    b = blocks.select("block", "node")
    e = adj.join(b.select(F.col("node").alias("u"), F.col("block").alias("bu")), "u").join(b.select(F.col("node").alias("v"), F.col("block").alias("bv")), "v", "left")
    per = e.groupBy("bu").agg(F.count(F.lit(1)).alias("vol"), F.sum(F.when(F.col("bu").eqNullSafe(F.col("bv")), 0).otherwise(1)).alias("cut"))
    total = adj.agg(F.count(F.lit(1)).alias("all"))
    side = F.least("vol", F.col("all") - F.col("vol"))
    out = b.select("block").distinct().join(per, F.col("block") == F.col("bu"), "left").join(F.broadcast(total))
    return out.select("block", F.when(side > 0, F.col("cut") / side).otherwise(F.lit(0.0)).alias("conductance"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """``node, rank`` after a fixed number of rounds over distinct directed edges; nodes without an exit share theirs with all."""
    e = written(edges.select("src", "dst").distinct(), "links")
    n = nodes.count()
    out = durable(e.groupBy("src").agg(F.count(F.lit(1)).alias("k")))
    ranks = nodes.select("node", F.lit(1.0 / max(n, 1)).alias("rank"))
    for i in range(rounds):
        sent = ranks.join(out, F.col("node") == F.col("src"), "left").select("node", "rank", "k")
        stuck = sent.where("k is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("stuck"))
        got = e.join(sent.where("k is not null"), F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("k")).alias("g"))
        ranks = nodes.select("node").join(got, F.col("node") == F.col("dst"), "left").crossJoin(F.broadcast(stuck)).select("node", (F.lit((1 - damping) / max(n, 1)) + damping * (F.coalesce("g", F.lit(0.0)) + F.col("stuck") / n)).alias("rank"))
        if i % 2 == 1:
            ranks = durable(ranks)
            release_shuffles(nodes.sparkSession)
    return ranks


def top_share(ranked: DataFrame, order: Column, share: float) -> DataFrame:
    """The first ``ceil(share * rows)`` rows by the order, then node."""
    n = ranked.count()
    return ranked.orderBy(order, "node").limit(-(-int(n * share * 1_000_000) // 1_000_000))


def in_out_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, degree``: edges out plus edges in, repeats counted."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("node").join(ends, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
