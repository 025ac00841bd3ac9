"""The three stages: partition a graph and map it, train on the mapped graph, delete nodes and retrain."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..durable import durable
from ..graph import Graph
from ..operators import detect, diagnostics, edges, features, labels, masks, models, overlap, unlearn
from ..operators.graph import adjacency, dense_index, representations, undirected_edges
from ..operators.ranks import KEY_BITS, first_rows
from ..sources.files import ArtifactStore


@dataclass
class Mapping:
    membership: DataFrame
    nodes: DataFrame  # community, feat, label
    scores: DataFrame  # src_c, dst_c, score
    masks: DataFrame
    report: dict = field(default_factory=dict)


def protected_nodes(graph: Graph, config: EngineConfig) -> DataFrame | None:
    if config.protect_eval_nodes == "none":
        return None
    held = masks.holdout(graph.nodes, config.test_ratio, config.random_seed).where("test").select("node")
    if config.protect_eval_nodes == "test_val" and "val_mask" in graph.nodes.columns:
        held = held.union(graph.nodes.where("val_mask").select("node")).distinct()
    return held


def coarse_to_fine(graph: Graph, config: EngineConfig, seed: int, base: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Coarse blocks, refinement, overlap, singleton backfill, size cap, tail repair, in this order.

    ``base(nodes, adj, seed)`` replaces the coarse stage.  Protected nodes take no part until they are backfilled alone.
    """
    nodes, adj = graph.nodes, durable(adjacency(graph.edges))
    protected = protected_nodes(graph, config)
    free, inner = nodes, adj
    if protected is not None:
        free = nodes.join(protected, "node", "left_anti")
        inner = adj.join(protected.toDF("u"), "u", "left_anti").join(protected.toDF("v"), "v", "left_anti").select("u", "v")
    coarse = base(free, inner, seed) if base else detect.louvain_blocks(free, inner, config.resolution, seed)
    threshold = config.conductance_threshold if config.conductance_threshold >= 0 else None
    fine = durable(detect.fine_blocks(coarse, inner, config.theta, config.fine_resolution, seed, threshold))
    reps = durable(representations(nodes, adj, config.propagation_steps)) if "feat" in nodes.columns else None
    m = overlap.expand_overlap(nodes, fine, adj, reps, config.overlap_threshold, config.max_communities_per_node, protected)
    m = durable(overlap.backfill_singletons(nodes, m))
    m = overlap.cap_sizes(m, adj, config.max_community_size)
    return durable(overlap.repair_tail(m, adj, reps, config.tail_min_size, protected))


def negative_pairs(nodes: DataFrame, adj: DataFrame, count: int, seed: int, rounds: int = 32) -> DataFrame:
    """``u, v``: up to ``count`` seeded pairs of different nodes without an edge; fewer if the rounds don't find as many."""
    index = durable(dense_index(nodes, "node", "i"))
    n, spark, got = index.count(), nodes.sparkSession, None
    if n < 2:
        return adj.limit(0)
    for k in range(rounds):
        pick = lambda side: F.pmod(F.xxhash64("id", F.lit(side), F.lit(k), F.lit(seed)), F.lit(n)).alias(side)  # noqa: B023, E731
        picks = spark.range(2 * count).select(pick("a"), pick("b")).where("a <> b").distinct()
        rows = picks.join(index.toDF("u", "a"), "a").join(index.toDF("v", "b"), "b").select("u", "v")
        fresh = rows.join(adj, ["u", "v"], "left_anti")
        got = durable(fresh if got is None else got.union(fresh).distinct())
        if got.count() >= count:
            break
    return first_rows(got.withColumn("__tie", F.struct("u", "v")), F.pmod(F.xxhash64("u", "v"), F.lit(1 << KEY_BITS)), "__tie", count).select("u", "v")


def encoder_blocks(config: EngineConfig):
    """A coarse stage from a trained graph encoder and k-means; the encoder holds one graph of bounded size in a task."""

    def base(nodes: DataFrame, adj: DataFrame, seed: int) -> DataFrame:
        if (n := nodes.count()) > models.MAX_NODES:
            raise ValueError(f"{n} nodes; the encoder takes {models.MAX_NODES}")
        t = nodes.select("node", *["feat"] * ("feat" in nodes.columns)).toPandas().sort_values("node", kind="stable")
        at = {u: i for i, u in enumerate(t["node"])}
        e = adj.toPandas().sort_values(["u", "v"], kind="stable")
        src, dst = e["u"].map(at).to_numpy(np.int64), e["v"].map(at).to_numpy(np.int64)
        x = np.stack(t["feat"].to_numpy()).astype(float) if "feat" in t else np.log1p(np.bincount(src, minlength=len(t)))[:, None]
        neg = negative_pairs(nodes, adj, max(1, len(src)), seed).toPandas()
        z, _ = models.autoencode(x, src, dst, neg.apply(lambda c: c.map(at)).to_numpy(np.int64), config.gae_hidden, config.gae_latent, config.gae_epochs, config.gae_lr, seed)
        z = np.round(z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12), config.gae_round_decimals)
        embedded = nodes.sparkSession.createDataFrame([(int(u), [float(a) for a in v]) for u, v in zip(t["node"], z)], "node long, feat array<double>")
        return detect.embedding_clusters(embedded, config.theta, seed)

    return base


def detect_communities(graph: Graph, config: EngineConfig, seed: int) -> DataFrame:
    name = config.partition
    if name == "ccp":
        return coarse_to_fine(graph, config, seed)
    if name == "gae":
        return coarse_to_fine(graph, config, seed, encoder_blocks(config))
    if name == "louvain":
        return detect.louvain(graph.nodes, graph.edges, seed, config.louvain_resolution)
    if name == "nikm":
        return detect.embedding_communities(graph.nodes, graph.edges, seed, backbone=config.target_model)
    by_name = {"slpa": detect.speaker_listener, "oslom": detect.dense_label_propagation, "lpa": detect.label_propagation}
    return by_name[name](graph.nodes, graph.edges, seed)


def checked_communities(graph: Graph, config: EngineConfig) -> tuple[DataFrame, list[dict]]:
    """A membership that passes the health check; attempt i uses ``seed + i``.  All attempts are reported; none passing is an
    error."""
    attempts = []
    for i in range(config.partition_max_retries + 1):
        m = durable(detect_communities(graph, config, config.random_seed + i))
        report = diagnostics.summary(graph.nodes, m)
        row = report.join(diagnostics.health(report, config.partition_min_communities)).first().asDict()
        attempts.append({"attempt": i, "seed": config.random_seed + i, **row})
        if row["healthy"]:
            return m, attempts
    raise ValueError(f"no healthy partition in {len(attempts)} attempts: {attempts}")


def mapped_features(rows: DataFrame, config: EngineConfig) -> DataFrame:
    feats = features.pca_features(rows) if config.agg_feat == "pca" else features.mean_features(rows)
    if config.use_feat_rb:
        feats = features.robust_features(feats, features.feature_robustness(features.distances(rows, feats)))
    return feats


def mapped_labels(rows: DataFrame, feats: DataFrame, config: EngineConfig) -> DataFrame:
    if config.agg_label == "th":
        return labels.label_by_threshold(features.distances(rows, feats))
    return labels.majority(rows) if config.agg_label == "all" else labels.label_by_two_means(rows)


def mapped_scores(graph_edges: DataFrame, membership: DataFrame, feats: DataFrame, config: EngineConfig, after_deletion: bool = False) -> DataFrame:
    counts = durable(edges.edge_counts(graph_edges, membership))
    if config.agg_edge == "opt":
        return edges.fitted_weights(counts, feats)
    if config.agg_edge == "jaccard":
        return edges.jaccard_symmetric(counts, membership) if after_deletion else edges.jaccard_ordered(counts, membership)
    return edges.score_edges(counts, membership, config.test_edge_method, "source")


#: Kinds of the store that hold the tables of a Mapping.
MAPPING_KINDS = {"membership": "membership", "nodes": "mapped_nodes", "scores": "mapped_edges", "masks": "masks"}


def save_mapping(store: ArtifactStore, run_id: str, mapping: Mapping) -> None:
    for name, kind in MAPPING_KINDS.items():
        store.save(kind, run_id, getattr(mapping, name))


def load_mapping(store: ArtifactStore, run_id: str) -> Mapping:
    return Mapping(**{name: store.load(kind, run_id) for name, kind in MAPPING_KINDS.items()})


def partition(graph: Graph, config: EngineConfig, store: ArtifactStore | None = None) -> Mapping:
    """The mapping of a healthy partition; a store gets its tables, the options and a row for each attempt."""
    began = time.time()
    m, attempts = checked_communities(graph, config)
    found = time.time()
    rows = features.members(graph.nodes, m)
    feats = durable(mapped_features(rows, config))
    nodes = durable(feats.join(mapped_labels(rows, feats, config), "community"))
    scores = durable(mapped_scores(graph.edges, m, feats, config))
    split = durable(masks.mapping_masks(nodes, config.test_ratio, config.random_seed))
    report = {"stage": "partition", "run_id": config.run_id(), "attempts": attempts, "partition_s": found - began, "mapping_s": time.time() - found}
    mapping = Mapping(m, nodes, scores, split, report)
    if store:
        save_mapping(store, config.run_id(), mapping)
        store.save("summary", config.run_id(), store.spark.createDataFrame([Row(**x) for x in attempts]))
        store.save("params", config.run_id(), store.spark.createDataFrame([(k, str(v)) for k, v in asdict(config).items()], "option string, value string"))
    return mapping


def deployed_graph(mapping: Mapping, split: DataFrame, config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """Mapped nodes with masks and thresholded edges, without nodes that no edge reaches."""
    nodes = mapping.nodes.join(split, "community")
    _, kept = edges.mapped_graph(mapping.scores, nodes, edges.score_threshold(mapping.scores, config.th_sim2edge))
    return edges.drop_unreached(nodes, kept)


def _trained(graph: Graph, mapping: Mapping, split: DataFrame, config: EngineConfig, stage: str, store: ArtifactStore | None = None) -> dict:
    """The report of a trained model; a store gets its weights and its posteriors on the mapped nodes."""
    began = time.time()
    mapped = models.Mapped.of(*deployed_graph(mapping, split, config), weighted=config.use_edge_weight)
    built = time.time()
    classes = int(graph.nodes.agg(F.max("label")).first()[0]) + 1
    got = models.fit(mapped, config.target_model, classes, config.random_seed, config.train_lr, config.train_weight_decay, config.num_epochs)
    report = {"graph_s": built - began, "train_s": time.time() - built}
    got.pop("pred")
    params, posteriors = got.pop("params"), got.pop("posteriors")
    if store:
        name = after_deletion(config) if stage == "unlearn" else config.run_id()
        store.save("weights", name, models.weights_table(store.spark, params))
        store.save("posteriors", name, models.posterior_table(store.spark, mapped, posteriors))
    return {"stage": stage, "run_id": config.run_id(), **got, **report}


def after_deletion(config: EngineConfig) -> str:
    """The run id under which a run's artifacts after its deletion are kept."""
    return config.run_id() + "__unlearned"


def train(graph: Graph, mapping: Mapping, config: EngineConfig, store: ArtifactStore | None = None) -> tuple[DataFrame, dict]:
    """(masks, report) of a model trained on the mapped graph."""
    held = masks.holdout(graph.nodes, config.test_ratio, config.random_seed)
    split = durable(masks.train_masks(mapping.membership, held, config.test_ratio, config.random_seed))
    if store:
        store.save("train_masks", config.run_id(), split)
    return split, _trained(graph, mapping, split, config, "train", store)


def delete(graph: Graph, mapping: Mapping, split: DataFrame, request: DataFrame, config: EngineConfig) -> tuple[Mapping, DataFrame]:
    """(mapping, masks) after deletion: affected features and labels are made anew, the others carried over; all edge scores
    are made anew, since their normalisers change everywhere."""
    m, index = unlearn.remove_nodes(mapping.membership, request)
    m, index = durable(m), durable(index)
    if index.isEmpty():
        raise ValueError("the request removes every community")
    touched = unlearn.affected_new(unlearn.affected(mapping.membership, request), index)
    rows = features.members(graph.nodes, m.join(touched, "community", "left_semi"))
    feats = durable(mapped_features(rows, config))
    fresh = feats.join(mapped_labels(rows, feats, config), "community").select("community", "feat", "label")
    nodes = durable(features.replaced(unlearn.remap(mapping.nodes, index).select("community", "feat", "label"), fresh))
    scores = durable(mapped_scores(graph.edges, m, nodes.select("community", "feat"), config, after_deletion=True))
    return Mapping(m, nodes, scores, unlearn.remap(mapping.masks, index)), unlearn.remap(split, index)


def unlearn_nodes(graph: Graph, mapping: Mapping, split: DataFrame, config: EngineConfig, request: DataFrame | None = None, store: ArtifactStore | None = None) -> tuple[Mapping, dict]:
    """Apply a deletion request (a seeded one by default) and retrain."""
    if request is None:
        request = durable(masks.deletion_request(mapping.membership, split, config.unlearn_ratio, config.random_seed))
    began = time.time()
    after, kept = delete(graph, mapping, split, request, config)
    updated = time.time()
    report = _trained(graph, after, masks.deployed_masks(kept, after.masks), config, "unlearn", store)
    if store:
        save_mapping(store, after_deletion(config), after)
        store.save("request", config.run_id(), request)
    return after, report | {"update_s": updated - began, "deleted": request.count()}


STAGES = ("partition", "train", "unlearn")


def run_stage(stage: str, graph: Graph, config: EngineConfig, store: ArtifactStore) -> dict:
    """One stage by name: it reads what the stages before it left in the store under the run's id, and gives its report."""
    if stage not in STAGES:
        raise ValueError(f"stage must be one of {STAGES}")
    if stage == "partition":
        return partition(graph, config, store).report
    mapping = load_mapping(store, config.run_id())
    if stage == "train":
        return train(graph, mapping, config, store)[1]
    return unlearn_nodes(graph, mapping, store.load("train_masks", config.run_id()), config, store=store)[1]


def audit(graph: Graph, config: EngineConfig, with_edges: bool = False) -> DataFrame:
    """One row on a detector's partition: structure, health, modularity, purity, hash, seconds; no retry, no error if unhealthy.

    with_edges: the edge scores are made too, and timed apart.
    """
    began = time.time()
    m = durable(detect_communities(graph, config, config.random_seed))
    took = {"partition_s": time.time() - began}
    if with_edges:
        began = time.time()
        took["edge_pairs"] = edges.score_edges(durable(edges.edge_counts(graph.edges, m)), m, config.test_edge_method, "source").count()
        took["edge_mapping_s"] = time.time() - began
    out = audit_membership(graph, m, config.partition_min_communities)
    return out.select(F.lit(config.partition).alias("method"), F.lit(config.random_seed).cast("long").alias("seed"), "*", *[F.lit(v).alias(k) for k, v in took.items()])


def audit_membership(graph: Graph, membership: DataFrame, min_communities: int = diagnostics.MIN_COMMUNITIES) -> DataFrame:
    """One row: the summary, the health check (its ``uncovered`` as ``not_covered``), modularity of lowest communities, label purity where labels are, and the hash.

    Every part is a single row, so they meet in joins without a key.
    """
    report = durable(diagnostics.summary(graph.nodes, membership))
    out = report.crossJoin(diagnostics.health(report, min_communities).withColumnRenamed("uncovered", "not_covered"))
    out = out.crossJoin(diagnostics.modularity(diagnostics.primary(graph.nodes, membership), undirected_edges(graph.edges)))
    if "label" in graph.nodes.columns:
        out = out.crossJoin(diagnostics.label_purity(graph.nodes, membership))
    return out.crossJoin(diagnostics.content_hash(membership))
