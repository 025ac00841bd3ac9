"""Trained models that are kept, untrained embeddings, stages through the store, grids of runs and their tables."""

import hashlib

import numpy as np
import pytest

from terrane.config import EngineConfig
from terrane.graph import Graph
from terrane.operators import diagnostics, layers, models
from terrane.operators.graph import undirected_edges
from terrane.plans import report, runs, stages
from terrane.sources.files import ArtifactStore

from .graphs import both, clique_ring, edges_df, members_df, nodes_df, rows


def ring(spark, cliques=9, size=4):
    n, pairs, of = clique_ring(cliques, size)
    feat = [[float(of[u] % 3 == 0), float(of[u] % 3 > 0), 0.5] for u in range(n)]
    return Graph(nodes_df(spark, n, feat=feat, label=[int(c % 3 > 0) for c in of]), edges_df(spark, both(pairs)))


def mapped(weight=None):
    rng = np.random.default_rng(3)
    y = np.array([0, 1, 2, 0, 1, 2, 0])
    src = np.array([0, 1, 2, 3, 4, 5, 6, 2])
    return models.Mapped(rng.normal(size=(7, 4)), y, src, (src + 3) % 7, *[np.ones(7, bool)] * 3, ids=np.arange(10, 17), weight=weight)


@pytest.mark.parametrize("backbone", models.BACKBONES)
def test_kept_weights_predict_the_same(spark, backbone):
    g = mapped()
    got = models.fit(g, backbone, 3, seed=2, epochs=15)
    kept = models.read_weights(models.weights_table(spark, got["params"]))
    assert [p.shape for p in kept] == [p.shape for p in got["params"]]
    again = models.predict(g, backbone, kept)
    assert np.allclose(again, got["posteriors"], atol=1e-12) and np.allclose(again.sum(axis=1), 1)
    table = {r["community"]: r for r in models.posterior_table(spark, g, again).collect()}
    assert sorted(table) == list(range(10, 17)) and [table[c]["pred"] for c in sorted(table)] == list(got["pred"])


def test_edge_weights_change_the_sum_of_messages():
    plain, heavy = mapped(), mapped(weight=np.full(8, 2.5))
    for backbone in ("GCN", "SAGE"):
        assert np.allclose(models._edge_weights(heavy, backbone), 2.5 * models._edge_weights(plain, backbone))
    with pytest.raises(ValueError):
        EngineConfig(use_edge_weight=True, target_model="GAT")


def test_hashed_weights():
    w = layers.hashed_weights(2, 3, seed=5, matrix=1)
    draw = int(hashlib.md5(b"5:1:1:2").hexdigest()[:8], 16) / 2**32
    assert w.shape == (2, 3) and w[1, 2] == pytest.approx((2 * draw - 1) * (6 / 5) ** 0.5)


@pytest.mark.parametrize("backbone", models.BACKBONES)
def test_random_embedding_is_one_layer(spark, backbone):
    pairs = [(0, 1), (2, 1), (1, 3), (3, 0), (2, 0)]  # nothing reaches 2 and 4
    feat = np.array([[1.0, 2.0], [0.5, -1.0], [2.0, 0.0], [-1.0, 1.0], [1.0, 1.0]])
    nodes, edges = nodes_df(spark, 5, feat=feat.tolist()), edges_df(spark, pairs)
    got = {r["node"]: np.array(r["feat"]) for r in layers.random_embedding(nodes, edges, backbone, 6, 9).collect()}
    h = feat @ layers.hashed_weights(2, 6, 9, 0)
    want = np.zeros((5, 6))
    for v in range(5):
        near = [a for a, b in pairs if b == v]
        if backbone == "SAGE":
            want[v] = h[v] + (np.mean([feat[a] for a in near], axis=0) @ layers.hashed_weights(2, 6, 9, 1) if near else 0)
        elif near and backbone == "GCN":
            want[v] = sum(h[a] / np.sqrt(sum(s == a for s, _ in pairs) * len(near)) for a in near)
        elif near:
            left, right = (layers.hashed_weights(1, 6, 9, k)[0] for k in (1, 2))
            z = np.array([h[a] @ left + h[v] @ right for a in near])
            e = np.exp(np.where(z > 0, z, 0.2 * z))
            want[v] = (e / e.sum()) @ h[near]
        want[v] /= np.linalg.norm(want[v]) or 1
        assert np.allclose(got[v], want[v])
    assert layers.random_embedding(nodes.limit(0), edges, backbone).count() == 0


def test_audit_is_its_parts(spark):
    g = ring(spark)
    m = members_df(spark, {c: [*range(4 * c, 4 * c + 4), (4 * c + 4) % 36] for c in range(9)})
    audit = stages.audit_membership(g, m, 9)
    assert len(set(audit.columns)) == len(audit.columns)
    got = audit.first().asDict()
    report_ = diagnostics.summary(g.nodes, m)
    for part in (report_, diagnostics.health(report_, 9).withColumnRenamed("uncovered", "not_covered"), diagnostics.modularity(diagnostics.primary(g.nodes, m), undirected_edges(g.edges)), diagnostics.label_purity(g.nodes, m), diagnostics.content_hash(m)):
        for k, v in part.first().asDict().items():
            assert got[k] == pytest.approx(v)
    assert got["healthy"] and got["memberships_max"] == 2
    row = stages.audit(g, EngineConfig(partition="lpa"), with_edges=True).first()
    assert row["method"] == "lpa" and row["edge_mapping_s"] > 0


def test_grid_runs_and_goes_on(spark, tmp_path):
    g, store = ring(spark), ArtifactStore(spark, str(tmp_path))
    configs = report.grid(partition=["louvain"], agg_feat=["mean"], louvain_resolution=[1.0], num_epochs=[5], partition_min_communities=[2, 1000])
    got = {r["failed"]: r for r in runs.run_grid({"ring": g}, configs, store).collect()}
    assert "no healthy partition" in got[True]["error"] and got[True]["macro_f1"] is None
    name, own = got[False]["run_id"], store.under("ring")
    assert own.load("posteriors", name).count() <= got[False]["communities"] and own.has("weights", name + "__unlearned")
    assert rows(own.load("params", name).where("option = 'num_epochs'")) == [("num_epochs", "5")] and own.load("summary", name).first()["healthy"]
    again = runs.run_cell("ring", g, configs[0], store).first()
    assert again["train_s"] == got[False]["train_s"]  # not run again
    records = own.runs("record")
    assert report.utility_table(records).first()["runs"] == 1
    assert report.efficiency_table(records).first()["speedup_mean"] > 0
    assert report.partition_table(records).first()["failed"] == 0.5
    with pytest.raises(ValueError):
        stages.run_stage("deploy", g, configs[0], own)
