"""Projections, overlap, tail repair, detectors, deletion, diagnostics, stages."""

import json
import math

import pytest

from tests.graphs import both, clique_ring, edges_df, members_df, nodes_df, random_case, rows
from terrane.config import EngineConfig
from terrane.graph import Graph
from terrane.operators import detect, diagnostics, graph, layers, local, masks, models, overlap, ranks, unlearn
from terrane.plans import report, stages
from terrane.sources import files
from terrane.streaming import deletions

#: Ten nodes: one in two communities, one in none, one alone.
PARTS = {0: [0, 3, 5], 1: [1, 3], 2: [2, 4, 6, 7], 3: [8]}
LABELS = [0, 1, 1, 0, 2, 0, 1, 1, 2, 2]


def test_adjacency_and_degrees(spark):
    e = edges_df(spark, zip([0, 0, 1, 2, 2], [1, 1, 0, 2, 0]))
    adj = graph.adjacency(e)
    assert rows(adj) == [(0, 1), (0, 2), (1, 0), (2, 0)]
    assert rows(graph.degrees(nodes_df(spark, 4), adj)) == [(0, 2), (1, 1), (2, 1), (3, 0)]


def test_empty_graph(spark):
    e, n = edges_df(spark, []), nodes_df(spark, 2)
    assert rows(graph.components(n, e)) == [(0, 0), (1, 1)]
    assert math.isnan(diagnostics.modularity(diagnostics.primary(n, members_df(spark, {0: [0]})), graph.undirected_edges(e)).first()[0])


def test_components(spark):
    pairs = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (40, 40)]
    got = dict(rows(graph.components(spark.createDataFrame([(i,) for i in [*range(21), 30, 31, 40]], "node long"), edges_df(spark, pairs))))
    assert {got[i] for i in range(21)} == {0} and got[31] == 30 and got[40] == 40


def test_propagation_of_ones_on_a_triangle(spark):
    e = edges_df(spark, both([(0, 1), (1, 2), (0, 2)]))
    n = nodes_df(spark, 3)
    for steps in (0, 2):
        assert all(f == pytest.approx([1.0]) for _, f in rows(graph.propagate(n, graph.adjacency(e), steps)))


def test_conductance(spark):
    pairs = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]
    blocks = spark.createDataFrame([(0, i) if i < 3 else (1, i) for i in range(6)], "block long, node long")
    assert rows(graph.conductance(blocks, graph.adjacency(edges_df(spark, pairs)))) == [(0, 0.0), (1, 0.0)]
    got = rows(graph.conductance(blocks, graph.adjacency(edges_df(spark, pairs + [(2, 3)]))))
    assert got[0][1] == pytest.approx(1 / 7)


def test_modularity(spark):
    n, pairs, of = clique_ring(7, 5)
    a = spark.createDataFrame([(u, of[u]) for u in range(n)], "node long, community long")
    inside, all_ = sum(of[x] == of[y] for x, y in pairs), len(pairs)
    want = inside / all_ - sum((sum((of[x] == c) + (of[y] == c) for x, y in pairs) / (2 * all_)) ** 2 for c in range(7))
    assert diagnostics.modularity(a, graph.undirected_edges(edges_df(spark, pairs))).first()[0] == pytest.approx(want)


def test_summary(spark):
    nodes, m = nodes_df(spark, 10, label=LABELS), members_df(spark, PARTS)
    r = diagnostics.summary(nodes, m).first()
    of = [u for us in PARTS.values() for u in us]
    assert (r["coverage"], r["compression"], r["overlapping_fraction"]) == pytest.approx((len(set(of)) / 10, len(PARTS) / 10, 1 / 10))
    assert (r["memberships_mean"], r["memberships_max"], r["singletons"], r["up_to_two"]) == (pytest.approx(len(of) / len(set(of))), 2, 1, 2)
    shares = [max(votes.count(x) for x in votes) / len(votes) for votes in ([LABELS[u] for u in us] for us in PARTS.values())]
    assert diagnostics.label_purity(nodes, m).first()[0] == pytest.approx(sum(shares) / len(shares))
    assert "coverage" in diagnostics.describe(r.asDict())
    assert diagnostics.content_hash(m).first() == diagnostics.content_hash(m.repartition(3)).first()


def test_deletion(spark):
    m = members_df(spark, PARTS)
    gone = lambda *us: spark.createDataFrame([(u,) for u in us], "node long")
    after, index = unlearn.remove_nodes(m, gone(3))
    assert rows(after) == sorted((c, u) for c, us in PARTS.items() for u in us if u != 3)
    after, index = unlearn.remove_nodes(m, gone(1, 3))
    assert rows(index) == [(0, 0), (2, 1), (3, 2)] and rows(after) == [(0, 0), (0, 5), (1, 2), (1, 4), (1, 6), (1, 7), (2, 8)]
    assert rows(unlearn.affected(m, gone(3))) == [(0,), (1,)]


@pytest.mark.parametrize("count", [0, 1, 137, 400, 999])
def test_first_rows_of_a_seeded_order(spark, count):
    keys = [(i, (i * 7919) % 300) for i in range(400)]  # ties, and keys close to one another
    df = spark.createDataFrame(keys, "node long, k long")
    want = [i for i, _ in sorted(keys, key=lambda r: (r[1], r[0]))[:count]]
    assert sorted(r["node"] for r in ranks.first_rows(df, graph.F.col("k"), "node", count).collect()) == sorted(want)
    far = ranks.first_rows(df, graph.F.col("k") * 14_000_000, "node", count)
    assert sorted(r["node"] for r in far.collect()) == sorted(want) and far.columns == ["node", "k"]


def test_request_sizes():
    assert masks.request_size(3, 10) == 3 and masks.request_size(0.01, 10) == 1 and masks.request_size(0.5, 10) == 5
    for bad in (0, -1, 11):
        with pytest.raises(ValueError):
            masks.request_size(bad, 10)


def test_detectors_cover_and_are_dense(spark):
    n, pairs, of = clique_ring(5, 6)
    nodes, e = nodes_df(spark, n), edges_df(spark, both(pairs))
    for f in (detect.label_propagation, detect.speaker_listener, detect.louvain):
        m = rows(f(nodes, e, 1))
        assert {u for _, u in m} == set(range(n))
        assert sorted({c for c, _ in m}) == list(range(len({c for c, _ in m})))
    spread = detect.louvain_blocks(nodes, graph.adjacency(e), 1.0, 1, levels=2, sweeps=4, local_edges=0)
    assert {u for _, u in rows(spread)} == set(range(n))
    q = diagnostics.modularity(spread.select("node", "community"), graph.undirected_edges(e)).first()[0]
    assert q > 0.4


def test_louvain_is_one_path_until_nothing_rises(spark, monkeypatch):
    monkeypatch.setattr(detect, "louvain_in_task", None)  # no other path for small graphs
    n, pairs, of = clique_ring(4, 5)
    nodes, adj = nodes_df(spark, n), graph.adjacency(edges_df(spark, both(pairs)))
    got = {u: c for c, u in rows(detect.louvain_blocks(nodes, adj, 1.0, 1))}
    edges = {tuple(sorted(p)) for p in pairs}

    def worth(c):
        degree = {}
        for u, v in edges:
            degree[c[u]] = degree.get(c[u], 0) + 1
            degree[c[v]] = degree.get(c[v], 0) + 1
        return sum(c[u] == c[v] for u, v in edges) / len(edges) - sum((d / (2 * len(edges))) ** 2 for d in degree.values())

    best = worth(got)
    for x in set(got.values()):
        for y in set(got.values()) - {x}:
            assert worth({u: x if c == y else c for u, c in got.items()}) <= best + 1e-9


def test_coarse_to_fine_bounds(spark):
    n, pairs, of = clique_ring(4, 12)
    nodes = nodes_df(spark, n + 2, feat=[[float(of[u] == c) for c in range(4)] if u < n else [0.0] * 4 for u in range(n + 2)])
    g = Graph(nodes, edges_df(spark, both(pairs)))
    got = rows(stages.coarse_to_fine(g, EngineConfig(partition="ccp", theta=6, max_community_size=8), 3))
    assert {u for _, u in got} == set(range(n + 2))
    sizes = {}
    for c, _ in got:
        sizes[c] = sizes.get(c, 0) + 1
    assert max(sizes.values()) <= 8 and sorted(sizes) == list(range(len(sizes)))
    assert got == rows(stages.coarse_to_fine(g, EngineConfig(partition="ccp", theta=6, max_community_size=8), 3))


def test_bfs_chunks_and_refinement():
    near = {0: [3, 1], 1: [0], 3: [0], 2: []}
    assert local.chunks([0, 1, 2, 3], near, 2) == [[0, 1], [3, 2]]
    clique = both([(i, j) for i in range(7) for j in range(i)])
    parts = local.refine_block(list(range(7)), clique, {i: 6 for i in range(7)}, 42, 3, 1.0, 0, None)
    assert max(map(len, parts)) <= 3 and sorted(u for p in parts for u in p) == list(range(7))


def test_tail_repair(spark):
    pairs = both([(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5), (6, 0)])
    m = members_df(spark, {0: [0, 1, 2], 1: [3, 4, 5], 2: [6], 3: [7]})
    got = rows(overlap.repair_tail(m, graph.adjacency(edges_df(spark, pairs)), None, 2, reindex=False))
    assert (0, 6) in got and (3, 7) in got and len(got) == 8


def test_negative_pairs(spark):
    n, pairs, _ = clique_ring(3, 4)
    adj = graph.adjacency(edges_df(spark, pairs))
    got = rows(stages.negative_pairs(nodes_df(spark, n), adj, 30, 5))
    assert len(got) == 30 and not set(got) & set(rows(adj)) and all(a != b for a, b in got)


def test_config_is_checked():
    for bad in ({"partition": "kmeans"}, {"max_community_size": 5}, {"max_community_size": 30, "tail_min_size": 40}, {"target_model": "MLP"}, {"gae_epochs": 0}):
        with pytest.raises(ValueError):
            EngineConfig(**bad)
    assert EngineConfig(theta=10, random_seed=3).run_id() == "theta=10__seed=3"
    assert len(report.grid(partition=["ccp", "lpa"], theta=[10, 20])) == 4


def test_stages_end_to_end(spark):
    n, pairs, of = clique_ring(10, 5)
    nodes = nodes_df(spark, n, feat=[[float(of[u] % 2), float(of[u] % 2 == 0)] for u in range(n)], label=[c % 2 for c in of])
    g = Graph(nodes, edges_df(spark, both(pairs)))
    config = EngineConfig(partition="louvain", agg_feat="mean", louvain_resolution=1.0, num_epochs=20)
    mapping = stages.partition(g, config)
    split, trained = stages.train(g, mapping, config)
    after, forgot = stages.unlearn_nodes(g, mapping, split, config)
    assert trained["last_loss"] <= trained["first_loss"] and forgot["deleted"] >= 1
    assert after.membership.select("node").distinct().count() == n - forgot["deleted"]
    want = masks.deletion_request(mapping.membership, split, config.unlearn_ratio, config.random_seed)
    assert not set(rows(want)) & {(u,) for _, u in rows(after.membership)}


def test_gradients_by_differences():
    import numpy as np

    rng = np.random.default_rng(0)
    g = models.Mapped(rng.normal(size=(5, 3)), np.array([0, 1, 0, 1, 0]), np.array([0, 1, 2, 3, 4]), np.array([1, 2, 3, 4, 0]), *[np.ones(5, bool)] * 3)
    for backbone in models.BACKBONES:
        layer, w = models._Layer(rng, backbone, 3, 2, 2), models._edge_weights(g, backbone)
        d = rng.normal(size=(5, 4))
        layer.forward(g, w, g.x)
        grads, _ = layer.backward(g, w, d)
        for p, grad in zip(layer.params, grads):
            at, h = (0,) * p.ndim, 1e-6
            p[at] += h
            up = (layer.forward(g, w, g.x) * d).sum()
            p[at] -= 2 * h
            down = (layer.forward(g, w, g.x) * d).sum()
            p[at] += h
            assert grad[at] == pytest.approx((up - down) / (2 * h), rel=1e-4, abs=1e-6)


def test_scores_of_predictions(spark):
    got = layers.scores(spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "label int, pred int")).first()
    assert got["accuracy"] == 0.5 and got["macro_f1"] == pytest.approx((2 / 3 + 0.5 + 0) / 3)


def test_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n0,1\n1,2\n")
    assert rows(files.read_edges_csv(spark, str(tmp_path / "e.csv"))) == [(0, 1), (1, 2)]
    (tmp_path / "f.csv").write_text("node_id,feature_id,value\n0,1,2.0\n0,1,3.0\n1,0,1.0\n")
    assert rows(files.read_features_csv(spark, str(tmp_path / "f.csv"))) == [(0, [0.0, 5.0]), (1, [1.0, 0.0])]
    store = files.ArtifactStore(spark, str(tmp_path / "store"))
    assert not store.has("membership", "a")
    assert store.save("membership", "a", members_df(spark, PARTS)).count() == 10 and store.has("membership", "a")
    files.write_metrics(spark, str(tmp_path / "m"), {"stage": "train", "x": 1})
    assert json.loads(json.dumps(files.read_metrics(spark, str(tmp_path / "m")).first().asDict()))["x"] == 1


def test_deletion_feed(spark, tmp_path):
    root, feed = str(tmp_path / "m"), tmp_path / "requests"
    feed.mkdir()
    members_df(spark, PARTS).write.parquet(deletions.version_path(root, 0))
    (feed / "1.json").write_text('{"node": 2, "request_id": "a"}\n')
    deletions.apply_feed(spark, str(feed), root, str(tmp_path / "cp")).awaitTermination(60)
    (feed / "2.json").write_text('{"node": 4, "request_id": "b"}\n')
    deletions.apply_feed(spark, str(feed), root, str(tmp_path / "cp")).awaitTermination(60)
    assert rows(deletions.latest(spark, root)[1]) == [(c, u) for c, us in PARTS.items() for u in us if u not in (2, 4)]


@pytest.mark.parametrize("seed", range(2))
def test_deletion_is_order_free(spark, seed):
    n, pairs, c2n = random_case(seed)
    m = members_df(spark, c2n)
    a, b = (spark.createDataFrame([(u,) for u in range(n) if u % 4 == k], "node long") for k in (0, 1))
    one = rows(unlearn.remove_nodes(unlearn.remove_nodes(m, a)[0], b)[0])
    assert one == rows(unlearn.remove_nodes(m, a.union(b))[0])
