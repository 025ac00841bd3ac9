"""Edge scores, labels and features against closed forms and plain-Python versions."""

import math
from collections import Counter

import numpy as np
import pytest

from tests.graphs import both, clique_ring, edges_df, members_df, nodes_df, random_case, rows
from terrane.operators import edges, features, labels, masks

PARTS = {0: [0, 3, 5], 1: [1, 3], 2: [2, 4, 6, 7], 3: [8]}


def brute_counts(pairs, c2n):
    of = {}
    for c, ns in c2n.items():
        for u in ns:
            of.setdefault(u, []).append(c)
    return Counter((a, b) for u, v in pairs for a in of.get(u, ()) for b in of.get(v, ()) if a != b)


def brute_scores(counts, c2n, method, reduction):
    out_d, in_d = Counter(), Counter()
    for (a, b), n in counts.items():
        out_d[a] += n
        in_d[b] += n
    got = {}
    for lo, hi in {tuple(sorted(p)) for p in counts}:
        s = counts.get((lo, hi), 0) if reduction == "source" else max(counts.get((lo, hi), 0), counts.get((hi, lo), 0))
        if s <= 0:
            continue
        o, i = out_d[lo], in_d[hi]
        l = math.log1p
        term = 0.0
        if o > 0 and i > 0:
            term = [s / math.sqrt(o * i) * s, l(s) / (l(o) + l(i)), l(s) ** 2 / math.sqrt(l(o) * l(i)), 0.0][method]
        score = term + s / len(set(c2n[lo]) | set(c2n[hi]))
        got[lo, hi] = got[hi, lo] = score
    return got


def as_dict(df):
    return {(a, b): s for a, b, s in rows(df)}


@pytest.mark.parametrize("seed", range(4))
def test_scores_match_plain_python(spark, seed):
    n, pairs, c2n = random_case(seed)
    m, e = members_df(spark, c2n), edges_df(spark, pairs)
    want = brute_counts(pairs, c2n)
    counts = edges.edge_counts(e, m).cache()
    assert as_dict(counts) == dict(want)
    for method in (0, 2, 3):
        for reduction in edges.REDUCTIONS:
            got = as_dict(edges.score_edges(counts, m, method, reduction))
            assert got == pytest.approx(brute_scores(want, c2n, method, reduction))


def test_closed_form_score(spark):
    """Two communities of three, joined by two edges one way and one the other: s = 2, degrees 2 and 2, union 6."""
    m = members_df(spark, {0: [0, 1, 2], 1: [3, 4, 5]})
    e = edges_df(spark, [(0, 3), (1, 5), (4, 2), (0, 1)])
    want = (2 / math.sqrt(2)) * (2 / math.sqrt(2)) + 2 / 6
    assert as_dict(edges.score_edges(edges.edge_counts(e, m), m, 0)) == pytest.approx({(0, 1): want, (1, 0): want})


def test_one_way_edges_by_reduction(spark):
    m = members_df(spark, {0: [0], 1: [1], 2: [2]})
    counts = spark.createDataFrame([(1, 0, 3), (1, 2, 1), (2, 1, 1)], "src_c long, dst_c long, n long")
    assert (0, 1) not in as_dict(edges.score_edges(counts, m, 0, "source"))
    assert as_dict(edges.score_edges(counts, m, 0, "max"))[0, 1] == pytest.approx(1.5)


def test_ring_scores(spark):
    n, pairs, of = clique_ring(5, 7)
    c2n = {c: [u for u in range(n) if of[u] == c] for c in range(5)}
    counts = edges.edge_counts(edges_df(spark, both(pairs)), members_df(spark, c2n))
    for method in range(4):
        want = brute_scores(brute_counts(both(pairs), c2n), c2n, method, "source")
        assert len(want) == 10 and as_dict(edges.score_edges(counts, members_df(spark, c2n), method)) == pytest.approx(want)


def test_bad_options(spark):
    m = members_df(spark, PARTS)
    counts = edges.edge_counts(edges_df(spark, [(0, 3)]), m)
    with pytest.raises(ValueError):
        edges.score_edges(counts, m, 7)
    with pytest.raises(ValueError):
        edges.score_edges(counts, m, 0, "mean")


def widest_gap(scores, share):
    xs = sorted(scores, reverse=True)
    xs = sorted(set(xs if not share else [x for x in set(xs) if xs.index(x) <= max(int(share * len(xs)), 1)]))
    gaps = [(b - a, -a) for a, b in zip(xs, xs[1:])]
    return -max(gaps)[1] if gaps else 0.0


def test_thresholds(spark):
    df = lambda xs: spark.createDataFrame([(0, 1, float(x)) for x in xs], "src_c long, dst_c long, score double")
    at = lambda xs, share: edges.score_threshold(df(xs), share).first()[0]
    rng = np.random.default_rng(8)
    cases = [[0.7], [2.0, 2.0], rng.integers(0, 40, 60).tolist(), rng.normal(5, 1, 80).round(2).tolist(), [1, 1, 1, 4, 9, 9, 16]]
    assert at(cases[2], -1) == 0.0 and edges.score_threshold(df([1.0]).limit(0), 0).first()[0] == 0.0
    for xs in cases:
        for share in (0, 0.1, 0.5):
            assert at(xs, share) == pytest.approx(widest_gap([float(x) for x in xs], share)), (xs, share)


def test_no_plan_gathers_scores_or_ids_in_one_task(spark):
    df = spark.range(1000).selectExpr("id src_c", "id + 1 dst_c", "id * 0.5 score")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit" not in plan(masks.first_by_hash(df.selectExpr("src_c node"), "node", 10**6, 3))
    held = plan(masks.first_by_hash(df.selectExpr("src_c node"), "node", 200, 3))
    assert "GlobalLimit 200" not in held  # only the rows at the cut are sorted


def test_adam_fold_matches_loop(spark):
    counts = spark.createDataFrame([(0, 1, 20), (1, 0, 2)], "src_c long, dst_c long, n long")
    feats = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "community long, feat array<double>")
    got = as_dict(edges.fitted_weights(counts, feats))
    c = 1 / math.sqrt(2)
    assert got == pytest.approx({(0, 1): edges.adam_closed(20, c), (1, 0): edges.adam_closed(2, c)}, abs=1e-4)
    assert as_dict(edges.fitted_weights(counts, feats, steps=0)) == pytest.approx({(0, 1): (20 + c) / 2, (1, 0): (2 + c) / 2})


def test_majority_and_elbow(spark):
    votes = spark.createDataFrame([(0, x) for x in (3, 1, 3, 2, 3)] + [(1, x) for x in (5, 2, 5, 2)] + [(2, 7)], "community long, label int")
    assert rows(labels.majority(votes)) == [(0, 3), (1, 2), (2, 7)]
    far = [0.4, 0.9, 1.1, 1.2, 3.6, 3.7, 4.0]
    dist = spark.createDataFrame([(0, i, 0, d) for i, d in enumerate(far)] + [(1, 9, 0, 2.5)], "community long, node long, label int, distance double")
    assert rows(labels.elbows(dist)) == [(0, widest_gap(far, 0)), (1, None)]
    assert labels.voters(dist).where("community = 0").count() == 4


def test_pca_small_is_mean_and_large_is_bounded(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 5))
    nodes = nodes_df(spark, 30, feat=x.tolist())
    m = members_df(spark, {0: range(30), 1: range(4)})
    got = {c: f for c, f in rows(features.pca_features(features.members(nodes, m)))}
    assert got[1] == pytest.approx(x[:4].mean(axis=0))
    assert len(got[0]) == 5 and abs(sum(got[0])) < 1e-9


def test_two_means_guards_single_members(spark):
    nodes = nodes_df(spark, 5, feat=[[0.0], [0.1], [0.2], [9.0], [7.0]], label=[1, 1, 2, 3, 4])
    m = members_df(spark, {0: [0, 1, 2, 3], 1: [4]})
    assert rows(labels.label_by_two_means(features.members(nodes, m))) == [(0, 1), (1, 4)]
