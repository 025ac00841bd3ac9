"""Toy graphs for the tests."""

from __future__ import annotations

import random


def edges_df(spark, pairs):
    return spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "src long, dst long")


def members_df(spark, c2n):
    return spark.createDataFrame([(int(c), int(n)) for c, ns in c2n.items() for n in ns], "community long, node long")


def nodes_df(spark, n, feat=None, label=None):
    rows = [(i, [float(x) for x in feat[i]] if feat else [1.0], int(label[i]) if label else 0) for i in range(n)]
    return spark.createDataFrame(rows, "node long, feat array<double>, label int")


def both(pairs):
    return [p for a, b in pairs for p in ((a, b), (b, a))]


def clique_ring(cliques, size):
    """Cliques in a ring, neighbours joined by one edge: nodes, undirected pairs, clique of each node."""
    pairs = []
    for c in range(cliques):
        own = range(c * size, (c + 1) * size)
        pairs += [(i, j) for i in own for j in own if i < j]
        pairs.append((c * size + size - 1, ((c + 1) % cliques) * size))
    return cliques * size, pairs, [i // size for i in range(cliques * size)]


def random_case(seed):
    rng = random.Random(seed)
    n, k = rng.randint(10, 40), rng.randint(2, 8)
    c2n = {c: [] for c in range(k)}
    for u in range(n):
        for c in rng.sample(range(k), min(k, rng.randint(0, 3))):
            c2n[c].append(u)
    c2n = dict(enumerate(ns for ns in c2n.values() if ns))
    pairs = both([(rng.randrange(n), rng.randrange(n)) for _ in range(3 * n)])
    pairs += [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
    return n, [p for p in pairs if p[0] != p[1]], c2n


def rows(df):
    return sorted(tuple(r) for r in df.collect())
