"""Named queries against their SQL on tables made for one case each."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.graphs import both, clique_ring, nodes_df
from terrane import catalog
from terrane.functions.vectors import round_half_away
from terrane.operators import detect, graph, layers, similarity


def write_vectors(path, vectors):
    columns = [pa.array(range(len(vectors)), pa.int64()), pa.array(vectors.astype(np.float32).tolist(), pa.list_(pa.float32())), pa.array([i % 10 for i in range(len(vectors))], pa.int32())]
    pq.write_table(pa.table(columns, ["vec_id", "embedding", "label"]), path / "embeddings.parquet")


def by_spark_and_sql(spark, path, name):
    """Rows as texts, since -0.0 equals 0.0."""
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/embeddings.parquet'")
    columns = catalog.queries()[name](spark, str(path))
    got = sorted(repr([list(x) if isinstance(x, list) else x for x in r]) for r in columns.collect())
    cur = con.execute(catalog.oracle_sql()[name])
    assert [c[0] for c in cur.description] == columns.columns
    return got, sorted(repr(list(r)) for r in cur.fetchall())


def test_rounding(spark):
    """Halves in binary go away from zero, the sign of zero stays, and what has no such digit is left alone."""
    values = [0.5, -0.5, 2.5, -2.5, 0.49999999999999994, -0.25, 0.0, -0.0, 1e300, -1e308, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    for digits in (0, 6):
        expected = [duckdb.execute("select round(?::double, ?::int)", [x, digits]).fetchone()[0] for x in values]
        assert repr([r[0] for r in df.select(round_half_away(F.col("x"), digits)).collect()]) == repr(expected)


@pytest.mark.parametrize("name", ["feature_mean", "feature_robust", "gcn_layer", "sage_layer", "propagate_1"])
def test_signs_of_zeros_are_those_of_the_sql(spark, tmp_path, name):
    rng = np.random.default_rng(1)
    write_vectors(tmp_path, np.tile(rng.normal(size=(12, 64)) * 1e-8, (3, 1)))
    got, expected = by_spark_and_sql(spark, tmp_path, name)
    assert got == expected and any("-0.0" in x for x in expected) == (name != "propagate_1")


def test_signs_of_zeros_of_embeddings(spark, tmp_path):
    """Pairs of equal vectors at right angles to a column of the weights, but for their rounding to floats."""
    x, w = np.random.default_rng(2).normal(size=(12, 64)), layers.hashed_weights(64, 16, catalog.SEED)[:, 0]
    write_vectors(tmp_path, np.tile(x - np.outer(x @ w, w) / (w @ w), (2, 1)))
    got, expected = by_spark_and_sql(spark, tmp_path, "random_embedding_gcn")
    assert got == expected and any("-0.0," in x for x in expected)


def counted_edges(spark, pairs):
    """Edges, and an accumulator of how many rows were made."""
    made = spark.sparkContext.accumulator(0)

    def one(pair):
        made.add(1)
        return pair

    return spark.createDataFrame(spark.sparkContext.parallelize(pairs, 2).map(one), "src long, dst long"), made


def test_speaker_listener_makes_its_edges_once(spark):
    pairs = both(clique_ring(4, 4)[1])
    edges, made = counted_edges(spark, pairs)
    assert detect.speaker_listener(nodes_df(spark, 16), edges, rounds=4).count() >= 16
    assert made.value == len(pairs)


def test_embedding_communities_makes_its_edges_once(spark):
    pairs = both(clique_ring(4, 4)[1])
    edges, made = counted_edges(spark, pairs)
    nodes = nodes_df(spark, 16, feat=[[i % 4, i // 4] for i in range(16)])
    assert detect.embedding_communities(nodes, edges, 7, k=4).count() >= 16
    assert made.value == len(pairs)


def test_similar_pairs_in_blocks(spark):
    """Both orders of each pair, whatever blocks the rows fall into."""
    x = np.random.default_rng(3).normal(size=(40, 4))
    cosine = (x @ x.T) / np.outer(*[np.linalg.norm(x, axis=1)] * 2)
    expected = sorted((i, j) for i in range(40) for j in range(40) if i != j and cosine[i, j] >= 0.3)
    found = similarity.similar_pairs(nodes_df(spark, 40, feat=x.tolist()), 0.3, block_rows=9).collect()
    assert sorted((r["a"], r["b"]) for r in found) == expected


def test_sums_over_in_edges(spark, monkeypatch):
    """Repeated edges and vectors, sources without a vector, and vectors that a batch cuts off from their edges."""
    monkeypatch.setattr(graph, "SUM_ROWS", 5)
    rng = np.random.default_rng(4)
    x, pairs = rng.normal(size=(30, 3)), [tuple(p) for p in rng.integers(0, 40, size=(400, 2)).tolist()] + [(i, 7) for i in range(30)]
    held = [*range(30), 3]
    vectors = spark.createDataFrame([(i, x[i].tolist()) for i in held], "src long, feat array<double>")
    expected = {}
    for u, v in pairs:
        for i in held:
            if i == u:
                expected[v] = expected.get(v, 0) + x[i]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["dst"]: r["feat"] for r in graph.neighbour_sums(edges, vectors).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(np.allclose(got.get(v, 0), s) for v, s in expected.items())
    assert all(np.allclose(got[v], 0) for v in got.keys() - expected.keys())


def test_wide_embeddings_make_no_row_for_a_position(spark):
    """A plan with a row for each edge and position moves 128 times the edges."""
    pairs = both(clique_ring(4, 4)[1])
    out = layers.random_embedding(nodes_df(spark, 16), spark.createDataFrame(pairs, "src long, dst long"), "GCN", 128, 7)
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "posexplode" not in plan and "mapinarrow" in plan
