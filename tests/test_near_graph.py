"""Graphs of near points by tiles: the same as by one shortest-path tree a source, and as SQL on copies and missing places."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from polisgrid.operators import graph
from polisgrid.plans.queries import ORACLE_SQL, QUERIES


def odd_places(folder):
    """embeddings of few points, some of them copies, some on a lattice whose paths tie, some without a place."""
    rng = np.random.default_rng(8)
    cloud = rng.normal(0, 0.012, (50, 3))
    lattice = [[0.1 + 0.004 * i, 0.1 + 0.004 * j, 0.0] for i in range(5) for j in range(4)]
    rows = [*cloud.tolist(), *lattice, *cloud[:6].tolist(), *lattice[:3], None, [0.0], [None, 0.0, 0.0]]
    table = pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([0] * len(rows), pa.int32())})
    pq.write_table(table, f"{folder}/embeddings.parquet")
    return str(folder)


def same_as_sql(spark, name, folder):
    d = duckdb.connect()
    d.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    cur = d.execute(ORACLE_SQL[name])
    want = sorted(dict(zip([c[0] for c in cur.description], r, strict=True)).items() for r in cur.fetchall())
    got = sorted(r.asDict().items() for r in QUERIES[name](spark, folder).collect())
    assert sorted(map(sorted, want)) == sorted(map(sorted, got)) and len(got) == 82


@pytest.mark.parametrize("sources", [7, 128])
def test_tiles_have_the_paths_of_single_sources(monkeypatch, sources):
    rng = np.random.default_rng(3)
    for step in (1.0, 0.001):  # on a lattice many paths tie, elsewhere rounding makes some that bend the shorter ones
        p = np.unique(np.round(rng.random((300, 2)) * 40 / step) * step, axis=0)
        x, y = p[:, 0], p[:, 1]
        d = np.hypot(x[:, None] - x, y[:, None] - y)
        src, dst = np.nonzero((d < 12) & ~np.eye(len(p), dtype=bool))
        g = graph.Csr(src, dst, np.rint(d[src, dst] * 1000), len(p))
        some = rng.choice(len(p), sources, replace=False)
        dist, begin, ends = graph.near_paths(x, y, some, 12.0, 20_000, 1000, 20.1)
        through = np.zeros(len(p))
        for k, s in enumerate(some.tolist()):
            far, order, preds, sigma = graph.single_source(g, s, 20_000, False)
            assert [far.get(v, 20_001) for v in range(len(p))] == dist[:, k].tolist()
            delta = dict.fromkeys(order, 0.0)
            for v in reversed(order):
                for u in preds[v]:
                    delta[u] += sigma[u] / sigma[v] * (1 + delta[v])
                through[v] += delta[v] if v != s else 0
        assert np.allclose(graph.path_shares(len(p), some, begin, ends), through)


def test_paths_that_round_down_are_followed_beyond_the_margin(spark):
    # hops of sqrt(2) count as 1: 180 of them lead to 254 from the start, 10 more than the limit and the first margin of 64
    n, limit = 300, 180
    points = spark.createDataFrame([(k, float(k), float(k)) for k in range(n)], "id long, x double, y double")
    got = {r.id: (r.total_depth, r.reached) for r in graph.near_measures(points, 1.5, float(limit), 0).collect()}
    near = [[abs(k - v) for v in range(n) if abs(k - v) <= limit] for k in range(n)]
    assert got == {k: (float(sum(near[k])), len(near[k])) for k in range(n)}


def test_near_centrality_holds_no_graph(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(graph, "BYTES_HELD", 0)
    same_as_sql(spark, "near_graph_centrality", odd_places(tmp_path))


def no_rows(*_, **__):
    raise AssertionError("distances of all pairs as rows")


def test_near_depths_make_no_rows_of_distances(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(graph, "shortest_paths", no_rows)
    same_as_sql(spark, "near_graph_depths", odd_places(tmp_path))


def test_near_choice_makes_no_rows_of_distances(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(graph, "shortest_paths", no_rows)
    same_as_sql(spark, "near_graph_choice", odd_places(tmp_path))
