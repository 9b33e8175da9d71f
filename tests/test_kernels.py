"""Worked examples, invariants and brute force for what SQL does not express."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from polisgrid.functions import geom
from polisgrid.operators import design, graph, network, planning, resources, spatial, visibility


def test_energy_rounds_half_to_even(spark):
    parts = spark.createDataFrame([(1, "R", 125.0)], "building long, function string, amount double")
    coef = spark.createDataFrame([("R", 0.02, 0.05)], "function string, lo_rate double, hi_rate double")
    r = resources.energy(parts, coef).first()
    assert (r.lo, r.hi, r.use) == (2, 6, 35064.0)
    assert spark.range(1).select(resources.energy_carbon(F.lit(35064.0)).alias("c")).first().c == pytest.approx(26.298)


def test_missing_function_raises(spark):
    parts = spark.createDataFrame([(1, "Q", 1.0)], "building long, function string, amount double")
    coef = spark.createDataFrame([("R", 0.02, 0.05)], "function string, lo_rate double, hi_rate double")
    with pytest.raises(Exception, match="no coefficients"):
        resources.energy(parts, coef).collect()


def test_far(spark):
    blocks = spark.createDataFrame([(1, "R", 100.0, 1.0), (2, "R", 100.0, 3.0)], "block_id long, landuse string, area double, acc double")
    target = spark.createDataFrame([("R", 200.0)], "landuse string, target double")
    got = {r.block_id: r.far for r in planning.allocate_far(blocks, target).collect()}
    assert got == {1: 0.8, 2: 1.2}


def test_gravity(spark):
    sites = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], "sid long, x double, y double")
    targets = spark.createDataFrame([(0.0, 4.0)], "tx double, ty double")
    assert {r.sid: r.score for r in planning.gravity(sites, targets, 2.0).collect()} == {1: 0.0, 2: 1.0}


def test_path_centrality(spark):
    v = spark.createDataFrame([(0,), (1,), (2,)], "id long")
    e = graph.undirected(spark.createDataFrame([(0, 1, 10.0), (1, 2, 10.0)], "src long, dst long, w double"))
    got = {r.id: r for r in graph.measures(graph.centrality(v, e)).collect()}
    assert [got[k].total_depth for k in range(3)] == [30, 20, 30]
    assert [got[k].choice for k in range(3)] == [0, 2, 0]
    assert [round(got[k].integration, 6) for k in range(3)] == [0.3, 0.45, 0.3]
    assert [got[k].mean_depth for k in range(3)] == [15, 10, 15]


def test_centrality_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    n = 12
    pairs = {(a, b): float(rng.integers(1, 5)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.3}
    e = graph.undirected(spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "src long, dst long, w double"))
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for (a, b), w in pairs.items():
        d[a, b] = d[b, a] = w
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    sigma = np.eye(n)
    for s in range(n):
        for t in sorted(range(n), key=lambda t: d[s, t]):
            if t != s and np.isfinite(d[s, t]):
                sigma[s, t] = sum(sigma[s, u] for u in range(n) if (min(u, t), max(u, t)) in pairs and u != t and d[s, u] + pairs[min(u, t), max(u, t)] == d[s, t])
    choice = [sum(sigma[s, v] * sigma[v, t] / sigma[s, t] for s in range(n) for t in range(n) if len({s, t, v}) == 3 and np.isfinite(d[s, t]) and d[s, v] + d[v, t] == d[s, t]) for v in range(n)]
    got = {r.id: r for r in graph.centrality(spark.range(n), e).collect()}
    for v in range(n):
        assert got[v].choice == pytest.approx(choice[v])
        assert got[v].total_depth == pytest.approx(d[v][np.isfinite(d[v])].sum())
    paths = {(r.source, r.id): r.dist for r in graph.shortest_paths(e, spark.range(n)).collect()}
    assert paths == {(a, b): d[a, b] for a in range(n) for b in range(n) if np.isfinite(d[a, b])}


def test_components(spark):
    got = {r.id: r.root for r in graph.components(spark.range(5), spark.createDataFrame([(0, 1), (3, 4)], "src long, dst long")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}


def test_complete_linkage():
    x = np.array([0.0, 1, 3, 7])
    assert planning.complete_linkage(np.abs(x[:, None] - x), [2, 4]) == [[[0, 1], [2], [3]], [[0, 1, 2], [3]]]


def test_divide_line(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0)], "id long, ax double, ay double, bx double, by double")
    assert [r.x for r in spatial.divide_line(lines, 3.0).orderBy("k").collect()] == pytest.approx([3, 6, 9])
    assert [r.x for r in spatial.divide_line(lines, 5.0).collect()] == [5.0]
    short = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 0.0)], "id long, ax double, ay double, bx double, by double")
    assert [r.x for r in spatial.divide_line(short, 5.0).collect()] == [1.0]


def test_diameter_steps(spark):
    d = spark.createDataFrame([(f,) for f in (0.0, 1.0, 1.5, 2.5)], "f double")
    assert [r.d for r in d.select(network.diameter(F.col("f"), [10.0, 20.0, 30.0], [1.0, 2.0]).alias("d")).collect()] == [10.0, 10.0, 20.0, 30.0]


def test_setback(spark):
    d = spark.createDataFrame([(f,) for f in (0, 3, 4, 33, 34)], "f int")
    assert [r.s for r in d.select(design.band(F.col("f"), design.SETBACK_HOMES).alias("s")).collect()] == [4.5, 3.0, 4.5, 4.5, 6.5]


def test_waste_methods(spark):
    d = spark.createDataFrame([(m,) for m in (0, 1, 2, 9)], "m int")
    assert [r.t for r in d.select(resources.waste_carbon(F.lit(2.0), F.col("m")).alias("t")).collect()] == pytest.approx([4.26, 0.642, 0.24, 0])


def test_power_fit(spark):
    d = spark.createDataFrame([(1.0, 3.0), (2.0, 6.0), (4.0, 12.0)], "x double, y double")
    r = planning.power_regression(d, []).first()
    assert (r.a, r.b, r.r2) == pytest.approx((3, 1, 1))


def test_programs():
    assert sum(n * a for n, a in zip(design.count_program([1200.0, 2400.0], 4000.0), [1200.0, 2400.0], strict=True)) == 3600
    assert design.count_program([500.0], 100.0) == [1]
    assert design.floor_program([100.0, 200.0], [(1, 3), (1, 4)], 900.0) in ([1, 4], [3, 3])


def test_split_keeps_area():
    ring = [(0.0, 0.0), (30.0, 0.0), (36.0, 14.0), (4.0, 20.0)]
    parts = design.split_ring(ring, [0.5, 0.3, 0.2])
    whole = abs(design.ring_area(ring))
    assert [abs(design.ring_area(p)) / whole for _, p in parts] == pytest.approx([0.5, 0.3, 0.2], abs=1e-6)


def test_voronoi_shares_cover_the_site():
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 6.0), (0.0, 6.0)]
    shares = network.voronoi_shares(ring, [(1.0, 1.0), (8.0, 2.0), (5.0, 5.0)])
    assert sum(shares) == pytest.approx(60.0)


def test_a_wall_hides_what_is_behind(spark):
    def quad(tri, x):
        return [(tri, (x, -1.0, 0.0), (x, 1.0, 0.0), (x, 1.0, 3.0)), (tri + 1, (x, -1.0, 0.0), (x, 1.0, 3.0), (x, -1.0, 3.0))]

    pt = "struct<x:double,y:double,z:double>"
    tri = spark.createDataFrame([(t, p, r, q) for t, p, q, r in quad(0, 2.0) + quad(2, 4.0)], f"tri long, p {pt}, q {pt}, r {pt}")
    v = spark.createDataFrame([(1, 0.0, 0.0, 1.0)], "vid long, x double, y double, z double")
    assert {r.tri for r in visibility.exposure_3d(v, tri, 50.0).collect()} == {0, 1}
    far = spark.range(1).select(visibility.decayed(F.lit(10.0), F.lit(0.0), 0.5).alias("a")).first().a
    assert far == pytest.approx(10 * math.exp(-0.5))


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    p, q = rng.uniform(-500, 500, (200, 2)), rng.uniform(-500, 500, (30, 2))
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(p)], "rid long, rx double, ry double")
    queries = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(q)], "lid long, lx double, ly double")
    got = {(r.lid, r["rank"]): r.rid for r in spatial.nearest(queries, points, 3, 20.0).collect()}
    want = np.argsort(((q[:, None] - p[None]) ** 2).sum(2), axis=1, kind="stable")[:, :3]
    assert got == {(k, j + 1): want[k, j] for k in range(30) for j in range(3)}
    assert spatial.nearest(queries, points.limit(0), 3, 20.0).count() == 0


def test_snap_is_one_hop(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.9, 0.0), (3, 1.8, 0.0)], "id long, x double, y double")
    assert {r.id: r.rep for r in spatial.snap_points(p, 1.0).collect()} == {1: 1, 2: 1, 3: 2}


def test_sun_is_lower_in_the_north(spark):
    r = spark.range(1).select(*(design.sun_distance(F.lit(30.0), F.lit(lat), F.lit(lon), 8.0).alias(c) for c, (lon, lat) in design.CITIES.items())).first()
    assert 15 < r.ShenZhen < r.ShangHai < r.TianJin < r.BeiJing < 80


def test_inside_ring(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0))])
    r = spark.range(1).select(geom.inside_ring(F.lit(1.0), F.lit(1.0), ring).alias("a"), geom.inside_ring(F.lit(5.0), F.lit(1.0), ring).alias("b"), geom.signed_area(ring).alias("s")).first()
    assert (r.a, r.b, r.s) == (True, False, 16.0)
