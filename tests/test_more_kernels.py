"""Cleaning, clusters, graphs, layouts and meshes against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from polisgrid.operators import cleaning, design, graph, lines, network, planning, visibility
from polisgrid.sources import files


def test_meeting_places():
    at = lambda *p: np.array([p], float)
    row, side, place = cleaning.meet(at(0, 0, 0), at(2, 0, 0), at(1, -1, 0.02), at(1, 1, 0.02), 0.05)
    assert side.tolist() == [0, 1] and np.allclose(place, [[1, 0, 0.01]] * 2)
    assert not len(cleaning.meet(at(0, 0, 0), at(2, 0, 0), at(1, -1, 0.2), at(1, 1, 0.2), 0.05)[0])  # one passes above
    row, side, place = cleaning.meet(at(0, 0, 0), at(2, 0, 0), at(1, 0.01, 0), at(1, 5, 0), 0.05)  # an end touches
    assert side.tolist() == [0] and np.allclose(place, [[1, 0.01, 0]])
    assert not len(cleaning.meet(at(0, 0, 0), at(2, 0, 0), at(2, 0, 0), at(3, 1, 0), 0.05)[0])  # two ends
    row, side, place = cleaning.meet(at(0, 0, 0), at(4, 0, 0), at(3, 0, 0), at(9, 0, 0), 0.05)  # along each other
    assert sorted(zip(side.tolist(), place[:, 0].tolist(), strict=True)) == [(0, 3.0), (0, 4.0), (1, 3.0), (1, 4.0)]


def test_clusters_are_those_of_the_plain_method():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 25):
        p = rng.integers(0, 12, (n, 2)).astype(float)  # ties
        dist = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
        clusters, out = {k: [k] for k in range(n)}, []
        far = lambda a, b: max(dist[x, y] for x in clusters[a] for y in clusters[b])  # noqa: E731, B023
        fresh = n
        for limit in (2.0, 5.0, 9.0):
            while len(clusters) > 1:
                least, a, b = min((far(a, b), a, b) for a, b in itertools.combinations(sorted(clusters), 2))
                if least >= limit:
                    break
                clusters[fresh] = sorted(clusters.pop(a) + clusters.pop(b))
                fresh += 1
            out.append(sorted(clusters.values()))
        assert planning.complete_linkage(dist, [9.0, 2.0, 5.0]) == out


def test_programs_are_the_best_of_all():
    rng = np.random.default_rng(6)
    for _ in range(20):
        areas, cap = rng.integers(2, 9, 3).astype(float).tolist(), float(rng.integers(1, 60))
        every = [c for c in itertools.product(range(31), repeat=3) if sum(x * y for x, y in zip(c, areas, strict=True)) <= cap]
        best = max(every, key=lambda c: (sum(x * y for x, y in zip(c, areas, strict=True)), -sum(c), c))
        assert design.count_program(areas, cap) == (list(best) if any(best) else [1, 0, 0])
        ranges = [(1, 4), (2, 5), (0, 6)]
        every = [c for c in itertools.product(*(range(a, b + 1) for a, b in ranges)) if sum(x * y for x, y in zip(c, areas, strict=True)) <= cap]
        want = max(every, key=lambda c: (sum(x * y for x, y in zip(c, areas, strict=True)), -sum(c), c)) if every else [a for a, _ in ranges]
        assert design.floor_program(areas, ranges, cap) == [max(1, x) for x in want]
    assert design.count_program([], 9.0) == [] and len(design.count_program([5.0, 7.0, 9.0, 11.0], 50.0)) == 4


def test_ears():
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 3.0), (4.0, 3.0), (4.0, 4.0), (0.0, 4.0)]
    for own in (ring, ring[::-1]):
        t = visibility.ear_clip(own)
        area = lambda a, b, c: ((own[b][0] - own[a][0]) * (own[c][1] - own[a][1]) - (own[b][1] - own[a][1]) * (own[c][0] - own[a][0])) / 2  # noqa: E731, B023
        assert len(t) == 6 and all(area(*x) > 0 for x in t) and sum(area(*x) for x in t) == pytest.approx(10.0)
    with pytest.raises(ValueError, match="simple"):
        visibility.ear_clip([(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0), (-1.0, 1.0), (3.0, 1.0)])


def test_chains_in_order(spark):
    p = [(0, 0), (1, 0), (2, 0), (3, 0), (3, 1), (4, 0)]
    rows = [(5, p[1], p[0]), (3, p[1], p[2]), (8, p[3], p[2]), (9, p[3], p[4]), (4, p[3], p[5])]
    loop = [(20, (9, 9), (9, 8)), (21, (8, 8), (9, 8)), (22, (8, 8), (9, 9))]
    s = spark.createDataFrame([(k, tuple(map(float, a)), tuple(map(float, b))) for k, a, b in rows + loop], "id long, a struct<x:double,y:double>, b struct<x:double,y:double>")
    got = {}
    for r in sorted(graph.chain_order(s).collect(), key=lambda r: (r.chain, r.seq)):
        got.setdefault(r.chain, []).append((r.id, (r.a.x, r.a.y), (r.b.x, r.b.y)))
    assert [x[0] for x in got[3]] == [5, 3, 8] and got[3][0][1] == (0, 0) and all(a[2] == b[1] for a, b in zip(got[3], got[3][1:], strict=False))
    assert [x[0] for x in got[9]] == [9] and [x[0] for x in got[4]] == [4]
    assert [x[0] for x in got[20]] == [20, 21, 22] and got[20][2][2] == (9, 9)


def test_centrality_in_a_radius_and_among_what_it_reaches(spark):
    rng = np.random.default_rng(7)
    n, w = 14, {}
    for _ in range(26):
        a, b = rng.choice(n, 2, replace=False).tolist()
        w[a, b] = w[b, a] = float(rng.integers(1, 6))
    edges = spark.createDataFrame([(a, b, x, float((a * b) % 3 + 1)) for (a, b), x in w.items()], "src long, dst long, w double, turn double")

    def dist(source, weights, within=None):
        d = {source: 0.0}
        for _ in range(n):
            for (a, b), x in weights.items():
                if a in d and (within is None or b in within):
                    d[b] = min(d.get(b, math.inf), d[a] + x)
        return d

    turns = {k: float((k[0] * k[1]) % 3 + 1) for k in w}
    got = {r.id: r for r in graph.centrality(spark.range(n).withColumn("limit", F.col("id") % 4 + 2.0), edges, second="turn").collect()}
    for s in range(n):
        near = {v for v, x in dist(s, w).items() if x <= s % 4 + 2}
        d = dist(s, turns, near)
        assert (got[s].reached, got[s].total_depth) == (len(d), sum(d.values()))


def test_rationality_uses_all_land(spark):
    rng = np.random.default_rng(8)
    area = {k: float(x) for k, x in enumerate(rng.integers(3000, 60000, 30))}
    blocks = spark.createDataFrame(list(area.items()), "block_id long, area double")
    levels = ["City", "District", "T15", "T10", "T5"]
    clusters = {(lv, k): k // (30 >> n) if 30 >> n else k for n, lv in enumerate(levels) for k in area}
    acc = {(lv, k): float(rng.random()) for lv in levels for k in area}
    shares = {"C": 0.2, "GIC": 0.1, "M": 0.08, "W": 0.04, "R": 0.58}
    out = planning.rationality(
        blocks,
        spark.createDataFrame([(lv, c, k) for (lv, k), c in clusters.items()], "level string, cluster_id long, block_id long"),
        spark.createDataFrame([(lv, k, x) for (lv, k), x in acc.items()], "level string, block_id long, acc double"),
        shares,
    )
    got = {}
    for r in out.collect():
        got[r.block_id, r.landuse, r.level] = got.get((r.block_id, r.landuse, r.level), 0) + r.area
    # The same, one block at a time.
    left, want, total = dict(area), {}, sum(area.values())
    for level in levels:
        part, uses = planning.service_shares(shares, level, "City")
        members = {}
        for k in area:
            members.setdefault(clusters[level, k], []).append(k)
        open_ = {c: ks for c, ks in members.items() if sum(left[k] for k in ks) >= 0.6 * sum(area[k] for k in ks)}
        whole = sum(area[k] for ks in open_.values() for k in ks)
        for _, ks in sorted(open_.items()):
            mine = total * part * sum(area[k] for k in ks) / whole
            ks = [k for k in ks if left[k] > 0]
            order = [(u, mine * uses[u]) for u in ("C", "GIC", "W", "M") if u in uses]
            for j, u, a in planning.greedy_fill([left[k] for k in ks], [acc[level, k] for k in ks], order, planning.LEAST_PARCEL[level], {"M", "W"}):
                want[ks[j], u, level] = want.get((ks[j], u, level), 0) + a
                left[ks[j]] = max(0.0, left[ks[j]] - a)
    want |= {(k, "R", None): x for k, x in left.items() if x > 1e-9}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert sum(got.values()) == pytest.approx(total)


def test_split_by_use(spark):
    square = [{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}, {"x": 10.0, "y": 10.0}, {"x": 0.0, "y": 10.0}]
    blocks = spark.createDataFrame([(1, square), (2, square)], "block_id long, shell array<struct<x:double,y:double>>")
    given = spark.createDataFrame([(1, "C", 30.0), (1, "R", 70.0), (2, "R", 100.0)], "block_id long, landuse string, area double")
    got = {(r.block_id, r.landuse): round(r.area, 3) for r in planning.split_by_use(blocks, given).collect()}
    assert got == {(1, "C"): 30.0, (1, "R"): 70.0, (2, "R"): 100.0}


def test_far_by_level_and_shares(spark):
    blocks = spark.createDataFrame([(k, u, lv, 1000.0, 0.5 + k % 3) for k, (u, lv) in enumerate([("C", "T10"), ("C", "T5"), ("C", "T5"), ("R", "T5"), ("R", "T5")])], "block_id long, landuse string, level string, area double, acc double")
    out = planning.allocate_far_by_level(blocks, spark.createDataFrame([("C", 2600.0), ("R", 4000.0)], "landuse string, target double"), "T10").collect()
    built = {}
    for r in out:
        built[r.landuse, r.level] = built.get((r.landuse, r.level), 0) + r.far * 1000
    assert built["C", "T10"] == pytest.approx(2600 * 6 / 13, rel=0.05) and built["C", "T5"] == pytest.approx(2600 * 7 / 13, rel=0.06) and built["R", "T5"] == pytest.approx(4000, rel=0.03)
    with pytest.raises(Exception, match="given twice"):
        planning.checked_shares(spark.createDataFrame([("R:0.2",), ("R:0.3",)], "t string"), "t").collect()


def test_overrides_cover_every_site(spark):
    base = spark.createDataFrame([(1, 2.0), (2, 3.0)], "site_id long, far double")
    with pytest.raises(ValueError, match="far"):
        design.override(base, spark.createDataFrame([(1, 9.0)], "site_id long, far double"), "site_id", ["far"], whole=True)


def test_fillets(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))])
    got = [(p.x, p.y) for p in spark.range(1).select(design.fillet(ring, 2.0, 16).alias("r")).first().r]
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(got, got[1:], strict=False))) / 2
    assert area == pytest.approx(100 - (4 - math.pi) * 4, rel=1e-3) and got[0] == got[-1]


def test_flipped_edges(spark):
    faces = spark.createDataFrame([(1, 0, [0, 1, 2]), (1, 1, [0, 2, 3])], "mesh long, face int, v array<int>")
    got = {frozenset(r.v) for r in visibility.flip_edge(faces, spark.createDataFrame([(1, 2, 0)], "mesh long, a int, b int")).collect()}
    assert got == {frozenset((0, 1, 3)), frozenset((2, 1, 3))}


def test_attributes_by_type(spark):
    text = '{"a": null, "b": true, "c": "x", "d": {"e": 1}, "f": [1], "g": 7, "h": 7000000000, "i": 2.5, "j": 3.0}'
    v = files.typed(F.lit(text))
    got = {k: spark.range(1).select(files.attribute(v, k).alias("a")).first().a for k in "abcdfghijz"}
    assert [got[k].kind for k in "abcdfghijz"] == ["null", "bool", "string", "table", "array", "int", "double", "double", "double", "null"] or got["j"].kind == "int"
    assert got["g"].int_value == 7 and got["h"].double_value == 7e9 and got["i"].double_value == 2.5


def test_network_features_and_coefficients(spark, tmp_path):
    (tmp_path / "net.xml").write_text('<network><nodes><node id="1" x="0" y="0"/><node id="2" x="3" y="4"/></nodes><links><link id="a" from="1" to="2" modes="car, bus"/></links></network>')
    links = files.read_network(spark, str(tmp_path / "net.xml"))
    assert links.first().modes == ["car", "bus"]
    one, many = (files.network_features(links, split).first().value for split in (False, True))
    assert '"modes":"car,bus"' in one and '"modes":["car","bus"]' in many and '"coordinates":[[0.0,0.0],[3.0,4.0]]' in one
    (tmp_path / "i.xml").write_text('<I><Block Type="R"><EConsumption>1,2</EConsumption><WConsumption>3,4</WConsumption><GConsumption>5,6</GConsumption></Block><Population Type="0" Layer="1,6" Index="45"/></I>')
    assert files.read_blocks(spark, str(tmp_path / "i.xml")).first().w_hi == 4.0
    assert tuple(files.read_population(spark, str(tmp_path / "i.xml")).first()) == (0, 1, 6, 45)


def test_roots_and_curves():
    assert design.bisect(lambda x: x * x - 2, 0, 2) == pytest.approx(2**0.5) and design.newton(lambda x: x * x - 2, lambda x: 2 * x, 1.0) == pytest.approx(2**0.5)
    assert design.parabola((0, 1), (1, 6), (2, 17)) == pytest.approx((3, 2, 1))
    with pytest.raises(ValueError, match="signs"):
        design.bisect(lambda x: x * x + 1, 0, 1)


def test_a_walk_in_depth(spark):
    e = spark.createDataFrame([(0, 2), (0, 1), (1, 3), (3, 2), (2, 4), (9, 0)], "src long, dst long")
    assert [r.id for r in sorted(graph.depth_first(e, 0).collect(), key=lambda r: r.n)] == [0, 1, 3, 2, 4]


def test_trees_strips_and_near_cuts(spark):
    square = [{"x": 0.0, "y": 0.0}, {"x": 60.0, "y": 0.0}, {"x": 60.0, "y": 20.0}, {"x": 0.0, "y": 20.0}]
    s = spark.createDataFrame([(1, square, 60.0, 0.0, 0.0)], "site_id long, shell array<struct<x:double,y:double>>, width double, u0 double, turn double")
    got = design.place_trees(s).collect()
    want = sum(a for a in (math.pi * (design.TREE_CANOPIES[k % 6] / 2) ** 2 for k in range(len(got))))
    assert all(0 < r.x < 60 and 0 < r.y < 20 for r in got) and want >= 360 > want - math.pi * 4.5**2
    strips = design.courtyards(s).collect()
    assert strips and all(16 <= max(p.x for p in r.shell) - min(p.x for p in r.shell) <= 24 for r in strips)
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 2.0), (0.0, 2.0)]
    assert [round(abs(design.ring_area(x)), 6) for _, x in design.split_ring(ring, [1, 3], design.halve_box)] == [5.0, 15.0]


def test_demand_of_junctions(spark):
    square = [{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}, {"x": 10.0, "y": 10.0}, {"x": 0.0, "y": 10.0}]
    sites = spark.createDataFrame([(1, square, 100.0), (2, square, 40.0)], "site long, shell array<struct<x:double,y:double>>, demand double")
    ends = spark.createDataFrame([(1, 7, 0.0, 5.0), (1, 8, 6.0, 5.0), (2, 8, 3.0, 3.0)], "site long, tid long, x double, y double")
    assert {r.tid: round(r.demand, 6) for r in network.junction_demand(sites, ends).collect()} == {7: 30.0, 8: 110.0}


def test_sites_are_connected_beside_each_other(spark):
    box = lambda x, y, w, h: [{"x": x + a * w, "y": y + b * h} for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]
    sites = spark.createDataFrame([(1, box(0.0, 1.0, 4.0, 2.0)), (2, box(0.0, 4.0, 4.0, 2.0))], "site long, shell array<struct<x:double,y:double>>")
    roads = spark.createDataFrame([(5, -9.0, 0.0, 9.0, 0.0)], "road long, ax double, ay double, bx double, by double")
    got = {(r.site, r.k): (r.x, r.y, r.rx, r.ry) for r in network.connect_sites(sites, roads, 20.0).collect()}
    assert got[1, 0] == (2.0, 1.0, 2.0, 0.0) and (1, 2) in got and not any(s == 2 and k in (0, 2) for s, k in got)


def test_lines_by_their_middles(spark):
    ring = [{"x": a, "y": b} for a, b in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0))]
    pts = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = spark.createDataFrame([(1, pts((-1, 1), (1, 1), (3, 1))), (2, pts((3, 3), (3, 9))), (3, pts((2, 2), (2, 2)))], "id long, pts array<struct<x:double,y:double>>")
    assert {r.id for r in lines.in_region(rows, spark.createDataFrame([(1, ring)], "gid long, shell array<struct<x:double,y:double>>"), 4.0).collect()} == {1, 3}


def test_design_parameters_and_boxes(spark, tmp_path):
    (tmp_path / "d.xml").write_text('<D><BuildingParameters><R1 type="R" priority="2"><Area>300</Area><FloorRange>1,6</FloorRange><DepthRange>10,16</DepthRange><FloorHeight>3.0</FloorHeight></R1><Style><Depth>1</Depth></Style></BuildingParameters><Far><R> 0.9,6 </R></Far></D>')
    got = files.read_design(spark, str(tmp_path / "d.xml"))
    assert got == {"buildings": [("R1", "R", 2, 300.0, (1.0, 6.0), (10.0, 16.0), 3.0)], "Far": [("R", {}, ["0.9", "6"])]}
    p = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1.0, 5.0), (3.0, 2.0))])
    text = spark.range(1).select(files.with_bbox(F.lit('{"type":"Feature"}'), p).alias("t")).first().t
    assert text == '{"bbox":[1.0,2.0,3.0,5.0],"type":"Feature"}'
    assert spark.range(1).select(files.with_crs(F.lit('{"features":[1]}'), "EPSG:4326").alias("t")).first().t.startswith('{"crs":{"type":"name","properties":{"name":"EPSG:4326"}},"features"')
    with pytest.raises(Exception, match="empty collection"):
        spark.range(1).select(files.with_crs(F.lit('{"features":[]}'), "x")).collect()


def test_outlines_that_come_twice(spark):
    o = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0), (2, 1.0, 0.0, 0.0, 0.0)], "oid long, ax double, ay double, bx double, by double")
    with pytest.raises(ValueError, match="twice"):
        visibility.exposure_rate(spark.createDataFrame([(1, 2)], "outline long, hits long"), o)


def test_no_site_is_lost_in_a_whole_design(spark):
    from polisgrid.plans import queries_more
    from polisgrid.plans.queries import QUERIES

    kinds = [k for k in queries_more._KINDS if k != "R"]
    seen = {}
    real = design.whole_design
    try:
        design.whole_design = lambda s, h, o: seen.update(s=s, h=h, o=o) or real(s, h, o)
        whole = QUERIES["whole_design"](spark, "/root/testdata/sf0.001")
    finally:
        design.whole_design = real
    sites, homes, others = seen["s"], seen["h"], seen["o"]
    every = {r.site_id for r in sites.collect()}
    assert {r.site_id for r in whole.select("site_id").distinct().collect()} == every
    count = lambda df: df.count()
    without = design.whole_design(sites, homes, others.where(f"kind != '{kinds[-1]}'"))
    rows = without.select("site_id", "error").distinct().collect()
    assert {r.site_id for r in rows} == every and "no building types of this kind" in {r.error for r in rows}
    none = design.whole_design(sites, homes, others.where("kind != 'C'")).select("site_id", "error").distinct().collect()
    assert {r.site_id for r in none} == every and "no building types of the other kind" in {r.error for r in none}
    assert count(design.whole_design(sites, homes, others.union(others))) == count(whole)
    nameless = sites.withColumn("kind", F.when(F.col("site_id") % 2 == 0, F.col("kind")))
    found = design.whole_design(nameless, homes, others).select("site_id", "error").distinct().collect()
    assert {r.site_id for r in found} == every and sum(r.error == "no kind" for r in found) == sum(k % 2 for k in every)
    assert whole.where("error is null").count() == whole.where("error is null").select("site_id", "building_id").distinct().count()


def test_an_outline_of_many_edges_is_its_own(spark):
    n = 2400
    ring = [{"x": 100 + 50 * math.cos(2 * math.pi * k / n), "y": 100 + 50 * math.sin(2 * math.pi * k / n)} for k in range(n)]
    box = lambda x, y: [{"x": x + a, "y": y + b} for a, b in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0))]
    sites = spark.createDataFrame([(1, [*ring, ring[0]]), (2, box(300.0, 100.0)), (3, box(5000.0, 9000.0))], "site long, shell array<struct<x:double,y:double>>")
    roads = spark.createDataFrame([(5, -400.0, 40.0, 400.0, 40.0)], "road long, ax double, ay double, bx double, by double")
    got = {(r.site, r.k): (r.rx, r.ry) for r in network.connect_sites(sites, roads, 70.0).collect()}
    assert (1, 0) in got and (2, 0) in got  # edges from 1,000 on are still those of site 1, so its own outline stops nothing
    assert got[3, 4] == (400.0, 40.0)  # far from any road
    assert network.connect_sites(sites, roads.limit(0), 70.0).count() == 0


def test_choice_of_a_graph_that_no_task_holds(spark):
    rng = np.random.default_rng(3)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 14, (40, 2)) if a < b}
    rows = [(a, b, float(rng.integers(0, 4))) for a, b in sorted(pairs)]
    edges = spark.createDataFrame([*rows, *((b, a, w) for a, b, w in rows)], "src long, dst long, w double")
    positive = edges.where("w > 0")
    ids = spark.range(15).select("id")
    for graph_, limit in ((positive, float("inf")), (positive, 5.0)):
        want = {r.id: r.choice for r in graph.centrality(ids, graph_, limit).collect()}
        got = {r.id: r.choice for r in graph.choice(ids, graph_, limit).collect()}
        assert got == pytest.approx(want)
    assert sum(r.choice for r in graph.choice(ids, edges).collect()) >= 0  # weights of 0 lead in no circle


def test_long_paths_in_few_rounds(spark):
    line = spark.range(300).select(F.lit(0).cast("long").alias("source"), "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("prev"))
    got = graph.path_to(line, spark.createDataFrame([(299,), (7,), (0,), (999,)], "id long"))
    rows = {(r.target, r.step): r.id for r in got.collect()}
    assert rows == {(t, k): t - k for t in (299, 7, 0) for k in range(t + 1)}


def test_first_hits_by_a_tree():
    from polisgrid.functions.rays import Tree

    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 600):
        tri = rng.random((n, 1, 3)) * 20 + rng.random((n, 3, 3)) * 2
        o, d = rng.random((400, 3)) * 20, rng.standard_normal((400, 3))
        d[:40], d[40:50] = [0, 0, 1], [1, 0, 0]
        d /= np.linalg.norm(d, axis=1)[:, None]
        dist, who = visibility.first_hits(o, d, tri)
        got = Tree(tri).first(o, d)
        assert (got[1] == who).all() and np.allclose(got[0], dist)
        near = Tree(tri).first(o, d, 5.0)
        assert (near[1] == np.where(dist <= 5, who, -1)).all()


def test_blocks_do_not_show(spark):
    rng = np.random.default_rng(2)
    rows = [(k, *({"x": float(x), "y": float(y), "z": float(z)} for x, y, z in rng.random(3) * 10 + rng.random((3, 3)) * 3)) for k in range(120)]
    xyz = "struct<x:double,y:double,z:double>"
    tri = spark.createDataFrame(rows, f"tri long, p {xyz}, q {xyz}, r {xyz}")
    views = spark.createDataFrame([(k, *map(float, rng.random(3) * 10)) for k in range(9)], "vid long, x double, y double, z double")
    some = lambda **how: {(r.vid, r.tri): round(r.amount, 9) for r in visibility.exposure_3d(views, tri, 7.0, **how).collect()}
    one = some()
    assert one and some(block=17, part=2) == one
    rays = views.select("vid", "x", "y", "z").withColumnRenamed("vid", "ray").withColumns({"dx": F.lit(0.6), "dy": F.lit(0.0), "dz": F.lit(0.8)})
    hits = [{(r.ray, r.tri, round(r.dist, 9)) for r in visibility.ray_hits(rays, tri, 7.0, **how).collect()} for how in ({}, {"block": 13, "part": 2})]
    assert hits[0] == hits[1] and hits[0]


def test_clusters_of_rows_are_those_of_the_kernel(spark):
    from polisgrid.plans.queries import QUERIES

    rows = {(r.level, r.cluster_id, r.id) for r in QUERIES["hac_rows"](spark, "/root/testdata/sf0.01").collect()}
    assert rows == {(r.level, r.cluster_id, r.id) for r in QUERIES["hac_clusters"](spark, "/root/testdata/sf0.01").collect()}
    rng = np.random.default_rng(5)
    dist = np.triu(rng.permutation(900).reshape(30, 30).astype(float), 1)
    dist = dist + dist.T
    far = [(i, j, float(dist[i, j])) for i in range(30) for j in range(i)]
    got = planning.cluster_rows(spark.range(31), spark.createDataFrame(far, "i long, j long, dist double"), [200.0, 500.0, 901.0]).collect()
    for level, clusters in enumerate(planning.complete_linkage(dist, [200.0, 500.0, 901.0])):
        own: dict = {}
        for r in got:
            if r.level == level and r.id < 30:
                own.setdefault(r.cluster_id, []).append(r.id)
        assert sorted(map(sorted, own.values())) == clusters
    assert sum(r.id == 30 and r.cluster_id == 30 for r in got) == 3
