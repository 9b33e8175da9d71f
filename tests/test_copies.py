"""Rows of the same shape: what depends on the shape is worked out once, and every row has its result."""

import numpy as np
import pytest

from polisgrid.operators import cleaning, network, parcels, planning, spatial, visibility

SPOTS = [(0, 0, 4, 4), (0, 4, 4, 0), (1, 0, 1, 5), (0, 2, 6, 2), (4, 4, 0, 0), (3, 2, 8, 2)]
FLAT = [(k, *map(float, SPOTS[k * 7 % 6])) for k in range(24)]


def flat(spark, rows=FLAT):
    return spark.createDataFrame(rows, "id long, ax double, ay double, bx double, by double")


def sides(df):
    return (df.select(*(df[k].alias(p + k) for k in df.columns)) for p in "lr")


def in_space(spark):
    point = "struct<x:double,y:double,z:double>"
    return spark.createDataFrame([(i, (a, b, 0.0), (c, d, 0.0)) for i, a, b, c, d in FLAT], f"id long, a {point}, b {point}")


@pytest.fixture
def counted(monkeypatch):
    """Makes a function of a module count the rows of its first argument."""

    def on(module, name):
        rows, real = [], getattr(module, name)

        def run(df, *rest, **more):
            rows.append(df.count())
            return real(df, *rest, **more)

        monkeypatch.setattr(module, name, run)
        return rows

    return on


def test_crossings_of_copies(spark, counted):
    rows = counted(spatial, "box_join")
    got = sorted(map(tuple, spatial.crossings(*sides(flat(spark)), 2.0, 6).collect()))
    want = []
    for i, *p in FLAT:
        for j, *q in FLAT:
            (ax, ay, bx, by), (cx, cy, dx, dy) = p, q
            det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if det:
                t, s = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / det
                if 0 <= t <= 1 and 0 <= s <= 1:
                    want.append((i, j, round(ax + t * (bx - ax), 6), round(ay + t * (by - ay), 6)))
    assert got == sorted(want) and rows == [6]


def test_split_segments_of_copies(spark, counted):
    rows = counted(spatial, "box_join")
    got: dict = {}
    for r in spatial.split_segments(flat(spark), 2.0).collect():
        got.setdefault(r.id, []).append((r.seq, r.ax, r.ay, r.bx, r.by))
    alone: dict = {}
    for r in spatial.split_segments(flat(spark, [(k, *map(float, s)) for k, s in enumerate(SPOTS)]), 2.0).collect():
        alone.setdefault(r.id, []).append((r.seq, r.ax, r.ay, r.bx, r.by))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(alone[k * 7 % 6]) for k in range(24)} and rows == [6, 6]


def met_by_hand():
    p = np.array([[[a, b, 0], [c, d, 0]] for _, a, b, c, d in FLAT], float)
    i, j = np.array([(i, j) for i in range(24) for j in range(24) if i != j]).T
    row, side, place = cleaning.meet(p[i, 0], p[i, 1], p[j, 0], p[j, 1], 0.05)
    return [(int(i[r]), int(j[r]), "lr"[s], tuple(np.round(at, 6) + 0.0)) for r, s, at in zip(row, side, place, strict=True)]


def test_meeting_points_of_copies(spark, counted):
    rows = counted(cleaning, "box_join")
    want: dict = {}
    for key in met_by_hand():
        want[key] = want.get(key, 0) + 1
    got = cleaning.meeting_points(*sides(in_space(spark)), 0.05, 2.0, 6).collect()
    assert {(r.lid, r.rid, r.on, tuple(r.p)): r.n for r in got} == want and len(got) == len(want) and rows == [6]
    each: dict = {}
    for r in cleaning.meeting_points(*sides(in_space(spark)), 0.05, 2.0).collect():
        key = (r.lid, r.rid, r.on, tuple(np.round(r.p, 6) + 0.0))
        each[key] = each.get(key, 0) + 1
    assert each == want


def test_split_in_space_of_copies(spark, counted):
    rows = counted(cleaning, "box_join")
    cuts = {i: {(a, b, 0.0), (c, d, 0.0)} for i, a, b, c, d in FLAT}
    for i, j, on, p in met_by_hand():
        if i < j:
            cuts[i if on == "l" else j].add(p)
    want = {(i, n + 1, a, b) for i, some in cuts.items() for n, (a, b) in enumerate(zip(sorted(some), sorted(some)[1:], strict=False))}
    assert {(r.id, r.seq, tuple(r.a), tuple(r.b)) for r in cleaning.split_in_space(in_space(spark), 0.05, 2.0).collect()} == want and rows == [6]


def test_ends_in_one_place_are_snapped_once(spark, counted):
    rows = counted(cleaning, "radius_join")
    point = "struct<x:double,y:double,z:double>"
    near = spark.createDataFrame([(k, (k % 3 * 0.02, 0.0, 0.0), (5.0, k % 2 * 1.0, 0.0)) for k in range(30)], f"id long, a {point}, b {point}")
    got = {r.id: (r.a.x, r.b.y) for r in cleaning.snap_ends(near, 0.03).collect()}
    assert got == {k: ((0.0, 0.0, 0.02)[k % 3], k % 2 * 1.0) for k in range(30)} and rows == [5]


def test_clean_lines_cuts_copies_once(spark, counted):
    one = {tuple(r)[2:] for r in cleaning.clean_lines(flat(spark, [(k, *map(float, SPOTS[k * 7 % 6])) for k in range(6)]), 0.05, 2.0).collect()}
    rows = counted(cleaning, "split_segments")
    assert {tuple(r)[2:] for r in cleaning.clean_lines(flat(spark), 0.05, 2.0).collect()} == one and rows == [6]


def walls(spark):
    n = [(k, k, float(k % 3), 1.0, float(k % 3) + 1, 1.0, 2.0) for k in range(12)]
    return visibility.walls(spark.createDataFrame(n, "oid long, seq long, ax double, ay double, bx double, by double, height double")).select("tri", "p", "q", "r")


def test_views_of_copies(spark, counted):
    rows = counted(visibility, "_cells")
    v = spark.createDataFrame([(1, 1.5, 0.0, 1.0), (2, 1.5, 2.0, 1.0)], "vid long, x double, y double, z double")
    got: dict = {}
    for r in visibility.exposure_3d(v, walls(spark), 6.0).collect():
        got.setdefault((r.vid, r.tri // 2 % 3, r.tri % 2), []).append((r.tri, r.dist, r.amount))
    assert got and all(len({x[0] for x in found}) == len(found) == 4 and len({x[1:] for x in found}) == 1 for found in got.values())
    assert rows == [6]


def test_sun_on_copies(spark, counted):
    rows = counted(visibility, "_keyed")
    points = spark.createDataFrame([(k, 1.5, float(k % 2) * 1.8, 0.5) for k in range(20)], "pid long, x double, y double, z double")
    suns = spark.createDataFrame([(0, 1.0, 0.0, 0.6, 0.8), (1, 2.0, 0.0, -0.8, 0.6)], "time long, hours double, dx double, dy double, dz double")
    got = {r.pid: r.hours for r in visibility.sun_hours(points, suns, walls(spark), 50.0).collect()}
    assert got == {k: got[k % 2] for k in range(20)} and got[0] != got[1] and rows == [4]


def test_internal_roads_of_copies(spark, counted):
    rows = counted(parcels, "_rows")
    box = lambda w: [(0.0, 0.0), (w, 0.0), (w, 40.0), (0.0, 40.0)]
    sites = spark.createDataFrame([(k, box(80.0 + k % 2 * 30), [0.6, 0.4]) for k in range(10)] + [(None, box(80.0), [0.6, 0.4])], "site_id long, shell array<struct<x:double,y:double>>, shares array<double>")
    got: dict = {}
    for r in parcels.internal_roads(sites).collect():
        got.setdefault(r.site_id, []).append((r.k, r.rounded, r.area, tuple(map(tuple, r.shell))))
    assert len(got) == 11 and all(sorted(got[k]) == sorted(got[k % 2]) and len(got[k]) == 2 for k in range(10)) and sorted(got[None]) == sorted(got[0])
    assert got[0] != got[1] and rows == [2]


def roads(spark):
    e = [(0, 1, 1.0), (1, 2, 2.0), (2, 3, 4.0), (5, 6, 1.0)]
    return spark.createDataFrame([*e, *((b, a, w) for a, b, w in e)], "src long, dst long, w double")


ENTRIES = [(1, 0), (2, 0), (3, 1), (4, 3), (4, 2), (5, 2), (6, 5), (7, 3), (7, 0), (7, 0), (8, 9), (9, 9)]


def apart():
    at = {0: 0.0, 1: 1.0, 2: 3.0, 3: 7.0}
    d = lambda u, v: abs(at[u] - at[v]) if u in at and v in at else 0.0 if u == v else float("inf")
    out: dict = {}
    for i, u in ENTRIES:
        for j, v in ENTRIES:
            out[i, j] = min(out.get((i, j), float("inf")), d(u, v))
    return out


def test_sites_with_one_entry_need_no_grouping(spark):
    e = spark.createDataFrame(ENTRIES, "site long, vertex long")
    got = network.distance_matrix(roads(spark), e)
    assert sorted(map(tuple, got.collect())) == sorted((i, j, d) for (i, j), d in apart().items() if i < j and d < float("inf"))
    assert got._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def test_coverage_of_sites_with_one_entry_needs_no_grouping(spark):
    e = spark.createDataFrame(ENTRIES, "site long, vertex long")
    got = network.entry_coverage(roads(spark), e, 3.0)
    assert sorted(map(tuple, got.collect())) == sorted(k for k, d in apart().items() if d <= 3.0)
    assert got._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def test_blocks_at_distance_0_are_clustered_by_their_first(spark):
    rng = np.random.default_rng(2)
    for _ in range(40):
        shape = np.unique(rng.integers(0, 6, rng.integers(2, 20)), return_inverse=True)[1]
        apart_ = np.triu(rng.integers(1, 5, (6, 6)).astype(float), 1)
        apart_ += apart_.T
        full = [sorted(map(tuple, c)) for c in planning.complete_linkage(apart_[shape][:, shape], [2.0, 4.0])]
        place = np.empty(shape.max() + 1, int)
        order = planning.merged_order(shape)
        place[order] = np.arange(len(order))
        small = planning.complete_linkage(np.where(np.eye(len(order)) > 0, np.inf, apart_[order][:, order]), [2.0, 4.0])
        assert [sorted(tuple(k for k in range(len(shape)) if place[shape[k]] in c) for c in level) for level in small] == full
    blocks = [(10 + k, k % 3) for k in range(9)]
    d = {(0, 1): 1.5, (0, 2): 5.0, (1, 2): 3.0}
    pairs = [(a, b, d.get((min(u, v), max(u, v)), 0.0)) for a, u in blocks for b, v in blocks if a < b]
    ids = spark.createDataFrame([(a,) for a, _ in blocks], "id long")
    want = sorted(map(tuple, planning.cluster_blocks(ids, spark.createDataFrame(pairs, "i long, j long, dist double"), [2.0, 4.0]).collect()))
    firsts = spark.createDataFrame([(10,), (11,), (12,)], "id long")
    between = spark.createDataFrame([(10 + a, 10 + b, x) for (a, b), x in d.items()], "i long, j long, dist double")
    got = planning.cluster_blocks(firsts, between, [2.0, 4.0], spark.createDataFrame([(a, 10 + u) for a, u in blocks], "id long, shape long"))
    assert sorted(map(tuple, got.collect())) == want


def test_clusters_of_rows_keep_the_order_of_ties(spark):
    rng = np.random.default_rng(4)
    n, size = 10, 12  # as many graphs at once, as each round is the same for all
    want, far = set(), []
    for g in range(n):
        apart_ = np.triu(rng.integers(0, 5, (size, size)).astype(float), 1)
        apart_ += apart_.T
        far += [(100 * g + i, 100 * g + j, float(apart_[i, j])) for i in range(size) for j in range(i)]
        for level, clusters in enumerate(planning.complete_linkage(apart_, [2.0, 4.0])):
            want |= {(level, 100 * g + c[0], 100 * g + k) for c in clusters for k in c}
    ids = spark.createDataFrame([(100 * g + k,) for g in range(n) for k in range(size)], "id long")
    got = planning.cluster_rows(ids, spark.createDataFrame(far, "i long, j long, dist double"), [2.0, 4.0]).collect()
    assert {(r.level, r.cluster_id, r.id) for r in got} == want


def test_clusters_of_points_are_held_by_no_task(spark):
    from polisgrid.plans.queries import QUERIES

    got = QUERIES["hac_clusters"](spark, "/root/testdata/sf0.001")
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert len({r.id for r in rows}) == 500 and len(rows) == 1000 and all(r.g <= r.cluster_id <= r.id for r in rows)
