"""Edits of meshes against plain Python, conflicts among them, and odd input."""

import random

import pytest
from pyspark.sql import functions as F

from polisgrid.operators import mesh, visibility

FACES, PLACES = "mesh long, face long, v array<long>", "mesh long, vertex long, x double, y double, z double"


def _grid(spark, n):
    """A mesh of n x n cells, each cut into two triangles."""
    at = lambda i, j: j * (n + 1) + i
    cells = [(i, j) for j in range(n) for i in range(n)]
    faces = [(1, 2 * k + h, v) for k, (i, j) in enumerate(cells) for h, v in enumerate(([at(i, j), at(i + 1, j), at(i + 1, j + 1)], [at(i, j), at(i + 1, j + 1), at(i, j + 1)]))]
    places = [(1, at(i, j), float(i), float(j), float(i * j % 3)) for j in range(n + 1) for i in range(n + 1)]
    return spark.createDataFrame(faces, FACES), spark.createDataFrame(places, PLACES)


def _links(faces):
    """Uses of every edge, the neighbours of every vertex."""
    uses, near = {}, {}
    for v in faces:
        for a, b in zip(v, v[1:] + v[:1], strict=True):
            uses[frozenset((a, b))] = uses.get(frozenset((a, b)), 0) + 1
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return uses, near


def _sound(faces, euler):
    """Every side is used once, and the number of vertices less edges plus faces is kept."""
    sides = [(a, b) for v in faces for a, b in zip(v, v[1:] + v[:1], strict=True)]
    assert len(sides) == len(set(sides)) and all(len(set(v)) == len(v) > 2 for v in faces)
    uses, near = _links(faces)
    assert len(near) - len(uses) + len(faces) == euler
    return uses, near


def _may_collapse(faces, a, b):
    uses, near = _links(faces)
    rim = {v for e, n in uses.items() if n == 1 for v in e}
    sides = [v for v in faces if frozenset((a, b)) in {frozenset(s) for s in zip(v, v[1:] + v[:1], strict=True)}]
    return frozenset((a, b)) in uses and not (len(sides) == 2 and a in rim and b in rim) and len(near[a] & near[b]) <= sum(len(v) == 3 for v in sides)


def test_collapses_in_each_others_way(spark):
    faces, places = _grid(spark, 5)
    drawn = random.Random(3).sample([(1, a, b) for a, b in ((j * 6 + i, j * 6 + i + 1) for j in range(6) for i in range(5))], 12)
    got, left = mesh.collapse_edges(faces, places, spark.createDataFrame([*drawn, *drawn[:3], (1, 0, 35), (2, 0, 1), (1, None, 4)], "mesh long, a long, b long"))
    out = [r.v for r in got.collect()]
    _, near = _sound(out, 1)
    assert {r.vertex for r in left.collect()} == set(near)
    gone = set(range(36)) - set(near)
    assert gone and gone <= {b for _, _, b in drawn}
    # An edge whose ends are both still there was not allowed in the end.
    assert not any(_may_collapse(out, a, b) for _, a, b in drawn if a in near and b in near)


def test_collapse_down_to_what_is_allowed(spark):
    """All edges of a box of triangles: it ends as a mesh of which no edge may go."""
    box = ((0, 2, 3, 1), (0, 1, 5, 4), (1, 3, 7, 5), (3, 2, 6, 7), (2, 0, 4, 6), (4, 5, 7, 6))
    tri = [(1, 2 * k + h, list(t)) for k, (a, b, c, d) in enumerate(box) for h, t in enumerate(((a, b, c), (a, c, d)))]
    faces = spark.createDataFrame(tri, FACES)
    places = spark.createDataFrame([(1, k, float(k & 1), float(k >> 1 & 1), float(k >> 2)) for k in range(8)], PLACES)
    edges = spark.createDataFrame([(1, min(a, b), max(a, b)) for a, b in _links([t for *_, t in tri])[0]], "mesh long, a long, b long")
    out = [r.v for r in mesh.collapse_edges(faces, places, edges)[0].collect()]
    assert not any(_may_collapse(out, *sorted(e)) for e in _links(out)[0])


def test_merges_in_each_others_way(spark):
    faces, _ = _grid(spark, 4)
    uses, _ = _links([r.v for r in faces.collect()])
    edges = random.Random(5).sample(sorted(tuple(sorted(e)) for e, n in uses.items() if n == 2), 20)
    out = {r.face: r.v for r in mesh.merge_faces(faces, spark.createDataFrame([(1, b, a) for a, b in edges], "mesh long, a long, b long")).collect()}
    after, near = _sound(list(out.values()), 1)
    for e in map(frozenset, edges):
        if e in after:  # refused: an end with two edges, or faces with several edges in common
            both = [{frozenset(s) for s in zip(v, v[1:] + v[:1], strict=True)} for v in out.values()]
            f, g = [s for s in both if e in s]
            assert min(len(near[x]) for x in e) < 3 or len(f & g) > 1
    assert len(uses) - len(after) == 32 - len(out)


def test_erased_vertices_in_each_others_way(spark):
    faces, places = _grid(spark, 5)
    inner = [j * 6 + i for j in range(1, 5) for i in range(1, 5)]
    got, left = mesh.erase_vertices(faces, places, spark.createDataFrame([(1, v) for v in [*inner, inner[0], 0, 99]], "mesh long, vertex long"))
    out = [r.v for r in got.collect()]
    _, near = _sound(out, 1)
    assert set(near) == {r.vertex for r in left.collect()} and 0 in near and len(near) < 36 - 3


def test_dual_of_dual_and_truncation(spark):
    faces, places = _grid(spark, 3)
    solid = spark.createDataFrame([(1, k, list(f)) for k, f in enumerate(((0, 2, 1), (0, 1, 3), (1, 2, 3), (2, 0, 3)))], FACES)
    spots = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0), (1, 2, 0.0, 1.0, 0.0), (1, 3, 0.0, 0.0, 1.0)], PLACES)
    turned = mesh.dual(*mesh.dual(solid, spots))
    m = visibility.mesh_measures(*turned).first()
    assert (m.faces, m.edges, m.vertices, m.closed) == (4, 6, 4, True) and m.volume == pytest.approx(1 / 6 / 27**2)
    cut = visibility.mesh_measures(*mesh.truncate(solid, spots)).first()
    assert (cut.faces, cut.edges, cut.vertices) == (8, 18, 12) and cut.volume == pytest.approx(1 / 6 * (1 - 4 / 27))
    open_ = [r.v for r in mesh.truncate(faces, places)[0].collect()]
    sides = [s for v in open_ for s in zip(v, v[1:] + v[:1], strict=True)]
    assert len(sides) == len(set(sides))


def test_triangles_stay_triangles_and_turn_alike(spark):
    faces, places = _grid(spark, 4)
    uses, _ = _links([r.v for r in faces.collect()])
    for share in (3, 2, 1):
        edges = spark.createDataFrame([(1, *sorted(e)) for k, e in enumerate(sorted(uses, key=sorted)) if k % share == 0], "mesh long, a long, b long")
        f, p = mesh.split_edges(faces, places, edges, triangles=True)
        rows, at = f.collect(), {r.vertex: (r.x, r.y) for r in p.collect()}
        out = [r.v for r in rows]
        _sound(out, 1)
        assert {len(v) for v in out} == {3} and len({r.face for r in rows}) == len(rows)
        area = [((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2 for a, b, c in ([at[x] for x in v] for v in out)]
        assert min(area) > 0 and sum(area) == pytest.approx(16)


def test_refused_cuts_and_vertices(spark):
    faces = spark.createDataFrame([(1, 0, [0, 1, 2, 3]), (1, 1, [1, 4, 5, 2])], FACES)
    cuts = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 5, 1), (1, 1, 5, 1), (1, 9, 0, 2), (1, 0, None, 2)], "mesh long, face int, a int, b int")
    assert sorted((r.face, r.v) for r in mesh.split_faces(faces, cuts).collect()) == [(0, [0, 1, 2, 3]), (1, [5, 2, 1]), (3, [1, 4, 5])]
    places = spark.createDataFrame([(1, v, float(v), 0.0, 0.0) for v in range(6)], PLACES)
    at = spark.createDataFrame([(1, 1, 0, 2), (1, 77, 0, 1)], "mesh long, vertex int, first int, second int")  # a border, and none
    assert {tuple(r.v) for r in mesh.split_vertices(faces, places, at)[0].collect()} == {(0, 1, 2, 3), (1, 4, 5, 2)}
    bow = spark.createDataFrame([(1, 0, [0, 1, 2]), (1, 1, [0, 3, 4])], FACES)
    with pytest.raises(Exception, match="several fans"):
        mesh.truncate(bow, places)[0].collect()


def test_empty_and_extra_columns(spark):
    none = spark.createDataFrame([], FACES), spark.createDataFrame([], PLACES)
    pairs = spark.createDataFrame([(1, 0, 1)], "mesh long, a long, b long")
    assert all(df.isEmpty() for made in (mesh.split_edges(*none, pairs), mesh.stellate(*none), mesh.dual(*none), mesh.truncate(*none), mesh.collapse_edges(*none, pairs)) for df in made)
    assert mesh.merge_faces(none[0], pairs).isEmpty() and mesh.to_obj(*none).isEmpty()
    faces, places = _grid(spark, 2)
    more = faces.withColumns({"x": F.lit(1), "k": F.lit("k"), "lo": F.lit(2)}), places.withColumns({"face": F.lit(1), "a": F.lit(3), "m": F.lit(2)})
    wide = pairs.withColumns({"hi": F.lit(1), "vertex": F.lit(9), "uses": F.lit(3), "m": F.lit(1)})
    for edit in (mesh.split_edges, mesh.collapse_edges):
        assert {tuple(r.v) for r in edit(*more, wide)[0].collect()} == {tuple(r.v) for r in edit(faces, places, pairs)[0].collect()}
    assert {tuple(r.v) for r in mesh.truncate(*more)[0].collect()} == {tuple(r.v) for r in mesh.truncate(faces, places)[0].collect()}
    assert sorted(tuple(r) for r in mesh.stellate(*more)[1].collect()) == sorted(tuple(r) for r in mesh.stellate(faces, places)[1].collect())


def test_obj_lines(spark):
    faces, places = mesh.stellate(*_grid(spark, 1))
    lines = [r.line for r in mesh.to_obj(faces, places).orderBy("seq").collect()]
    spots = [x for x in lines if x[0] == "v"]
    sides = [[int(k) for k in x.split()[1:]] for x in lines if x[0] == "f"]
    assert lines[: len(spots)] == spots and len(spots) == 6 and len(sides) == 6 and {k for s in sides for k in s} == set(range(1, 7))
    assert spots[0] == "v 0.0 0.0 0.0"
