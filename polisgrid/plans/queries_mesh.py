"""Queries of meshes that are edited, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from polisgrid.operators import mesh, visibility
from polisgrid.plans import inputs as i
from polisgrid.plans.queries import query
from polisgrid.plans.queries_more import _solid


def _measures_sql(closed: tuple[int, int, int], open_: tuple[int, int, int, int], volume: str) -> str:
    """Faces, edges and vertices of edited boxes; every fourth box lacks its upper face and has naked edges, too."""
    box = "(s_nationkey + 1) * (s_suppkey % 5 + 1) * (s_suppkey % 3 + 1)"
    pick = lambda a, b, name: f"CAST(CASE WHEN s_suppkey % 4 = 0 THEN {b} ELSE {a} END AS BIGINT) AS {name}"
    counts = ", ".join(pick(a, b, n) for a, b, n in zip((*closed, 0), open_, ("faces", "edges", "vertices", "naked"), strict=True))
    return f"SELECT s_suppkey AS mesh, {counts}, s_suppkey % 4 <> 0 AS closed, CASE WHEN s_suppkey % 4 <> 0 THEN round_even(CAST({box} AS DOUBLE) * {volume}, 6) END AS volume FROM supplier"


def _measured(faces, places):
    m = visibility.mesh_measures(faces, places)
    return m.withColumn("volume", F.when(F.col("closed"), F.bround("volume", 6)))


def _two_edges(places):
    """Edges of each box: a lower one, and an upper one, which is naked where the upper face is missing."""
    return places.where("vertex = 0").select("mesh", F.explode(F.array(F.struct(F.lit(0).alias("a"), F.lit(1).alias("b")), F.struct(F.lit(5).alias("a"), F.lit(4).alias("b")))).alias("e")).select("mesh", "e.*")


@query(_measures_sql((6, 14, 10), (5, 14, 10, 5), "1"))
def mesh_split_edges(spark, d):
    faces, places = _solid(spark, d)
    return _measured(*mesh.split_edges(faces, places, _two_edges(places), 0.25))


@query(_measures_sql((24, 36, 14), (20, 32, 13, 4), "1"))
def mesh_stellate(spark, d):
    return _measured(*mesh.stellate(*_solid(spark, d)))


@query(_measures_sql((8, 12, 6), (4, 8, 5, 4), "1 / 6"))
def mesh_dual(spark, d):
    return _measured(*mesh.dual(*_solid(spark, d)))


@query(_measures_sql((14, 36, 24), (13, 36, 24, 8), "(1 - 4 / 81.0::DOUBLE)"))
def mesh_truncate(spark, d):
    return _measured(*mesh.truncate(*_solid(spark, d)))


@query(_measures_sql((6, 13, 9), (5, 13, 9, 4), "1"))
def mesh_split_vertices(spark, d):
    faces, places = _solid(spark, d)
    return _measured(*mesh.split_vertices(faces, places, places.where("vertex = 0").select("mesh", "vertex", F.lit(1).alias("first"), F.lit(2).alias("second"))))


@query(_measures_sql((6, 12, 8), (5, 12, 8, 4), "1"))
def mesh_split_collapse(spark, d):
    """A vertex is split, and the new edge drawn together again."""
    faces, places = _solid(spark, d)
    faces, places = mesh.split_vertices(faces, places, places.where("vertex = 0").select("mesh", "vertex", F.lit(1).alias("first"), F.lit(4).alias("second")))
    return _measured(*mesh.collapse_edges(faces, places, places.where("vertex = 0").select("mesh", F.lit(0).alias("a"), F.lit(8).alias("b"))))


#: One mesh of quadrilaterals: a part is a place of a grid of 50 columns, its size the height. A face has its lower left number.
_TERRAIN = """g AS MATERIALIZED (SELECT p_partkey AS k, p_partkey % 50 AS i, p_partkey // 50 AS j, p_size AS z FROM part),
 f AS MATERIALIZED (SELECT a.k AS face, a.i, a.j FROM g a JOIN g b ON b.k = a.k + 1 JOIN g c ON c.k = a.k + 51 JOIN g d ON d.k = a.k + 50 WHERE a.i < 49),
 s AS (SELECT face, unnest([face, face + 50, face, face + 1]) AS lo, unnest([face + 1, face + 51, face + 50, face + 51]) AS hi FROM f),
 e AS MATERIALIZED (SELECT lo, hi, count(*) AS uses FROM s GROUP BY lo, hi),
 n AS (SELECT lo AS v, hi AS w, uses FROM e UNION ALL SELECT hi, lo, uses FROM e),
 deg AS MATERIALIZED (SELECT v, count(*) AS valence, min(uses) = 1 AS rim FROM n GROUP BY v)"""


def terrain(spark, d):
    k = F.col("p_partkey")
    places = i.table(spark, d, "part").select(F.lit(0).cast("long").alias("mesh"), k.cast("long").alias("vertex"), (k % 50).cast("double").alias("x"), F.floor(k / 50).cast("double").alias("y"), F.col("p_size").cast("double").alias("z"))
    one = places.select("mesh", "vertex")
    cells = one.where("vertex % 50 < 49").select("mesh", F.col("vertex").alias("face"))
    for step in (1, 51, 50):
        # One mesh is the whole table, whose few bytes of file would else be sent to every task by the driver.
        cells = cells.join(one.select("mesh", (F.col("vertex") - step).alias("face")).hint("merge"), ["mesh", "face"], "left_semi")
    f = F.col("face")
    return cells.select("mesh", "face", F.array(f, f + 1, f + 51, f + 50).alias("v")), places


@query(
    f"WITH {_TERRAIN}, c AS (SELECT e.lo, e.hi FROM e JOIN g ON g.k = e.lo JOIN deg a ON a.v = e.lo JOIN deg b ON b.v = e.hi WHERE e.hi = e.lo + 1 AND g.i % 4 = 1 AND g.j % 3 = 1 AND NOT (e.uses = 2 AND a.rim AND b.rim))"
    " SELECT v AS vertex, CAST(valence + coalesce((SELECT b.valence - 2 FROM c JOIN deg b ON b.v = c.hi WHERE c.lo = deg.v), 0) AS BIGINT) AS valence FROM deg WHERE v NOT IN (SELECT hi FROM c)"
)
def terrain_collapse(spark, d):
    """Edges at the vertices left when some edges of a terrain are drawn together."""
    faces, places = terrain(spark, d)
    edges = places.where("x % 4 = 1 and y % 3 = 1").select("mesh", F.col("vertex").alias("a"), (F.col("vertex") + 1).alias("b"))
    return visibility.valence(mesh.collapse_edges(faces, places, edges)[0]).select("vertex", "valence")


@query(
    f"WITH {_TERRAIN}, c AS (SELECT s.face AS one, t.face AS two FROM f s JOIN f t ON t.face = s.face + 1 JOIN deg a ON a.v = t.face JOIN deg b ON b.v = t.face + 50 WHERE s.i % 2 = 0 AND t.i = s.i + 1 AND a.valence > 2 AND b.valence > 2)"
    " SELECT face, CASE WHEN face IN (SELECT one FROM c) THEN 6 ELSE 4 END AS corners FROM f WHERE face NOT IN (SELECT two FROM c)"
)
def terrain_merge(spark, d):
    """A terrain's faces made one two by two; the edges between them meet, so it takes rounds."""
    faces, places = terrain(spark, d)
    edges = places.where("x % 2 = 1").select("mesh", F.col("vertex").alias("a"), (F.col("vertex") + 50).alias("b"))
    return mesh.merge_faces(faces, edges).select("face", F.size("v").alias("corners"))


@query(
    f"WITH {_TERRAIN}, c AS (SELECT v FROM deg JOIN g ON g.k = v WHERE i % 3 = 1 AND j % 3 = 1 AND NOT rim AND NOT EXISTS (SELECT 1 FROM n JOIN deg w ON w.v = n.w WHERE n.v = deg.v AND w.valence < 3))"
    " SELECT face, CASE WHEN face + 51 IN (SELECT v FROM c) THEN 8 ELSE 4 END AS corners FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE face IN (v, v - 1, v - 50))"
)
def terrain_erase(spark, d):
    """A terrain without some of its vertices."""
    faces, places = terrain(spark, d)
    return mesh.erase_vertices(faces, places, places.where("x % 3 = 1 and y % 3 = 1"))[0].select("face", F.size("v").alias("corners"))


@query(f"WITH {_TERRAIN} SELECT v AS face, concat_ws(',', v - 50, v, v - 1, v - 51) AS ring FROM deg WHERE NOT rim")
def terrain_dual(spark, d):
    """The faces about each inner vertex of a terrain, counter-clockwise from the least neighbour on."""
    return mesh.dual(*terrain(spark, d))[0].select("face", F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("ring"))


@query(f"WITH {_TERRAIN} SELECT face, 8 AS corners FROM f UNION ALL SELECT v + (SELECT max(face) + 1 FROM f), CAST(valence AS INTEGER) FROM deg WHERE valence > 2")
def terrain_truncate(spark, d):
    """Corners of the faces of a terrain whose vertices are cut off."""
    return mesh.truncate(*terrain(spark, d))[0].select("face", F.size("v").alias("corners"))


@query(
    f"WITH {_TERRAIN}, tri AS (SELECT face, face + 51 AS a, face + 50 AS b, face AS c FROM f UNION ALL SELECT face, face, face + 1, face + 51 FROM f),"
    " side AS (SELECT least(a, b) AS lo, greatest(a, b) AS hi FROM tri UNION ALL SELECT least(b, c), greatest(b, c) FROM tri UNION ALL SELECT least(c, a), greatest(c, a) FROM tri),"
    " edge AS (SELECT lo, hi, count(*) AS uses, (lo * 7 + hi) % 5 < 2 AS cut FROM side GROUP BY lo, hi)"
    " SELECT CAST((SELECT count(*) FROM tri) + sum(CASE WHEN cut THEN uses ELSE 0 END) AS BIGINT) AS faces, CAST(count(*) + sum(CASE WHEN cut THEN 1 + uses ELSE 0 END) AS BIGINT) AS edges,"
    " CAST((SELECT count(*) FROM deg) + count_if(cut) AS BIGINT) AS vertices, CAST(sum(CASE WHEN uses = 1 THEN CASE WHEN cut THEN 2 ELSE 1 END ELSE 0 END) AS BIGINT) AS naked, CAST((SELECT count(*) FROM f) AS DOUBLE) AS area FROM edge"
)
def terrain_triangles(spark, d):
    """A terrain cut into triangles, two fifths of whose edges are halved: counts, and the area seen from above."""
    faces, places = terrain(spark, d)
    faces = mesh.split_faces(faces, faces.select("mesh", "face", F.col("face").alias("a"), (F.col("face") + 51).alias("b")))
    ends = visibility.half_edges(faces).select("mesh", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("(a * 7 + b) % 5 < 2")
    faces, places = mesh.split_edges(faces, places, ends, triangles=True)
    p = places.select("mesh", F.col("vertex").alias("a"), "x", "y")
    turns = mesh.corners(faces).join(p, ["mesh", "a"]).join(p.select("mesh", F.col("a").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by")), ["mesh", "b"])
    area = turns.groupBy("mesh").agg(F.bround(F.sum(F.col("x") * F.col("by") - F.col("bx") * F.col("y")) / 2, 6).alias("area"))
    return visibility.mesh_measures(faces, places).join(area, "mesh").select("faces", "edges", "vertices", "naked", "area")
