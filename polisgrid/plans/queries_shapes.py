"""Queries of unions, sites between roads and sites of any shape, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from polisgrid.operators import centre, hulls, interchange, overlay, parcels
from polisgrid.plans import inputs as i
from polisgrid.plans.queries import query
from polisgrid.plans.rounds import Stored

#: A quarter of a disc of radius 1 in steps of five degrees has this area.
_QUARTER = "(9 * sin(radians(5)))"

#: Blocks of a city of 50 columns, one a part: where the roads at their left and lower sides run, and how wide these are.
_WIDTHS = [16.0, 10.0, 7.0]
_CITY = """city AS MATERIALIZED (SELECT p_partkey % 50 AS i, p_partkey // 50 AS j, least(p_size % 4, 2) AS lv, least((p_size // 4) % 4, 2) AS bv FROM part),
 wide AS (SELECT i, j, CASE lv WHEN 0 THEN 16.0::DOUBLE WHEN 1 THEN 10 ELSE 7 END AS lw, CASE bv WHEN 0 THEN 16.0::DOUBLE WHEN 1 THEN 10 ELSE 7 END AS bw, 60.0::DOUBLE * i + (i * 7) % 37 AS x, 45.0::DOUBLE * j + (j * 5) % 23 AS y FROM city)"""


def city_roads(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    x = lambda n: (n * 60 + n * 7 % 37).cast("double")
    y = lambda n: (n * 45 + n * 5 % 23).cast("double")
    a, b = k % 50, F.floor(k / 50)
    at = lambda p, q: F.struct(p.alias("x"), q.alias("y"))
    left = F.struct((size % 4).alias("level"), F.array(at(x(a), y(b)), at(x(a), y(b + 1))).alias("pts"))
    lower = F.struct((F.floor(size / 4) % 4).cast("int").alias("level"), F.array(at(x(a), y(b)), at(x(a + 1), y(b))).alias("pts"))
    return i.table(spark, d, "part").select(F.explode(F.array(left, lower)).alias("r")).select("r.*")


@query(
    f"WITH {_CITY}, hole AS (SELECT c.x + c.lw / 2 AS x0, r.x - r.lw / 2 AS x1, c.y + c.bw / 2 AS y0, t.y - t.bw / 2 AS y1 FROM wide c JOIN wide r ON r.i = c.i + 1 AND r.j = c.j JOIN wide t ON t.i = c.i AND t.j = c.j + 1)"
    f" SELECT round_even(y0, 3) AS y, round_even((x1 - x0) * (y1 - y0) - 4 * 25 * (1 - {_QUARTER}), 1) AS area FROM hole WHERE x1 - x0 > 10 AND y1 - y0 > 10"
)
def site_generation(spark, d):
    """Sites between the roads of a city of blocks, one a part."""
    sites = overlay.generate_sites(city_roads(spark, d), _WIDTHS, 5.0, 100.0)
    return sites.select(F.bround(F.array_min(F.transform("shell", lambda p: p["y"])), 3).alias("y"), F.bround("area", 1).alias("area"))


#: L-shaped sites: width, height, and the size of what is missing at the upper right corner.
_L = "(SELECT p_partkey AS site_id, 60.0::DOUBLE + p_size AS w, 50.0::DOUBLE + p_partkey % 40 AS h, 10.0::DOUBLE + p_partkey % 13 AS a, 8.0::DOUBLE + p_size % 11 AS b FROM part)"


def corner_sites(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    w, h, a, b = s + 60, k % 40 + 50, k % 13 + 10, s % 11 + 8
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    z = F.lit(0)
    return i.table(spark, d, "part").select(k.alias("site_id"), F.array(at(z, z), at(w, z), at(w, h - b), at(w - a, h - b), at(w - a, h), at(z, h), at(z, z)).alias("shell"), F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)).alias("shares"))


@query(f"SELECT site_id, 0 AS part, round_even((w - 10) * (h - 10) - a * b + 25 * (1 - {_QUARTER}), 2) AS area FROM {_L}")
def setbacks(spark, d):
    """L-shaped sites set back by five metres: sharp at convex corners, round at the other one."""
    return parcels.offset_sites(corner_sites(spark, d), 5.0).select("site_id", "part", F.bround("area", 2).alias("area"))


@query(f"SELECT site_id, k, round_even((w * h - a * b) * CASE k WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END, 3) AS area FROM {_L}, (SELECT unnest([0, 1, 2]) AS k)")
def split_any_shape(spark, d):
    """L-shaped sites cut into three shares of their area."""
    parts = parcels.split_any(corner_sites(spark, d))
    return parts.groupBy("site_id", "k").agg(F.bround(F.sum("area"), 3).alias("area"))


@query(
    "WITH s AS (SELECT p_partkey AS site_id, 70.0::DOUBLE + p_size AS w, 20.0::DOUBLE + p_partkey % 40 AS h FROM part), p AS (SELECT site_id, CASE k WHEN 0 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END * w - 6 AS w, h FROM s, (SELECT unnest([0, 1]) AS k))"
    f" SELECT site_id, w > 24 AND h > 24 AS rounded, round_even(w * h - CASE WHEN w > 24 AND h > 24 THEN 4 * 144 * (1 - {_QUARTER}) ELSE 0 END, 2) AS area FROM p"
)
def internal_roads(spark, d):
    """Rectangular sites divided by an internal road; corners are rounded where the plot is large enough."""
    k, s = F.col("p_partkey"), F.col("p_size")
    w, h, z = s + 70, k % 40 + 20, F.lit(0)
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    sites = i.table(spark, d, "part").select(k.alias("site_id"), F.array(at(z, z), at(w, z), at(w, h), at(z, h)).alias("shell"), F.array(F.lit(0.6), F.lit(0.4)).alias("shares"))
    return parcels.internal_roads(sites).select("site_id", "rounded", F.bround("area", 2).alias("area"))


def _at(x, y):
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


@query(
    "WITH s AS (SELECT s_suppkey AS k, 100 + s_nationkey * 4 AS l FROM supplier) SELECT k AS feature, CASE WHEN k % 3 = 0 THEN 4 ELSE 1 END AS lines, 0 AS off, CAST(round_even((CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END) * (l - 20) / 10.0, 0) AS BIGINT) AS tens FROM s"
)
def centre_lines(spark, d):
    """Centre lines of roads that stand alone: straight ones, and every third one crossed by another at its middle. They lie
    on the axis and end half a width before the road does."""
    k, size = F.col("s_suppkey"), F.col("s_nationkey") * 4 + 100
    x, y = k % 20 * 600, F.floor(k / 20) * 600
    flat = F.array(_at(x - size / 2, y), _at(x + size / 2, y))
    cross = F.when(k % 3 == 0, F.array(_at(x, y - size / 2), _at(x, y + size / 2)))
    roads = i.table(spark, d, "supplier").select(F.explode(F.filter(F.array(flat, cross), lambda p: p.isNotNull())).alias("pts"))
    lines = centre.centre_lines(roads, 10.0, 5.0, 500.0)
    mid = F.get("pts", F.lit(0))
    column, row = F.round(mid["x"] / 600).cast("long"), F.round(mid["y"] / 600).cast("long")
    off = F.array_max(F.transform("pts", lambda p: F.least(F.abs(p["x"] - column * 600), F.abs(p["y"] - row * 600))))
    per = lines.select((row * 20 + column).alias("feature"), off.alias("off"), centre.length_of(F.col("pts")).alias("size"))
    return per.groupBy("feature").agg(F.count("*").cast("int").alias("lines"), F.bround(F.max("off"), 0).cast("int").alias("off"), F.bround(F.sum("size") / 10, 0).cast("long").alias("tens"))


@query(f"WITH {_CITY}, f AS (SELECT c.x, c.y, (r.x - c.x) * (t.y - c.y) AS area FROM wide c JOIN wide r ON r.i = c.i + 1 AND r.j = c.j JOIN wide t ON t.i = c.i AND t.j = c.j + 1) SELECT x, y, round_even(area, 3) AS area FROM f")
def plane_faces(spark, d):
    """The faces between the axes of a city's roads."""
    ends = city_roads(spark, d).select(F.get("pts", F.lit(0)).alias("a"), F.get("pts", F.lit(1)).alias("b")).distinct()
    found, _ = overlay.faces(ends.select(F.lit(0).cast("long").alias("gid"), F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by")))
    least = lambda c: F.array_min(F.transform("shell", lambda p: p[c])).alias(c)
    return found.select(least("x"), least("y"), F.bround("area", 3).alias("area"))


_JUNCTIONS = "s AS (SELECT s_suppkey AS k, s_suppkey % 20 AS i, 200.0::DOUBLE * (s_suppkey % 20) AS x, 200.0::DOUBLE * (s_suppkey // 20) AS y FROM supplier), a AS (SELECT s.* FROM s JOIN s n ON n.k = s.k + 1 AND s.i < 19)"


@query(
    f"WITH {_JUNCTIONS}, b AS (SELECT a.* FROM a JOIN a p ON p.k = a.k - 1 AND a.i > 0) SELECT x + 10 AS ax, y AS ay, x + 200 AS bx, y AS by FROM a"
    " UNION ALL SELECT x, y, x + 5, y FROM b UNION ALL SELECT x + 5, y, x + 10, y FROM b"
)
def interchanges(spark, d):
    """Interchanges, each a ring of four roads, in rows: a ring between two others becomes a place on the road through it."""
    s = i.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    x, y, k = F.col("k") % 20 * 200, F.floor(F.col("k") / 20) * 200, F.col("k")
    e = lambda ax, ay, bx, by: F.struct(*(v.cast("double").alias(n) for v, n in ((ax, "ax"), (ay, "ay"), (bx, "bx"), (by, "by"))))
    ring = s.select(F.explode(F.array(e(x, y, x + 10, y), e(x + 10, y, x + 10, y + 10), e(x, y + 10, x + 10, y + 10), e(x, y, x, y + 10))).alias("e"))
    arms = s.join(s.select((F.col("k") - 1).alias("k")), "k").where(k % 20 < 19).select(e(x + 10, y, x + 200, y).alias("e"))
    boxes = s.select(F.col("k").alias("id"), *((v + o).cast("double").alias(n) for v, o, n in ((x, -1, "x0"), (y, -1, "y0"), (x, 11, "x1"), (y, 11, "y1"))))
    return interchange.simplify_interchanges(ring.union(arms).select("e.*"), boxes, 100.0)


@query(
    "WITH p AS MATERIALIZED (SELECT DISTINCT c_nationkey AS gid, c_custkey * 7919 % 10007 AS x, c_custkey * 104729 % 9973 AS y FROM customer),"
    " pairs AS (SELECT p.gid, p.x AS ax, p.y AS ay, q.x - p.x AS dx, q.y - p.y AS dy FROM p JOIN p q ON q.gid = p.gid AND (q.x <> p.x OR q.y <> p.y)),"
    " sides AS (SELECT e.*, (r.x - ax) * dx + (r.y - ay) * dy AS s, (r.y - ay) * dx - (r.x - ax) * dy AS t FROM pairs e JOIN p r ON r.gid = e.gid),"
    " edges AS (SELECT gid, ax, ay, dx, dy, max(s) - min(s) AS l, max(t) AS w, dx * dx + dy * dy AS q FROM sides GROUP BY gid, ax, ay, dx, dy HAVING min(t) >= 0 AND min(CASE WHEN t = 0 THEN s ELSE 0 END) >= 0 AND max(CASE WHEN t = 0 THEN s ELSE 0 END) <= dx * dx + dy * dy)"
    " SELECT CAST(gid AS BIGINT) AS gid, count(*) AS corners, round_even(min(CAST(l AS DOUBLE) * w / q), 3) AS area, round_even(min(w / sqrt(CAST(q AS DOUBLE))), 6) AS width FROM edges GROUP BY gid HAVING count(*) > 2"
)
def least_boxes(spark, d):
    """Corners of the hull of each nation's customers, the least area of a box about it, and the least width of one."""
    k = F.col("c_custkey")
    rings = hulls.hulls(i.table(spark, d, "customer").select(F.col("c_nationkey").alias("gid"), (k * 7919 % 10007).alias("x"), (k * 104729 % 9973).alias("y")))
    rings = Stored(rings.where("size(ring) > 2")).df
    narrow = hulls.least_boxes(rings, "width").select("gid", F.bround("width", 6).alias("width"))
    return rings.select("gid", F.size("ring").cast("long").alias("corners")).join(hulls.least_boxes(rings).select("gid", F.bround("area", 3).alias("area")), "gid").join(narrow, "gid")


#: L-shapes in groups of 40, on whole numbers, so that what they cover together can be counted in unit squares.
_COVERED = """s AS (SELECT p_partkey // 40 AS gid, p_partkey * 17 % 53 AS x, p_partkey * 29 % 47 AS y, 6 + p_partkey % 7 AS w, 5 + p_size % 5 AS h FROM part),
 c AS MATERIALIZED (SELECT DISTINCT gid, x + i AS i, y + j AS j FROM s, range(12) a(i), range(10) b(j) WHERE i < w AND j < h AND NOT (i >= w - 3 AND j >= h - 2)),
 n AS (SELECT gid, i + 1 AS i, j FROM c UNION ALL SELECT gid, i - 1, j FROM c UNION ALL SELECT gid, i, j + 1 FROM c UNION ALL SELECT gid, i, j - 1 FROM c)"""


@query(
    f"WITH {_COVERED} SELECT CAST(gid AS BIGINT) AS gid, CAST(count(*) AS DOUBLE) AS area, CAST((SELECT count(*) FROM n WHERE n.gid = c.gid AND NOT EXISTS (SELECT 1 FROM c o WHERE o.gid = n.gid AND o.i = n.i AND o.j = n.j)) AS DOUBLE) AS border FROM c GROUP BY gid"
)
def dissolve(spark, d):
    """Area and border of what overlapping and touching L-shapes cover together."""
    k = F.col("p_partkey")
    x, y, w, h = k * 17 % 53, k * 29 % 47, k % 7 + 6, F.col("p_size") % 5 + 5
    shell = F.array(_at(x, y), _at(x + w, y), _at(x + w, y + h - 2), _at(x + w - 3, y + h - 2), _at(x + w - 3, y + h), _at(x, y + h))
    own = i.table(spark, d, "part").select(F.floor(k / 40).alias("gid"), F.when(k % 2 == 0, shell).otherwise(F.reverse(shell)).alias("shell"))
    rings = overlay.dissolve(own, 12.0)
    around = centre.length_of(F.concat("shell", F.slice("shell", 1, 1)))
    return rings.groupBy("gid").agg(F.bround(F.sum("area"), 3).alias("area"), F.bround(F.sum(around), 3).alias("border"))
