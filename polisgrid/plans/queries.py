"""Queries of the engine over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polisgrid.functions import geom
from polisgrid.operators import design, graph, lines, network, planning, resources, spatial, visibility
from polisgrid.plans import inputs as i
from polisgrid.plans.rounds import Stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = re.sub(r"\bby\b", '"by"', sql)  # a column here, the keyword is in capitals
        return f

    return add


# --- resources ------------------------------------------------------------------------------------------------


def _use_sql(k: int, scale: str, src: str = i.PARTS) -> str:
    return f"""SELECT building, part, function, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, round_even((lo + hi) / 2.0 * CAST({scale} AS DOUBLE), 6) AS use FROM (SELECT p.*,
 round_even(amount * lo_rate, 0) AS lo, round_even(amount * hi_rate, 0) AS hi FROM {src} p JOIN {i.rates_sql(k)} r USING (function))"""


def _use(df: DataFrame) -> DataFrame:
    return df.select("building", "part", "function", "lo", "hi", F.bround("use", 6).alias("use"))


@query(_use_sql(0, "8766"))
def res_energy(spark, d):
    return _use(resources.energy(i.building_parts(spark, d), i.rates(spark, 0)))


@query(_use_sql(1, "0.36525"))
def res_water(spark, d):
    return _use(resources.water(i.building_parts(spark, d), i.rates(spark, 1)))


_BUILDINGS = "(SELECT p_partkey AS building, 0 AS part, {use} AS function, p_retailprice AS area, p_size AS floors FROM part)".format(use=i.coded_sql("p_type", i.USES, "R"))
_BAND = "CASE " + " ".join(f"WHEN floors BETWEEN {b[1]} AND {b[2]} THEN {{{k}}}" for k, b in enumerate(i.BANDS)) + f" WHEN floors > {i.BANDS[-1][2]} THEN {{{len(i.BANDS) - 1}}} END"
_PEOPLE = f"""(SELECT *, CAST({_BAND.format(*(b[0] for b in i.BANDS))} AS INTEGER) AS band, CAST(round_even(area / {_BAND.format(*(f"{b[3]}.0" for b in i.BANDS))}, 0) AS BIGINT) AS people FROM {_BUILDINGS})"""


def _buildings(spark, d):
    p = i.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("building"), F.lit(0).alias("part"), i.coded(F.col("p_type"), i.USES, "R").alias("function"), F.col("p_retailprice").alias("area"), F.col("p_size").alias("floors"))


@query(f"SELECT building, function, band, people FROM {_PEOPLE}")
def res_population(spark, d):
    return resources.population(_buildings(spark, d), i.bands(spark)).select("building", "function", "band", "people")


@query(_use_sql(2, "0.36525", f"(SELECT building, part, function, CAST(people AS DOUBLE) AS amount FROM {_PEOPLE})"))
def res_waste(spark, d):
    people = resources.population(_buildings(spark, d), i.bands(spark)).select("building", "part", "function", F.col("people").cast("double").alias("amount"))
    return _use(resources.waste(people, i.rates(spark, 2)))


@query(f"SELECT building, round_even(sum(use) * CAST(0.75 AS DOUBLE) * CAST(0.001 AS DOUBLE), 6) AS tonnes FROM ({_use_sql(0, '8766')}) GROUP BY building")
def res_energy_co2(spark, d):
    per = resources.energy(i.building_parts(spark, d), i.rates(spark, 0)).groupBy("building").agg(F.sum("use").alias("use"))
    return per.select("building", F.bround(resources.energy_carbon(F.col("use")), 6).alias("tonnes"))


@query("SELECT o_orderkey AS building, CAST(o_orderkey % 4 AS INTEGER) AS method, round_even(o_totalprice / 1000 * CASE o_orderkey % 4 WHEN 0 THEN 2.13::DOUBLE WHEN 1 THEN 0.321::DOUBLE WHEN 2 THEN 0.12::DOUBLE ELSE 0::DOUBLE END, 8) AS tonnes FROM orders")
def res_waste_co2(spark, d):
    o = i.table(spark, d, "orders").select(F.col("o_orderkey").alias("building"), (F.col("o_orderkey") % 4).cast("int").alias("method"), (F.col("o_totalprice") / 1000).alias("t"))
    return o.select("building", "method", F.bround(resources.waste_carbon(F.col("t"), F.col("method")), 8).alias("tonnes"))


@query(f"SELECT building, function, CAST(sum(lo) AS BIGINT) AS lo, CAST(sum(hi) AS BIGINT) AS hi, CAST((sum(lo) + sum(hi)) // 2 AS BIGINT) AS mid FROM ({_use_sql(0, '8766')}) GROUP BY building, function")
def res_rollup(spark, d):
    return resources.roll_up(resources.energy(i.building_parts(spark, d), i.rates(spark, 0)), ["building", "function"])


@query(f"SELECT p_partkey AS building, CAST(ceil((p_retailprice / 20 - p_size) / 3) AS BIGINT) AS floors, CAST(round_even(ceil((p_retailprice / 20 - p_size) / 3) * p_size * lo_rate, 0) AS BIGINT) AS lo, CAST(round_even(ceil((p_retailprice / 20 - p_size) / 3) * p_size * hi_rate, 0) AS BIGINT) AS hi FROM (SELECT *, {i.coded_sql('p_type', i.USES, 'R')} AS function FROM part) JOIN {i.rates_sql(1)} r USING (function)")
def res_custom_water(spark, d):
    p = i.table(spark, d, "part").select(F.col("p_partkey").alias("building"), i.coded(F.col("p_type"), i.USES, "R").alias("function"), "p_size", resources.storeys(F.col("p_retailprice") / 20 - F.col("p_size")).alias("floors"))
    return resources.water(p.withColumn("amount", (F.col("floors") * F.col("p_size")).cast("double")), i.rates(spark, 1)).select("building", "floors", "lo", "hi")


# --- planning -------------------------------------------------------------------------------------------------

_TARGET = "(SELECT landuse, sum(area) * CAST(2.5 AS DOUBLE) AS target FROM b GROUP BY landuse)"


def _far_targets(b: DataFrame) -> DataFrame:
    return b.groupBy("landuse").agg((F.sum("area") * 2.5).alias("target"))


@query(f"""WITH b AS (SELECT * FROM {i.BLOCKS}), p AS (SELECT landuse, sum(area * acc) AS a, sum(area) AS s, min(acc) AS low, any_value(target) AS t FROM b JOIN {_TARGET} t USING (landuse) GROUP BY landuse),
 q AS (SELECT landuse, a, s, t, greatest(coalesce((0.8 - t / s) / nullif(low - a / s, 0), 0), 0) AS x FROM p)
 SELECT block_id, landuse, round_even(x * acc + t / s - a / s * x, 1) AS far FROM b JOIN q USING (landuse)""")
def far_allocate(spark, d):
    b = i.blocks(spark, d)
    return planning.allocate_far(b.select("block_id", "landuse", "area", "acc"), _far_targets(b))


_SHARE = " ".join(f"WHEN '{k}' THEN {v}" for k, v in planning.FAR_LEVELS.items())


@query(f"""WITH b AS (SELECT * FROM {i.BLOCKS}) SELECT landuse, level, round_even(target * (CASE level {_SHARE} END) / 30.0, 4) AS target FROM {_TARGET} t, (VALUES ('District'), ('T15'), ('T10'), ('T5')) v(level)""")
def far_level_targets(spark, d):
    return planning.level_targets(_far_targets(i.blocks(spark, d)), "District").select("landuse", "level", F.bround("target", 4).alias("target"))


@query(f"""WITH r AS (SELECT id AS sid, avg(1 / pow(CASE WHEN sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)) = 0 THEN 1e-6 ELSE sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)) END, 2)) AS raw FROM {i.POINTS} p, {i.TARGETS} t GROUP BY id)
 SELECT sid, round_even((raw - (SELECT min(raw) FROM r)) / nullif((SELECT max(raw) FROM r) - (SELECT min(raw) FROM r), 0), 6) AS score FROM r""")
def gravity_score(spark, d):
    s = planning.gravity(i.points(spark, d).select(F.col("id").alias("sid"), "x", "y"), i.targets(spark, d), 2.0)
    return s.select("sid", F.bround("score", 6).alias("score"))


@query(f"SELECT site_id, round_even(area / total * 1000, 6) AS demand FROM (SELECT block_id AS site_id, area, sum(area) OVER (PARTITION BY landuse) AS total FROM {i.BLOCKS})")
def demand_area_share(spark, d):
    b = i.blocks(spark, d).select(F.col("block_id").alias("site_id"), "landuse", "area")
    demands = spark.createDataFrame([(u, 1000.0) for u in sorted(set(i.LAND.values()))], "landuse string, demand double")
    return planning.demand_shares(b, demands).select("site_id", F.bround("demand", 6).alias("demand"))


@query(f"SELECT landuse, round_even(sum(area), 2) AS area, round_even(sum(area) / (SELECT sum(area) FROM {i.BLOCKS}), 6) AS share FROM {i.BLOCKS} GROUP BY landuse")
def landuse_structure(spark, d):
    return planning.landuse_structure(i.blocks(spark, d)).select("landuse", F.bround("area", 2).alias("area"), F.bround("share", 6).alias("share"))


@query(f"WITH p AS (SELECT cluster_id, sum(area) AS area, sum(remain) AS remain FROM {i.BLOCKS} GROUP BY cluster_id HAVING sum(remain) >= 0.5 * sum(area)) SELECT cluster_id, round_even(area, 2) AS area, round_even(area / (SELECT sum(area) FROM p), 6) AS share FROM p")
def cluster_area_share(spark, d):
    return planning.cluster_shares(i.blocks(spark, d), 0.5).select("cluster_id", F.bround("area", 2).alias("area"), F.bround("share", 6).alias("share"))


@query("SELECT v AS text, trim(split_part(v, ':', 1)) AS landuse, CAST(split_part(v, ':', 2) AS DOUBLE) AS share FROM (SELECT DISTINCT left(c_mktsegment, 1) || ':0.' || (c_custkey % 9 + 1) AS v FROM customer)")
def landuse_parse(spark, d):
    c = i.table(spark, d, "customer").select(F.concat(F.substring("c_mktsegment", 1, 1), F.lit(":0."), (F.col("c_custkey") % 9 + 1).cast("string")).alias("text")).distinct()
    use, share = planning.parse_shares(F.col("text"))
    return c.select("text", use.alias("landuse"), share.alias("share"))


_XY = "(SELECT l_returnflag AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem)"


def _xy(spark, d):
    return i.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))


@query(f"SELECT g, round_even(regr_slope(y, x), 4) AS slope, round_even(regr_intercept(y, x), 3) AS intercept, round_even(regr_r2(y, x), 6) AS r2 FROM {_XY} GROUP BY g")
def regress_linear(spark, d):
    r = planning.regress(_xy(spark, d), F.col("x"), F.col("y"), ["g"])
    return r.select("g", F.bround("slope", 4).alias("slope"), F.bround("intercept", 3).alias("intercept"), F.bround("r2", 6).alias("r2"))


@query(f"SELECT g, round_even(exp(regr_intercept(ln(y), ln(x))), 4) AS a, round_even(regr_slope(ln(y), ln(x)), 6) AS b, round_even(regr_r2(ln(y), ln(x)), 6) AS r2 FROM {_XY} WHERE x > 0 AND y > 0 GROUP BY g")
def regress_power(spark, d):
    return planning.power_regression(_xy(spark, d), ["g"]).select("g", F.bround("a", 4).alias("a"), F.bround("b", 6).alias("b"), F.bround("r2", 6).alias("r2"))


@query(f"SELECT g, round_even(exp(regr_intercept(ln(y), x)), 3) AS a, round_even(exp(regr_slope(ln(y), x)), 6) AS b, round_even(regr_r2(ln(y), x), 6) AS r2 FROM {_XY} WHERE y > 0 GROUP BY g")
def regress_exponential(spark, d):
    return planning.exponential_regression(_xy(spark, d), ["g"]).select("g", F.bround("a", 3).alias("a"), F.bround("b", 6).alias("b"), F.bround("r2", 6).alias("r2"))


@query("SELECT c_custkey, round_even((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / ((SELECT max(c_acctbal) - min(c_acctbal) FROM customer)), 6) AS score FROM customer")
def minmax_normalise(spark, d):
    return planning.normalise(i.table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("score")), "score").select("c_custkey", F.bround("score", 6).alias("score"))


@query(f"""SELECT cluster_id, block_id, round_even(greatest(0, least(remain, 20000 - before)), 4) AS given FROM (SELECT *, coalesce(sum(remain) OVER (PARTITION BY cluster_id ORDER BY acc DESC, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {i.BLOCKS})""")
def landuse_running_fill(spark, d):
    return planning.running_fill(i.blocks(spark, d), F.lit(20000.0)).select("cluster_id", "block_id", F.bround("given", 4).alias("given"))


_FILL = (("R", 0.4), ("A", 0.1), ("B", 0.2), ("M", 0.1), ("W", 0.05))


def _fill_sql() -> str:
    out = [f"s0 AS MATERIALIZED (SELECT cluster_id, block_id, remain, acc, sum(remain) OVER (PARTITION BY cluster_id) AS whole FROM {i.BLOCKS})"]
    for k, (use, share) in enumerate(_FILL):
        key = "acc" if use in ("M", "W") else "acc DESC"
        out.append(f"h{k} AS (SELECT *, whole * {share}::DOUBLE AS target, coalesce(sum(remain) OVER (PARTITION BY cluster_id ORDER BY {key}, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM s{k})")
        out.append(f"t{k} AS MATERIALIZED (SELECT *, CASE WHEN had + 1000 < target AND remain > 0 THEN CASE WHEN remain - (target - had) <= 1000 THEN remain ELSE target - had END END AS take FROM h{k})")
        out.append(f"s{k + 1} AS (SELECT cluster_id, block_id, remain - coalesce(take, 0) AS remain, acc, whole FROM t{k})")
    return "WITH " + ", ".join(out) + " " + " UNION ALL ".join(f"SELECT cluster_id, block_id, '{use}' AS landuse, round_even(take, 6) AS area FROM t{k} WHERE take IS NOT NULL" for k, (use, _) in enumerate(_FILL))


@query(_fill_sql())
def landuse_fill(spark, d):
    b = i.blocks(spark, d)
    total = b.groupBy("cluster_id").agg(F.sum("remain").alias("r"))
    wanted = total.select("cluster_id", F.explode(F.array(*[F.struct(F.lit(k).alias("priority"), F.lit(u).alias("landuse"), F.lit(s).alias("s")) for k, (u, s) in enumerate(_FILL)])).alias("t"), "r")
    out = planning.fill_landuse(b, wanted.select("cluster_id", "t.priority", "t.landuse", (F.col("r") * F.col("t.s")).alias("target")), "T10")
    return out.withColumn("area", F.bround("area", 6))


@query()
def hac_rows(spark, d):
    """The clusters of hac_clusters, with distances as rows."""
    p = i.points(spark, d)
    l, r = (p.select(F.col("id").alias(f"{s}id"), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y")) for s in "lr")
    near = spatial.radius_join(l, r, 8.0).where("lid < rid").select(F.col("lid").alias("i"), F.col("rid").alias("j"), "dist")
    return planning.cluster_rows(p.select("id"), near, [4.0, 8.0])


@query()
def hac_clusters(spark, d):
    """Clusters at two limits, and the components at the larger one (g) that they lie in."""
    p = i.points(spark, d)
    l, r = (p.select(F.col("id").alias(f"{s}id"), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y")) for s in "lr")
    near = Stored(spatial.radius_join(l, r, 8.0).where("lid < rid").select(F.col("lid").alias("i"), F.col("rid").alias("j"), "dist"))
    found = graph.components(p.select("id"), near.df.select(F.col("i").alias("src"), F.col("j").alias("dst")))
    made = planning.cluster_rows(p.select("id"), near.df, [4.0, 8.0])
    near.drop()
    return made.join(found.withColumnRenamed("root", "g"), "id").select("g", "level", "cluster_id", "id")


@query(f"""WITH e AS (SELECT s_suppkey AS site, k, s_acctbal / 20 + dx AS x, s_nationkey * 20 - 250 + dy AS y FROM supplier, (VALUES (0, 5.0::DOUBLE, 0.0::DOUBLE), (1, -5.0::DOUBLE, 0.0::DOUBLE), (2, 0.0::DOUBLE, 5.0::DOUBLE), (3, 0.0::DOUBLE, -5.0::DOUBLE)) v(k, dx, dy)),
 n AS (SELECT site, k, arg_min(id, (sqrt((e.x - p.x) * (e.x - p.x) + (e.y - p.y) * (e.y - p.y)), id)) AS id FROM e, {i.POINTS} p GROUP BY site, k)
 SELECT site AS site_id, CAST(max(id % 1000) AS DOUBLE) AS score FROM n GROUP BY site""")
def site_accessibility(spark, d):
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("dx"), F.lit(b).alias("dy")) for k, (a, b) in enumerate(((5.0, 0.0), (-5.0, 0.0), (0.0, 5.0), (0.0, -5.0)))])).alias("v")
    e = i.table(spark, d, "supplier").select(F.col("s_suppkey").alias("site_id"), (F.col("s_acctbal") / 20).alias("x"), (F.col("s_nationkey") * 20 - 250).cast("double").alias("y"), at)
    e = e.select("site_id", "v.k", (F.col("x") + F.col("v.dx")).alias("x"), (F.col("y") + F.col("v.dy")).alias("y"))
    roads = i.points(spark, d).select(F.col("id").alias("road_id"), "x", "y", (F.col("id") % 1000).cast("double").alias("score"))
    return planning.site_accessibility(e, roads, 50.0)


# --- geometry and spatial joins -------------------------------------------------------------------------------


@query(f"SELECT user_id, seq, round_even(sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)), 6) AS length FROM {i.SEGMENTS}")
def seg_length(spark, d):
    return i.segments(spark, d).select("user_id", F.col("seq").cast("long").alias("seq"), F.bround(geom.length2(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")), 6).alias("length"))


@query(f"SELECT user_id, CAST(seq AS BIGINT) AS seq, ax, ay, bx, by FROM {i.SEGMENTS}")
def adjacent_pairs(spark, d):
    return i.segments(spark, d).withColumn("seq", F.col("seq").cast("long"))


@query(f"""WITH t AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first_value(x) OVER w AS fx, first_value(y) OVER w AS fy FROM {i.TRACKS} WINDOW w AS (PARTITION BY user_id ORDER BY seq))
 SELECT user_id, round_even(abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2, 3) AS area FROM t GROUP BY user_id""")
def shoelace_area(spark, d):
    ring = i.tracks(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("r"))
    ring = ring.select("user_id", F.concat("r", F.slice("r", 1, 1)).alias("r"))
    return ring.select("user_id", F.bround(F.abs(geom.signed_area(F.col("r"))), 3).alias("area"))


@query(f"""WITH s AS (SELECT user_id * 100000 + seq AS id, *, sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) AS l FROM {i.SEGMENTS}),
 k AS (SELECT *, unnest(CASE WHEN l < 30 THEN [1] ELSE range(1, CAST(ceil(l / 30) AS BIGINT)) END) AS k FROM s)
 SELECT id, CAST(k AS BIGINT) AS k, round_even(ax + (CASE WHEN l < 30 THEN 0.5::DOUBLE ELSE k * 30.0::DOUBLE / l END) * (bx - ax), 4) AS x, round_even(ay + (CASE WHEN l < 30 THEN 0.5::DOUBLE ELSE k * 30.0::DOUBLE / l END) * (by - ay), 4) AS y FROM k""")
def divide_line(spark, d):
    s = i.segments(spark, d).withColumn("id", F.col("user_id") * 100000 + F.col("seq"))
    return spatial.divide_line(s.select("id", "ax", "ay", "bx", "by"), 30.0).select("id", "k", F.bround("x", 4).alias("x"), F.bround("y", 4).alias("y"))


def _sides(spark, d):
    p = i.points(spark, d)
    return p.select(F.col("id").alias("lid"), F.col("x").alias("lx"), F.col("y").alias("ly")), p.select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.abs("z").alias("area"))


@query(f"SELECT a.id AS lid, b.id AS rid, round_even(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS dist FROM {i.POINTS} a, {i.POINTS} b WHERE a.id < b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 20")
def radius_join(spark, d):
    l, r = _sides(spark, d)
    return spatial.radius_join(l, r, 20.0).where("lid < rid").select("lid", "rid", F.bround("dist", 6).alias("dist"))


@query(f"SELECT a.id AS lid, round_even(sum(abs(b.z)), 3) AS total FROM {i.POINTS} a, {i.POINTS} b WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 50 GROUP BY a.id")
def radius_join_sum(spark, d):
    l, r = _sides(spark, d)
    return spatial.radius_sum(l, r, 50.0, "area").select("lid", F.bround("total", 3).alias("total"))


_BOXES = f"(SELECT id, x AS x0, x + abs(z) / 10 AS x1, y AS y0, y + abs(z) / 20 AS y1 FROM {i.POINTS})"


@query(f"SELECT l.id AS lid, r.id AS rid FROM {_BOXES} l, {_BOXES} r WHERE l.id < r.id AND l.x0 <= r.x1 AND r.x0 <= l.x1 AND l.y0 <= r.y1 AND r.y0 <= l.y1")
def bbox_join(spark, d):
    b = i.points(spark, d).select("id", F.col("x").alias("x0"), (F.col("x") + F.abs("z") / 10).alias("x1"), F.col("y").alias("y0"), (F.col("y") + F.abs("z") / 20).alias("y1"))
    l, r = (b.select(*(F.col(c).alias(p + c) for c in b.columns)) for p in "lr")
    return spatial.box_join(l, r, 20.0).where("lid < rid").select("lid", "rid")


_KNN = f"SELECT t.tid AS lid, p.id AS rid, sqrt((tx - x) * (tx - x) + (ty - y) * (ty - y)) AS dist, row_number() OVER (PARTITION BY t.tid ORDER BY sqrt((tx - x) * (tx - x) + (ty - y) * (ty - y)), p.id) AS rank FROM {i.TARGETS} t, {i.POINTS} p"


def _knn(spark, d, k):
    q = i.targets(spark, d).select(F.col("tid").alias("lid"), F.col("tx").alias("lx"), F.col("ty").alias("ly"))
    return spatial.nearest(q, _sides(spark, d)[1].drop("area"), k, 40.0).select("lid", "rid", F.bround("dist", 6).alias("dist"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT lid, rid, round_even(dist, 6) AS dist, rank FROM ({_KNN}) WHERE rank <= 1")
def nearest_site(spark, d):
    return _knn(spark, d, 1)


@query(f"SELECT lid, rid, round_even(dist, 6) AS dist, rank FROM ({_KNN}) WHERE rank <= 5")
def knn(spark, d):
    return _knn(spark, d, 5)


_ENDS = f"(SELECT ax AS x, ay AS y FROM {i.GRID} UNION ALL SELECT bx, by FROM {i.GRID})"


@query(f"SELECT x, y, count(*) AS degree FROM {_ENDS} GROUP BY x, y")
def endpoint_degree(spark, d):
    return spatial.endpoint_degree(i.grid(spark, d))


@query(f"WITH busy AS (SELECT x, y FROM {_ENDS} GROUP BY x, y HAVING count(*) > 1) SELECT g.* FROM {i.GRID} g WHERE (ax, ay) IN (SELECT (x, y) FROM busy) AND (bx, by) IN (SELECT (x, y) FROM busy)")
def remove_dangles(spark, d):
    return spatial.remove_dangles(i.grid(spark, d)).select("id", "ax", "ay", "bx", "by")


_CROSS = f"""SELECT l.id AS lid, r.id AS rid, l.ax + ((r.ax - l.ax) * (r.by - r.ay) - (r.ay - l.ay) * (r.bx - r.ax)) / nullif((l.bx - l.ax) * (r.by - r.ay) - (l.by - l.ay) * (r.bx - r.ax), 0) * (l.bx - l.ax) AS x,
 l.ay + ((r.ax - l.ax) * (r.by - r.ay) - (r.ay - l.ay) * (r.bx - r.ax)) / nullif((l.bx - l.ax) * (r.by - r.ay) - (l.by - l.ay) * (r.bx - r.ax), 0) * (l.by - l.ay) AS y,
 ((r.ax - l.ax) * (r.by - r.ay) - (r.ay - l.ay) * (r.bx - r.ax)) / nullif((l.bx - l.ax) * (r.by - r.ay) - (l.by - l.ay) * (r.bx - r.ax), 0) AS t,
 ((r.ax - l.ax) * (l.by - l.ay) - (r.ay - l.ay) * (l.bx - l.ax)) / nullif((l.bx - l.ax) * (r.by - r.ay) - (l.by - l.ay) * (r.bx - r.ax), 0) AS s FROM {i.GRID} l, {i.GRID} r WHERE l.id <> r.id"""


@query(f"SELECT lid, rid, round_even(x, 6) AS x, round_even(y, 6) AS y FROM ({_CROSS}) WHERE lid < rid AND t BETWEEN 0 AND 1 AND s BETWEEN 0 AND 1")
def segment_crossings(spark, d):
    g = i.grid(spark, d)
    l, r = (g.select(*(F.col(c).alias(p + c) for c in g.columns)) for p in "lr")
    return spatial.crossings(l, r, 2.0, 6).where("lid < rid")


@query(f"""WITH p AS (SELECT lid AS id, round_even(x, 6) AS x, round_even(y, 6) AS y FROM ({_CROSS}) WHERE t BETWEEN 0 AND 1 AND s BETWEEN 0 AND 1 UNION SELECT id, ax, ay FROM {i.GRID} UNION SELECT id, bx, by FROM {i.GRID}),
 q AS (SELECT id, row_number() OVER w AS seq, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by FROM p WINDOW w AS (PARTITION BY id ORDER BY x, y)) SELECT id, seq, ax, ay, bx, by FROM q WHERE bx IS NOT NULL""")
def split_segments(spark, d):
    return spatial.split_segments(i.grid(spark, d), 2.0).withColumn("seq", F.col("seq").cast("long"))


@query(f"SELECT a.id, min(b.id) AS rep FROM {i.POINTS} a, {i.POINTS} b WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 15 GROUP BY a.id")
def snap_points(spark, d):
    return spatial.snap_points(i.points(spark, d), 15.0).select("id", "rep")


@query(f"SELECT min(id) AS id, round_even(x / 50, 0) AS x, round_even(y / 50, 0) AS y FROM {i.POINTS} GROUP BY 2, 3")
def clean_points(spark, d):
    return spatial.clean_points(i.points(spark, d).select("id", (F.col("x") / 50).alias("x"), (F.col("y") / 50).alias("y")), 0)


@query(f"SELECT p.id AS pid, t.tid AS gid FROM {i.POINTS} p, {i.TARGETS} t WHERE abs(x - tx) + abs(y - ty) < 120")
def point_in_polygon(spark, d):
    pt = lambda x, y: F.struct((F.col("tx") + x).alias("x"), (F.col("ty") + y).alias("y"))
    diamonds = i.targets(spark, d).select(F.col("tid").alias("gid"), F.array(pt(120.0, 0.0), pt(0.0, 120.0), pt(-120.0, 0.0), pt(0.0, -120.0), pt(120.0, 0.0)).alias("shell"))
    return spatial.inside(i.points(spark, d).select(F.col("id").alias("pid"), "x", "y"), diamonds, 60.0)


@query("SELECT s_suppkey AS id, CAST(2.0 * (s_nationkey + 1) * (s_suppkey % 7 + 1) AS DOUBLE) AS area FROM supplier")
def clean_polygons(spark, d):
    s = i.table(spark, d, "supplier")
    pt = lambda x, y: F.struct((F.col("s_suppkey") * 1.0 + x).alias("x"), (F.lit(0.0) + y).alias("y"))
    w, h = (F.col("s_nationkey") + 1) * 1.0, (F.col("s_suppkey") % 7 + 1) * 2.0
    turn = F.col("s_suppkey") % 2 == 0
    ring = F.array(pt(F.lit(0.0), F.lit(0.0)), pt(w, F.lit(0.0)), pt(w, h), pt(F.lit(0.0), h), pt(F.lit(0.0), F.lit(0.0)))
    return spatial.clean_polygons(s.select(F.col("s_suppkey").alias("id"), F.when(turn, F.reverse(ring)).otherwise(ring).alias("shell"))).select("id", F.bround("area", 6).alias("area"))


@query("SELECT p_partkey, p_name, (length(trim(p_name)) > 0 AND NOT regexp_matches(trim(p_name), '[\\\\/:*?\"<>|''%;&]')) AS legal FROM part")
def legal_names(spark, d):
    return i.table(spark, d, "part").select("p_partkey", "p_name", geom.legal_name(F.col("p_name")).alias("legal"))


@query(f"SELECT id, round_even(acos(greatest(-1, least(1, round_even((x * tx + y * ty) / nullif(sqrt(x * x + y * y) * sqrt(tx * tx + ty * ty), 0), 9)))), 5) AS angle FROM {i.POINTS} p JOIN {i.TARGETS} t ON p.id % 25 = t.tid")
def vector_angles(spark, d):
    p = i.points(spark, d).withColumn("tid", F.col("id") % 25).join(i.targets(spark, d), "tid")
    z = F.lit(0.0)
    return p.select("id", F.bround(geom.angle(F.col("x"), F.col("y"), z, F.col("tx"), F.col("ty"), z), 5).alias("angle"))


# --- graphs ---------------------------------------------------------------------------------------------------


@query(f"WITH {i.ROADS_WITH} SELECT src AS id, count(*) AS degree FROM {i.ROADS} GROUP BY src")
def degree(spark, d):
    return graph.degree(i.road_graph(spark, d).where("src < dst"))


_DUAL = f"""WITH g AS (SELECT id, sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) AS l, ax, ay, bx, by FROM {i.GRID} WHERE ax <> bx OR ay <> by),
 e AS (SELECT id, l, ax AS px, ay AS py, bx AS qx, by AS qy FROM g UNION ALL SELECT id, l, bx, by, ax, ay FROM g),
 m AS (SELECT a.id AS v, b.id AS u, (a.l + b.l) / 2 AS w, acos(greatest(-1, least(1, round_even(((a.px - a.qx) * (b.qx - b.px) + (a.py - a.qy) * (b.qy - b.py)) / (a.l * b.l), 9)))) * 2 / pi() AS t FROM e a JOIN e b ON a.px = b.px AND a.py = b.py AND a.id < b.id)"""


@query(_DUAL + " SELECT v, u, round_even(min(w), 6) AS w_metric, round_even(min(t), 4) AS w_angular FROM m GROUP BY v, u")
def dual_graph_edges(spark, d):
    g = i.grid(spark, d).where("ax != bx or ay != by")
    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(0.0).alias("z"))
    s = g.select("id", pt("ax", "ay").alias("a"), pt("bx", "by").alias("b"), geom.length2(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("length"))
    return graph.dual_graph(s).select("v", "u", "w_metric", F.bround("w_angular", 4).alias("w_angular"))


_NEAR = f"(SELECT a.id AS src, b.id AS dst FROM {i.POINTS} a, {i.POINTS} b WHERE a.id <> b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 12)"
_COMPONENTS = f"WITH RECURSIVE n AS MATERIALIZED (SELECT * FROM {_NEAR}), c AS (SELECT id AS a, id AS b FROM {i.POINTS} UNION SELECT c.a, n.dst FROM c JOIN n ON c.b = n.src), r AS (SELECT a AS id, min(b) AS root FROM c GROUP BY a)"


def _near_components(spark, d):
    l, r = _sides(spark, d)
    near = spatial.radius_join(l, r, 12.0).where("lid < rid").select(F.col("lid").alias("src"), F.col("rid").alias("dst"))
    return graph.components(l.select(F.col("lid").alias("id")), near)


@query(_COMPONENTS + " SELECT id, root FROM r")
def graph_components(spark, d):
    return _near_components(spark, d)


@query(_COMPONENTS + " SELECT root, count(*) AS size FROM r GROUP BY root ORDER BY size DESC, root LIMIT 1")
def giant_component(spark, d):
    return graph.giant(_near_components(spark, d))


def _one(spark):
    return spark.createDataFrame([(0,)], "id long")


@query(i.walks_sql(5, "1") + " SELECT source, id, CAST(dist AS BIGINT) AS depth FROM d5 WHERE source = 0")
def bfs_levels(spark, d):
    return graph.levels(i.road_graph(spark, d), _one(spark))


@query(i.walks_sql() + " SELECT source, id, round_even(dist, 6) AS dist FROM d5 WHERE source = 0")
def sssp(spark, d):
    return graph.shortest_paths(i.road_graph(spark, d), _one(spark)).select("source", "id", F.bround("dist", 6).alias("dist"))


_PATH = """, t AS (SELECT d5.id, round_even(d5.dist, 6) AS dist FROM d5 WHERE source = 0), g(id, hops) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT e.dst, g.hops + 1 FROM g JOIN t a ON a.id = g.id JOIN e ON e.src = g.id JOIN t b ON b.id = e.dst WHERE e.dst <> 0 AND abs(a.dist + e.w - b.dist) < 1e-5),
 h AS (SELECT id, min(hops) AS hops FROM g GROUP BY id), p AS (SELECT b.id, min(a.id) AS prev FROM h b JOIN e ON e.dst = b.id JOIN h a ON a.id = e.src AND a.hops + 1 = b.hops JOIN t x ON x.id = a.id JOIN t y ON y.id = b.id WHERE b.id <> 0 AND abs(x.dist + e.w - y.dist) < 1e-5 GROUP BY b.id),
 w(id, step) AS (SELECT CAST(24 AS BIGINT), 0 UNION ALL SELECT p.prev, w.step + 1 FROM w JOIN p ON p.id = w.id) SELECT CAST(0 AS BIGINT) AS source, CAST(24 AS BIGINT) AS target, step, id FROM w"""


@query(i.walks_sql().replace("WITH ", "WITH RECURSIVE ", 1) + _PATH)
def shortest_path(spark, d):
    paths = graph.shortest_paths(i.road_graph(spark, d), _one(spark))
    return graph.path_to(paths, spark.createDataFrame([(24,)], "id long"))


def _centrality(spark, d, **more):
    e = i.road_graph(spark, d)
    return graph.measures(graph.centrality(e.select(F.col("src").alias("id")).distinct(), e, **more))


_SS = i.walks_sql() + ", c AS (SELECT source AS id, sum(dist) AS td, count(*) AS n FROM d5 GROUP BY source)"


@query(_SS + " SELECT id, round_even(td, 6) AS total_depth, n AS reached FROM c")
def ss_depth_count(spark, d):
    return _centrality(spark, d).select("id", F.bround("total_depth", 6).alias("total_depth"), "reached")


@query(_SS + " SELECT id, round_even(CASE WHEN td <> 0 THEN CAST(n AS DOUBLE) * n / td ELSE 0 END, 6) AS integration FROM c")
def ss_integration(spark, d):
    return _centrality(spark, d).select("id", F.bround("integration", 6).alias("integration"))


@query(_SS + " SELECT id, round_even(CASE WHEN td <> 0 THEN td / (n - 1) ELSE 0 END, 5) AS mean_depth FROM c")
def ss_mean_depth(spark, d):
    return _centrality(spark, d).select("id", F.bround("mean_depth", 5).alias("mean_depth"))


@query(_SS + " SELECT id, round_even(CASE WHEN td <> 0 THEN pow(n + 2, 1.2) / td ELSE 0 END, 6) AS nain FROM c")
def ss_nain(spark, d):
    return _centrality(spark, d).select("id", F.bround("nain", 6).alias("nain"))


@query()
def ss_choice(spark, d):
    return _centrality(spark, d, no_triangles=True).select("id", F.bround("choice", 6).alias("choice"), F.bround("nach", 6).alias("nach"))


@query(i.walks_sql() + " SELECT source AS id, count(*) AS reached, round_even(sum(dist), 6) AS total_depth FROM d5 WHERE dist <= 60 GROUP BY source")
def ss_radius(spark, d):
    return _centrality(spark, d, limit=60.0).select("id", "reached", F.bround("total_depth", 6).alias("total_depth"))


_CHAINS = f"""WITH RECURSIVE e AS (SELECT id, ax AS x, ay AS y FROM {i.GRID} UNION ALL SELECT id, bx, by FROM {i.GRID}), t AS (SELECT min(id) AS a, max(id) AS b FROM e GROUP BY x, y HAVING count(*) = 2 AND min(id) <> max(id)),
 l AS (SELECT a, b FROM t UNION SELECT b, a FROM t), r AS (SELECT id AS a, id AS b FROM {i.GRID} UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b), m AS (SELECT a, min(b) AS chain FROM r GROUP BY a)"""


@query(_CHAINS + " SELECT chain, count(*) AS parts FROM m GROUP BY chain")
def merge_chains(spark, d):
    pt = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return graph.merge_chains(i.grid(spark, d).select("id", pt("ax", "ay").alias("a"), pt("bx", "by").alias("b")))


# --- networks -------------------------------------------------------------------------------------------------

_SITES = "(SELECT s_suppkey AS site, CAST(s_nationkey AS BIGINT) AS vertex, abs(s_acctbal) AS area FROM supplier)"


def _sites(spark, d):
    return i.table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_nationkey").cast("long").alias("vertex"), F.abs("s_acctbal").alias("area"))


def _sources(spark):
    return spark.createDataFrame([(0,), (7,), (19,)], "id long")


@query(i.walks_sql() + f" SELECT source, site FROM d5 JOIN {_SITES} s ON s.vertex = d5.id WHERE source IN (0, 7, 19) AND dist <= 60")
def coverage_sites(spark, d):
    return network.coverage(i.road_graph(spark, d), _sites(spark, d).select("site", "vertex"), _sources(spark), 60.0)


@query(i.walks_sql() + f" SELECT source, round_even(sum(area) / (SELECT sum(area) FROM {_SITES}), 6) AS ratio FROM d5 JOIN {_SITES} s ON s.vertex = d5.id WHERE source IN (0, 7, 19) AND dist <= 60 GROUP BY source")
def coverage_ratio(spark, d):
    s = _sites(spark, d)
    return network.coverage_ratio(network.coverage(i.road_graph(spark, d), s.select("site", "vertex"), _sources(spark), 60.0), s.select("site", "area")).select("source", F.bround("ratio", 6).alias("ratio"))


@query(i.walks_sql() + f" SELECT a.site AS i, b.site AS j, round_even(min(dist), 6) AS dist FROM d5 JOIN {_SITES} a ON a.vertex = d5.source JOIN {_SITES} b ON b.vertex = d5.id WHERE a.site < b.site GROUP BY a.site, b.site")
def site_distance_matrix(spark, d):
    return network.distance_matrix(i.road_graph(spark, d), _sites(spark, d).select("site", "vertex"), places=6)


@query(i.walks_sql() + " SELECT id, arg_min(source, (dist, source)) AS source, round_even(min(dist), 6) AS dist FROM d5 WHERE source IN (0, 7, 19) GROUP BY id")
def nearest_source(spark, d):
    paths = graph.shortest_paths(i.road_graph(spark, d), _sources(spark))
    return network.nearest_source(paths).select("id", "source", F.bround("dist", 6).alias("dist"))


@query("SELECT l_suppkey AS pipe, sum(o_totalprice)::DECIMAL(18,2)::DOUBLE AS flow FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey")
def path_flow(spark, d):
    line = i.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("junction")).agg(F.collect_set("l_suppkey").alias("pipes"))
    demand = i.table(spark, d, "orders").select(F.col("o_orderkey").alias("junction"), F.col("o_totalprice").alias("demand"))
    return network.pipe_flow(line, demand).select("pipe", F.bround("flow", 2).alias("flow"))


_PRICES = ((0.1, 95.0), (0.15, 150.0), (0.2, 230.0), (0.3, 420.0), (0.4, 640.0), (0.6, 1200.0))


def _pipe_sql() -> str:
    v = ", ".join(f"({k}, CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))" for k, (a, b) in enumerate(_PRICES))
    return f"""WITH p AS (SELECT * FROM (VALUES {v}) v(k, dia, cost)), f AS (SELECT regr_slope(ln(cost), ln(dia)) AS b FROM p),
 t AS (SELECT pow(5.33 / b, 1 / 3.0) * pow((pow(q.dia, b) - pow(p.dia, b)) / (pow(p.dia, -5.33) - pow(q.dia, -5.33)), 1 / 3.0) * 1000 AS th FROM p JOIN p q ON q.k = p.k + 1, f),
 c AS (SELECT o_orderkey AS pipe, o_totalprice / 1000 AS flow FROM orders)
 SELECT pipe, (SELECT dia FROM p WHERE k = (SELECT count(*) FROM t WHERE th < flow)) AS diameter FROM c"""


@query(_pipe_sql())
def pipe_diameter(spark, d):
    dia, steps = network.flow_thresholds(spark.createDataFrame(list(_PRICES), "diameter double, cost double"))
    return i.table(spark, d, "orders").select(F.col("o_orderkey").alias("pipe"), network.diameter(F.col("o_totalprice") / 1000, dia, steps).alias("diameter"))


# --- visibility -----------------------------------------------------------------------------------------------

_EXPOSE = f"""WITH v AS (SELECT tid AS vid, tx / 100 + 5 AS x, ty / 100 + 3 AS y FROM {i.TARGETS}), a AS (SELECT unnest(range(0, 360, 36)) AS deg),
 h AS (SELECT v.vid, deg, g.id, ((g.ax - x) * (g.by - g.ay) - (g.ay - y) * (g.bx - g.ax)) / nullif(cos(radians(deg)) * (g.by - g.ay) - sin(radians(deg)) * (g.bx - g.ax), 0) AS t,
 ((g.ax - x) * sin(radians(deg)) - (g.ay - y) * cos(radians(deg))) / nullif(cos(radians(deg)) * (g.by - g.ay) - sin(radians(deg)) * (g.bx - g.ax), 0) AS u FROM v, a, {i.GRID} g)
 SELECT o AS outline, count(*) AS hits FROM (SELECT vid, deg, arg_min(id, (round_even(t, 6), id)) AS o FROM h WHERE t >= 0 AND u >= 0 AND u <= 1 AND round_even(t, 6) <= 4 GROUP BY vid, deg) GROUP BY o"""


@query(_EXPOSE)
def exposure2d(spark, d):
    v = i.targets(spark, d).select(F.col("tid").alias("vid"), (F.col("tx") / 100 + 5).alias("x"), (F.col("ty") / 100 + 3).alias("y"))
    return visibility.exposure_2d(v, i.grid(spark, d).withColumnRenamed("id", "oid"), 10, 4.0)


def _scene(spark, d):
    g = i.grid(spark, d).where("ax != bx or ay != by")
    w = visibility.walls(g.select(F.col("id").alias("oid"), F.col("id").alias("seq"), "ax", "ay", "bx", "by", (F.col("id") % 4 + 2).cast("double").alias("height")))
    v = i.targets(spark, d).select(F.col("tid").alias("vid"), (F.col("tx") / 100 + 5.13).alias("x"), (F.col("ty") / 100 + 3.07).alias("y"), F.lit(1.6).alias("z"))
    return v, w


def _cross(u: list[str], v: list[str]) -> list[str]:
    return [f"({u[a]} * {v[b]} - {u[b]} * {v[a]})" for a, b in ((1, 2), (2, 0), (0, 1))]


def _dots(u: list[str], v: list[str]) -> str:
    return "(" + " + ".join(f"{a} * {b}" for a, b in zip(u, v, strict=True)) + ")"


def _seen_sql(reach: float) -> str:
    """CTEs ending in seen (vid, tri, dist, area): by all rays to all centres and all triangles in their way."""
    normal = _cross(["(qx - px)", "(qy - py)", "(qz - pz)"], ["(rx - px)", "(ry - py)", "(rz - pz)"])
    h = _cross(["dx", "dy", "dz"], ["(b.rx - b.px)", "(b.ry - b.py)", "(b.rz - b.pz)"])
    s = ["(x - b.px)", "(y - b.py)", "(z - b.pz)"]
    first, second = ["(b.qx - b.px)", "(b.qy - b.py)", "(b.qz - b.pz)"], ["(b.rx - b.px)", "(b.ry - b.py)", "(b.rz - b.pz)"]
    q = _cross(s, first)
    return f"""WITH v AS (SELECT tid AS vid, tx / 100 + 5.13::DOUBLE AS x, ty / 100 + 3.07::DOUBLE AS y, 1.6::DOUBLE AS z FROM {i.TARGETS}),
 g AS (SELECT *, (id % 4 + 2)::DOUBLE AS top FROM {i.GRID} WHERE ax <> bx OR ay <> by),
 m AS (SELECT id * 2 AS tri, ax AS px, ay AS py, 0::DOUBLE AS pz, bx AS qx, by AS qy, 0::DOUBLE AS qz, bx AS rx, by AS ry, top AS rz FROM g UNION ALL SELECT id * 2 + 1, ax, ay, 0, bx, by, top, ax, ay, top FROM g),
 n AS (SELECT *, (px + qx + rx) / 3 AS cx, (py + qy + ry) / 3 AS cy, (pz + qz + rz) / 3 AS cz, {normal[0]} AS nx, {normal[1]} AS ny, {normal[2]} AS nz FROM m),
 w AS (SELECT vid, tri, x, y, z, cx - x AS wx, cy - y AS wy, cz - z AS wz, nx, ny, nz FROM v, n),
 c AS (SELECT vid, tri, x, y, z, sqrt(wx * wx + wy * wy + wz * wz) AS dist, wx / sqrt(wx * wx + wy * wy + wz * wz) AS dx, wy / sqrt(wx * wx + wy * wy + wz * wz) AS dy, wz / sqrt(wx * wx + wy * wy + wz * wz) AS dz, sqrt(nx * nx + ny * ny + nz * nz) / 2 AS area
 FROM w WHERE sqrt(wx * wx + wy * wy + wz * wz) < {reach} AND nx * wx + ny * wy + nz * wz < 0),
 k AS (SELECT vid, c.tri, dist, {_dots(h, first)} AS det, {_dots(s, h)} AS su, {_dots(["dx", "dy", "dz"], q)} AS sv, {_dots(second, q)} AS st FROM c, n b),
 f AS (SELECT vid, tri, min(st / det) AS first FROM k WHERE abs(det) > 1e-12 AND su / det >= -1e-9 AND sv / det >= -1e-9 AND su / det + sv / det <= 1 + 1e-9 AND st / det > 1e-9 GROUP BY vid, tri),
 seen AS (SELECT c.vid, c.tri, c.dist, c.area FROM c JOIN f ON f.vid = c.vid AND f.tri = c.tri WHERE abs(f.first - c.dist) <= 1e-4)"""


@query(_seen_sql(6.0) + " SELECT vid, tri, round_even(area, 6) AS area FROM seen")
def exposure3d(spark, d):
    v, w = _scene(spark, d)
    return visibility.exposure_3d(v, w.select("tri", "p", "q", "r"), 6.0).select("vid", "tri", F.bround("amount", 6).alias("area"))


@query(_seen_sql(6.0) + " SELECT vid, round_even(sum(area * exp(-0.5::DOUBLE * dist)), 6) AS visible FROM seen GROUP BY vid")
def exposure3d_decay(spark, d):
    v, w = _scene(spark, d)
    return visibility.exposure_3d(v, w.select("tri", "p", "q", "r"), 6.0, 0.5).groupBy("vid").agg(F.bround(F.sum("amount"), 6).alias("visible"))


@query(f"SELECT id * 2 + k AS tri, round_even(sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) * (id % 4 + 2) / 2, 6) AS area FROM {i.GRID}, (VALUES (0), (1)) v(k) WHERE ax <> bx OR ay <> by")
def wall_mesh(spark, d):
    return _scene(spark, d)[1].select("tri", F.bround(visibility.triangle_area(F.col("p"), F.col("q"), F.col("r")), 6).alias("area"))


@query(f"SELECT tid AS vid, h, v, round_even(cos(h * 2 * pi() / 12) * cos(v * pi() / 6 - pi() / 2), 6) + 0 AS dx, round_even(sin(v * pi() / 6 - pi() / 2), 6) + 0 AS dz FROM {i.TARGETS}, (SELECT unnest(range(0, 12)) AS h), (SELECT unnest(range(0, 7)) AS v)")
def ray_fan(spark, d):
    f = visibility.ray_fan(i.targets(spark, d).select(F.col("tid").alias("vid")), 12, 6)
    return f.select("vid", F.col("h").cast("long").alias("h"), F.col("v").cast("long").alias("v"), (F.bround("dx", 6) + 0).alias("dx"), (F.bround("dz", 6) + 0).alias("dz"))


@query("WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey) SELECT l_suppkey AS vertex, n AS hits, round_even(255 + CASE WHEN (SELECT max(n) FROM c) <= 1 THEN 1 ELSE ln(n) / ln((SELECT max(n) FROM c)) END * (0 - 255), 4) AS red FROM c")
def hit_colours(spark, d):
    c = i.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("vertex")).agg(F.count("*").alias("hits"))
    both = c.join(F.broadcast(c.agg(F.max("hits").alias("most"))))
    return both.select("vertex", "hits", F.bround(visibility.shade(F.col("hits").cast("double"), F.col("most").cast("double"), 255.0, 0.0), 4).alias("red"))


# --- design ---------------------------------------------------------------------------------------------------

_HOUSES = f"(SELECT p_partkey AS building_id, {i.coded_sql('p_type', i.USES, 'R')} AS kind, p_retailprice AS footprint, CAST(p_size % 3 AS BIGINT) AS bottom, CAST(p_size AS BIGINT) AS top, CAST(3.0 + (p_size % 2) * 1.2 AS DOUBLE) AS floor_height FROM part)"


def _houses(spark, d):
    p = i.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("building_id"), i.coded(F.col("p_type"), i.USES, "R").alias("kind"), F.col("p_retailprice").alias("footprint"), (F.col("p_size") % 3).cast("long").alias("bottom"), F.col("p_size").cast("long").alias("top"), (F.lit(3.0) + (F.col("p_size") % 2) * F.lit(1.2)).alias("floor_height"))


@query(f"SELECT building_id, 0 AS part, 'C' AS function, round_even(footprint * bottom, 3) AS area, round_even(bottom * floor_height * 1.2::DOUBLE, 3) AS height FROM {_HOUSES} WHERE bottom > 0 UNION ALL SELECT building_id, 1, kind, round_even(footprint * top, 3), round_even(top * floor_height, 3) FROM {_HOUSES} WHERE top > 0")
def building_parts(spark, d):
    return design.building_parts(_houses(spark, d))


@query(f"SELECT building_id, CAST(CASE WHEN bottom + greatest(top + round_even((footprint * 1.1::DOUBLE - footprint) * (bottom + top) / footprint, 0), 0) < 1 THEN 1 ELSE greatest(top + round_even((footprint * 1.1::DOUBLE - footprint) * (bottom + top) / footprint, 0), 0) END AS BIGINT) AS floors FROM {_HOUSES}")
def floor_correction(spark, d):
    h = _houses(spark, d)
    return h.select("building_id", design.correct_floors(F.col("footprint") * 1.1, F.col("footprint"), F.col("bottom"), F.col("top")).cast("long").alias("floors"))


@query("SELECT p_partkey AS id, CAST(CASE WHEN p_size > 0 AND p_size <= 3 THEN 3.0 WHEN p_size > 3 AND p_size <= 33 THEN 4.5 WHEN p_size > 33 AND p_size <= 3000000 THEN 6.5 ELSE 4.5 END AS DOUBLE) AS setback FROM part")
def setback_band(spark, d):
    return i.table(spark, d, "part").select(F.col("p_partkey").alias("id"), design.band(F.col("p_size"), design.SETBACK_HOMES).alias("setback"))


_CAP = """WITH s AS (SELECT s_suppkey AS id, 0.9 + s_suppkey % 50 / 10.0::DOUBLE AS far, 0.1 + s_nationkey / 100.0::DOUBLE AS density, 60.0::DOUBLE + s_suppkey % 90 AS l, 5.2::DOUBLE AS k FROM supplier),
 f AS (SELECT *, least(far, 0.9::DOUBLE * ((1 - 2 / 3.0::DOUBLE) * 26 * k * 45 * 45 + l * 26 * 45) / (l * k * 45 + l * 26)) AS f FROM s),
 r AS (SELECT *, l / (k * (1 - 2 / 3.0::DOUBLE)) - l * f / (26 * 0.9::DOUBLE * (1 - 2 / 3.0::DOUBLE)) AS b, -l * f / (k * 0.9::DOUBLE * (1 - 2 / 3.0::DOUBLE)) AS c FROM f),
 n AS (SELECT *, least(ceil(greatest((-b + sqrt(b * b - 4 * c)) / 2, 26 / k)), 45) AS n FROM r)
 SELECT id, round_even(f, 6) AS far, round_even(least(density, f / n), 6) AS density, CAST(greatest(n, round_even(f / least(density, f / n), 0)) AS BIGINT) AS floors FROM n"""


@query(_CAP)
def res_density_cap(spark, d):
    s = i.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.lit(0.9) + F.col("s_suppkey") % 50 / 10.0).alias("far"), (F.lit(0.1) + F.col("s_nationkey") / 100.0).alias("density"), (F.lit(60.0) + F.col("s_suppkey") % 90).alias("edge"))
    f, dens, n = design.density_cap(F.col("far"), F.col("density"), F.col("edge"), F.lit(5.2))
    return s.select("id", F.bround(f, 6).alias("far"), F.bround(dens, 6).alias("density"), n.alias("floors"))


@query("SELECT s_suppkey AS id, round_even((sqrt(l * l + 4 * k * (t - a)) - l) / (2 * k), 6) AS distance FROM (SELECT *, 40.0::DOUBLE + s_suppkey % 30 AS l, 4.0::DOUBLE AS k, 100.0::DOUBLE + s_nationkey AS a, 400.0::DOUBLE + s_suppkey % 11 AS t FROM supplier)")
def offset_distance(spark, d):
    s = i.table(spark, d, "supplier")
    x = design.offset_distance(F.lit(40.0) + F.col("s_suppkey") % 30, F.lit(4.0), F.lit(100.0) + F.col("s_nationkey"), F.lit(400.0) + F.col("s_suppkey") % 11)
    return s.select(F.col("s_suppkey").alias("id"), F.bround(x, 6).alias("distance"))


#: Homes by type with their range of floors.
_HOMES = (("R1", 1, 6), ("R2", 3, 9), ("R3", 6, 15), ("R4", 9, 18), ("R5", 12, 33), ("R6", 18, 60), ("R7", 27, 150))


_DRAW = "(CAST('0x' || substr(md5('0|' || site_id || '|' || {key}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


@query("WITH t AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', {a}, {b})" for t, a, b in _HOMES) + f""") v(type, lo, hi)), b AS (SELECT s_suppkey AS site_id, type, (1.0::DOUBLE + s_suppkey % 6) / 0.25 BETWEEN lo AND hi AS fits FROM supplier, t),
 c AS (SELECT *, bool_or(fits) OVER (PARTITION BY site_id) AS one_fits FROM b), r AS (SELECT site_id, type, row_number() OVER (PARTITION BY site_id ORDER BY {_DRAW.format(key="type")}, type) AS k FROM c WHERE fits OR NOT one_fits) SELECT site_id, type FROM r WHERE k <= 3""")
def type_select(spark, d):
    s = i.table(spark, d, "supplier").select(F.col("s_suppkey").alias("site_id"), F.lit("R").alias("kind"), (F.lit(1.0) + F.col("s_suppkey") % 6).alias("far"), F.lit(0.25).alias("density"))
    types = spark.createDataFrame([("R", t, a, b) for t, a, b in _HOMES], "kind string, type string, floor_lo int, floor_hi int")
    return design.choose_types(s, types)


_PROGRAM = """WITH s AS (SELECT s_suppkey AS site_id, abs(s_acctbal) + 500 AS cap, abs(s_acctbal) * 4 + 3000 AS built FROM supplier),
 n AS (SELECT site_id, built, a, b, CAST(floor((cap - a * 300 - b * 420) / 600) AS BIGINT) AS c FROM s, (SELECT unnest(range(0, 40)) AS a), (SELECT unnest(range(0, 30)) AS b) WHERE a * 300 + b * 420 <= cap),
 m AS (SELECT site_id, built, a, b, c, row_number() OVER (PARTITION BY site_id ORDER BY a * 300 + b * 420 + c * 600 DESC, a + b + c, a DESC, b DESC) AS k FROM n),
 o AS (SELECT site_id, built, CASE WHEN a + b + c = 0 THEN 1 ELSE a END AS a, b, c FROM m WHERE k = 1),
 p AS (SELECT *, 300 * greatest(a, 1) AS x, 420 * greatest(b, 1) AS y, 600 * greatest(c, 1) AS z FROM o),
 f AS (SELECT p.*, i, j, least(60, CAST(floor((built - i * x - j * y) / z) AS BIGINT)) AS l FROM p, (SELECT unnest(range(1, 7)) AS i), (SELECT unnest(range(6, 16)) AS j)),
 g AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY i * x + j * y + l * z DESC, i + j + l, i DESC, j DESC) AS k FROM f WHERE l >= 18),
 h AS (SELECT o.site_id, a, b, c, coalesce(g.i, 1) AS i, coalesce(g.j, 6) AS j, coalesce(g.l, 18) AS l FROM o LEFT JOIN (SELECT site_id, i, j, l FROM g WHERE k = 1) g USING (site_id))
 SELECT site_id, CAST(v AS INTEGER) AS k, CAST(CASE v WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS INTEGER) AS count, CAST(CASE v WHEN 0 THEN i WHEN 1 THEN j ELSE l END AS INTEGER) AS floors FROM h, (VALUES (0), (1), (2)) t(v)"""


@query(_PROGRAM)
def floor_programs(spark, d):
    s = i.table(spark, d, "supplier").select(F.col("s_suppkey").alias("site_id"), (F.abs("s_acctbal") + 500).alias("capacity"), (F.abs("s_acctbal") * 4 + 3000).alias("floor_area"))
    return design.programs(s.select("site_id", "capacity", "floor_area", F.array(F.lit(300.0), F.lit(420.0), F.lit(600.0)).alias("areas"), F.array(F.lit(1), F.lit(6), F.lit(18)).alias("floor_lo"), F.array(F.lit(6), F.lit(15), F.lit(60)).alias("floor_hi")))


@query("SELECT s_suppkey AS site_id, k, round_even((s_nationkey + 20) * (s_suppkey % 40 + 10) * share, 3) AS area FROM supplier, (VALUES (0, 0.5::DOUBLE), (1, 0.3::DOUBLE), (2, 0.2::DOUBLE)) v(k, share)")
def polygon_split(spark, d):
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    w, h, z = F.col("s_nationkey") + 20, F.col("s_suppkey") % 40 + 10, F.lit(0)
    s = i.table(spark, d, "supplier").select(F.col("s_suppkey").alias("site_id"), F.array(pt(z, z), pt(w, z), pt(w, h), pt(z, h)).alias("shell"), F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)).alias("shares"))
    return design.split_sites(s).select("site_id", "k", F.bround("area", 3).alias("area"))


_TREES = """WITH a AS (SELECT s_suppkey AS site_id, (abs(s_acctbal) + 100) * 0.3::DOUBLE AS want FROM supplier), b AS (SELECT *, floor(want / (pi() * 45)) AS cycles FROM a), c AS (SELECT *, want - cycles * (pi() * 45) AS rest FROM b),
 e AS (SELECT site_id, cycles * 6 + (SELECT count(*) FROM (VALUES (0.0), (2.25), (4.5), (6.75), (15.75), (24.75)) v(before) WHERE rest > pi() * before + 1e-9) AS n FROM c)
 SELECT site_id, n, [1.5, 1.5, 1.5, 3.0, 3.0, 4.5][n % 6 + 1]::DOUBLE AS radius FROM (SELECT site_id, unnest(range(CAST(n AS BIGINT))) AS n FROM e)"""


@query(_TREES)
def site_trees(spark, d):
    return design.trees(i.table(spark, d, "supplier").select(F.col("s_suppkey").alias("site_id"), (F.abs("s_acctbal") + 100).alias("area")), F.lit(0.3))


@query(f"""WITH a AS (SELECT s_suppkey AS site_id, abs(s_acctbal) / 50 + 60 AS width, unnest(range(0, CAST(ceil((abs(s_acctbal) / 50 + 60) / 16) AS BIGINT) + 1)) AS k FROM supplier),
 b AS (SELECT *, 16 + {_DRAW.format(key="k")} * 8 AS w FROM a), c AS (SELECT *, sum(w) OVER (PARTITION BY site_id ORDER BY k) AS x1 FROM b), e AS (SELECT *, x1 - w AS x0 FROM c WHERE x1 - w < width), f AS (SELECT *, max(k) OVER (PARTITION BY site_id) AS last FROM e)
 SELECT site_id, k, round_even(x0, 6) AS x0, round_even(x1, 6) AS x1 FROM f WHERE k > 0 AND k < last""")
def courtyard_strips(spark, d):
    s = design.courtyard_strips(i.table(spark, d, "supplier").select(F.col("s_suppkey").alias("site_id"), (F.abs("s_acctbal") / 50 + 60).alias("width")))
    return s.select("site_id", "k", F.bround("x0", 6).alias("x0"), F.bround("x1", 6).alias("x1"))


# --- sources --------------------------------------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round_even(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def events_hourly(spark, d):
    from polisgrid.streaming.volumes import hourly

    return hourly(i.table(spark, d, "events")).withColumn("total", F.bround("total", 2))


@query("SELECT event_id, 'int' AS kind, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def attributes_typing(spark, d):
    from polisgrid.sources.files import attribute, typed

    e = i.table(spark, d, "events").select("event_id", attribute(typed(F.col("props")), "k").alias("a"))
    return e.select("event_id", "a.kind", F.col("a.int_value").alias("k"))


@query("SELECT CAST(user_id AS BIGINT) AS link_id, CAST(hour(ts) AS INTEGER) AS hour, round_even(sum(value), 2) AS volume FROM events GROUP BY 1, 2")
def link_stats_unpivot(spark, d):
    from polisgrid.sources.files import link_volumes

    e = i.table(spark, d, "events").withColumn("h", F.hour("ts"))
    wide = e.groupBy("user_id").pivot("h", list(range(24))).agg(F.sum("value"))
    stats = wide.select(F.col("user_id").alias("LINK"), F.col("user_id").alias("FROM"), F.col("user_id").alias("TO"), F.lit(10.0).alias("FREESPEED"), F.lit(100.0).alias("CAPACITY"), *(F.col(str(h)).alias(f"HRS{h}-{h + 1}avg") for h in range(24)))
    return link_volumes(stats).where("volume is not null").select(F.col("link_id").cast("long").alias("link_id"), "hour", F.bround("volume", 2).alias("volume"))


@query("SELECT s_suppkey AS id, CAST(s_nationkey AS DOUBLE) AS x, CAST(s_suppkey AS DOUBLE) AS y FROM supplier")
def geojson_roundtrip(spark, d):
    from polisgrid.plans.rounds import shared_folder
    from polisgrid.sources import files

    s = i.table(spark, d, "supplier")
    features = s.select(files.feature_json(F.lit("Point"), F.array(F.col("s_nationkey").cast("double"), F.col("s_suppkey").cast("double")), F.struct(F.col("s_suppkey").alias("id"))).alias("f"))
    path = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    files.write_features(features, "f", path)
    back = files.read_geojson(spark, path, by_line=True)
    return back.select(F.get_json_object("properties", "$.id").cast("long").alias("id"), F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"))




# --- lines, parameters and further joins ------------------------------------------------------------------------

_REGION = [(-20.0, -20.0), (300.0, -20.0), (300.0, 400.0), (-20.0, 400.0)]


def _clip_sql() -> str:
    first, last, out = "0::DOUBLE", "1::DOUBLE", []
    for (px, py), (qx, qy) in zip(_REGION, _REGION[1:] + _REGION[:1], strict=True):
        ex, ey = qx - px, qy - py
        start = f"({ex}::DOUBLE * (ay - {py}::DOUBLE) - {ey}::DOUBLE * (ax - {px}::DOUBLE))"
        slope = f"({ex}::DOUBLE * (by - ay) - {ey}::DOUBLE * (bx - ax))"
        first = f"CASE WHEN {slope} > 0 THEN greatest({first}, -{start} / {slope}) ELSE {first} END"
        last = f"CASE WHEN {slope} < 0 THEN least({last}, -{start} / {slope}) ELSE {last} END"
        out.append(f"({slope} = 0 AND {start} < 0)")
    return f"CASE WHEN {' OR '.join(out)} THEN 0 ELSE greatest(0, {last} - {first}) END"


@query(f"SELECT round_even(sum(sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) * {_clip_sql()}) / {320.0 * 420.0}::DOUBLE, 6) AS density FROM {i.SEGMENTS}")
def road_density(spark, d):
    return lines.road_density(i.segments(spark, d), _REGION).select("density")


def _track_lines(spark, d):
    t = i.tracks(spark, d).groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    return t.select("id", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("pts"))


@query()
def simplify_lines(spark, d):
    return lines.simplify_lines(_track_lines(spark, d), 10.0).select("id", F.size("pts").alias("n"))


@query(f"SELECT user_id AS id, CAST(1 + sum(greatest(1, ceil(sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) / 25))) AS INTEGER) AS n FROM {i.SEGMENTS} GROUP BY user_id")
def densify_lines(spark, d):
    return _track_lines(spark, d).where("size(pts) > 1").select("id", F.size(lines.densify(F.col("pts"), 25.0)).alias("n"))


@query("SELECT s_suppkey AS site_id, CASE WHEN s_suppkey % 3 = 0 THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END AS far, CASE WHEN s_suppkey % 2 = 0 THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS density FROM supplier")
def override_parameters(spark, d):
    s = i.table(spark, d, "supplier")
    base = s.select(F.col("s_suppkey").alias("site_id"), F.lit(1.0).alias("far"), F.lit(0.2).alias("density"))
    given = s.select(F.col("s_suppkey").alias("site_id"), F.when(F.col("s_suppkey") % 3 == 0, F.lit(2.5)).alias("far"), F.when(F.col("s_suppkey") % 2 == 0, F.lit(0.3)).alias("density"))
    return design.override(base, given, "site_id", ["far", "density"])


@query("SELECT s_suppkey AS site_id, CAST(greatest(1, round_even(abs(s_acctbal) * 40 / (72000 / (1 - 0.1::DOUBLE * 1.2::DOUBLE)), 0)) AS INTEGER) AS parts FROM supplier")
def refine_sites(spark, d):
    s = i.table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("site_id"), design.refine_count(F.abs("s_acctbal") * 40, F.lit(design.MAX_AREA["R"]), F.lit(0.1), F.lit(design.MIX_COEFFICIENT["R"])).alias("parts"))


@query("SELECT l_suppkey AS site_id, round_even(sum(l_quantity) / any_value(abs(s_acctbal) + 5000), 3) AS density, round_even(sum(l_quantity * l_linenumber) / any_value(abs(s_acctbal) + 5000), 3) AS far FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey")
def building_rollup(spark, d):
    b = i.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("site_id"), F.col("l_quantity").alias("footprint"), (F.col("l_quantity") * F.col("l_linenumber")).alias("area"))
    s = i.table(spark, d, "supplier").select(F.col("s_suppkey").alias("site_id"), (F.abs("s_acctbal") + 5000).alias("area"))
    return design.roll_up_buildings(b, s)


@query("SELECT vertex, count(*) AS hits FROM (SELECT unnest([l_suppkey, l_suppkey + 1, l_suppkey + 2]) AS vertex FROM lineitem) GROUP BY vertex")
def vertex_hits(spark, d):
    hits = i.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("tri"))
    corners = i.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tri"), F.col("s_suppkey").alias("v0"), (F.col("s_suppkey") + 1).alias("v1"), (F.col("s_suppkey") + 2).alias("v2"))
    return visibility.vertex_hits(hits, corners)


_PROJECT = f"""SELECT t.tid AS pid, g.id AS sid, sqrt(pow(tx / 100 + 5 - (ax + u * (bx - ax)), 2) + pow(ty / 100 + 3 - (ay + u * (by - ay)), 2)) AS dist FROM {i.TARGETS} t, LATERAL (SELECT *, greatest(0, least(1,
 coalesce(((tx / 100 + 5 - ax) * (bx - ax) + (ty / 100 + 3 - ay) * (by - ay)) / nullif((bx - ax) * (bx - ax) + (by - ay) * (by - ay), 0), 0))) AS u FROM {i.GRID}) g"""


@query(f"SELECT pid, round_even(min(dist), 6) AS dist FROM ({_PROJECT}) GROUP BY pid HAVING min(dist) <= 4")
def connect_to_roads(spark, d):
    p = i.targets(spark, d).select(F.col("tid").alias("pid"), (F.col("tx") / 100 + 5).alias("px"), (F.col("ty") / 100 + 3).alias("py"))
    return network.connect(p, i.grid(spark, d).withColumnRenamed("id", "sid"), 4.0).select("pid", F.bround("dist", 6).alias("dist"))


@query(i.walks_sql() + f" SELECT DISTINCT a.site AS source, b.site AS site FROM d5 JOIN {_SITES} a ON a.vertex = d5.source JOIN {_SITES} b ON b.vertex = d5.id WHERE dist <= 40")
def entry_coverage(spark, d):
    return network.entry_coverage(i.road_graph(spark, d), _sites(spark, d).select("site", "vertex"), 40.0)


@query(_DUAL + " SELECT v, u, round_even(((v % 10) + (u % 10)) / 2.0, 6) AS w_custom FROM m GROUP BY v, u")
def dual_custom_weights(spark, d):
    scores = i.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 10).cast("double").alias("score"))
    return graph.custom_weights(dual_graph_edges(spark, d), scores).select("v", "u", "w_custom")


@query(f"WITH {i.ROADS_WITH} SELECT src AS id, dst AS neighbour FROM {i.ROADS} WHERE src <> 3 AND dst <> 3")
def graph_edit(spark, d):
    e = i.road_graph(spark, d).where("src < dst")
    return graph.neighbours(graph.remove_vertices(e, spark.createDataFrame([(3,)], "id long")))


_TRI = f"(SELECT id, x AS cx, y AS cy, abs(z) AS area FROM {i.POINTS})"


@query(f"SELECT t.tid AS vid, round_even(coalesce(sum(area), 0), 3) AS total FROM {i.TARGETS} t LEFT JOIN {_TRI} p ON sqrt((tx - cx) * (tx - cx) + (ty - cy) * (ty - cy)) < 150 GROUP BY t.tid")
def area_in_reach(spark, d):
    v = i.targets(spark, d).select(F.col("tid").alias("lid"), F.col("tx").alias("lx"), F.col("ty").alias("ly"))
    return spatial.radius_sum(v, _sides(spark, d)[1], 150.0, "area").select(F.col("lid").alias("vid"), F.bround("total", 3).alias("total"))


@query(_seen_sql(6.0) + ", r AS (SELECT vid % 5 AS road_id, coalesce(sum(area), 0) AS visible FROM v LEFT JOIN seen USING (vid) GROUP BY 1) SELECT road_id, round_even(visible, 6) AS visible, CASE WHEN visible = 0 THEN 999999::DOUBLE ELSE round_even(1 / visible, 6) END AS score FROM r")
def road_views(spark, d):
    v, w = _scene(spark, d)
    seen = visibility.exposure_3d(v, w.select("tri", "p", "q", "r"), 6.0)
    out = visibility.road_views(seen, v.select("vid", (F.col("vid") % 5).alias("road_id")))
    return out.select("road_id", F.bround("visible", 6).alias("visible"), F.bround("score", 6).alias("score"))


@query()
def junction_shares(spark, d):
    """The part of a square site nearest to each of its junctions."""
    j = i.targets(spark, d).select((F.col("tid") % 5).alias("site"), "tid", (F.col("tx") % 100 + 100).alias("x"), (F.col("ty") % 90 + 100).alias("y"))
    return network.junction_areas(j, [(0.0, 0.0), (200.0, 0.0), (200.0, 200.0), (0.0, 200.0)]).select("site", "tid", F.bround("area", 3).alias("area"))


from polisgrid.plans import queries_mesh, queries_more, queries_shapes  # noqa: E402, F401  register their queries, too
