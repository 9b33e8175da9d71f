"""The domain's tables derived from the driver's tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    """id, x, y, z."""
    at = lambda k: F.bround(F.get("embedding", F.lit(k)).cast("double") * 1000, 3)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


POINTS = """(SELECT vec_id AS id, round_even(CAST(embedding[1] AS DOUBLE) * 1000, 3) AS x,
 round_even(CAST(embedding[2] AS DOUBLE) * 1000, 3) AS y, round_even(CAST(embedding[3] AS DOUBLE) * 1000, 3) AS z FROM embeddings)"""


def targets(spark: SparkSession, d: str) -> DataFrame:
    """tid, tx, ty: 25 facilities."""
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(k.cast("long").alias("tid"), (k * 40 - 500).cast("double").alias("tx"), ((k * 7) % 25 * 40 - 500).cast("double").alias("ty"))


TARGETS = "(SELECT CAST(n_nationkey AS BIGINT) AS tid, CAST(n_nationkey * 40 - 500 AS DOUBLE) AS tx, CAST((n_nationkey * 7) % 25 * 40 - 500 AS DOUBLE) AS ty FROM nation)"


def tracks(spark: SparkSession, d: str) -> DataFrame:
    """user_id, seq, x, y: each user's events as a polyline."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", F.row_number().over(w).alias("seq"), F.col("value").alias("x"))
    return e.select("user_id", "seq", "x", (F.col("seq") * 5 + F.col("user_id") % 7).cast("double").alias("y"))


TRACKS = """(SELECT user_id, seq, x, CAST(seq * 5 + user_id % 7 AS DOUBLE) AS y FROM (SELECT user_id, value AS x,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events))"""
SEGMENTS = f"""(SELECT * FROM (SELECT user_id, seq, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by
 FROM {TRACKS} WINDOW w AS (PARTITION BY user_id ORDER BY seq)) WHERE bx IS NOT NULL)"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    """user_id, seq, ax, ay, bx, by."""
    from polisgrid.operators.spatial import adjacent_pairs

    return adjacent_pairs(tracks(spark, d), "user_id", ["seq"])


def grid(spark: SparkSession, d: str) -> DataFrame:
    """id, ax, ay, bx, by: a segment for each supplier, between grid places."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, d, "supplier").select(k.alias("id"), (k % 10).cast("double").alias("ax"), (n % 6).cast("double").alias("ay"), ((k * 3 + n) % 10).cast("double").alias("bx"), ((n + 1 + k % 2) % 6).cast("double").alias("by"))


GRID = """(SELECT s_suppkey AS id, CAST(s_suppkey % 10 AS DOUBLE) AS ax, CAST(s_nationkey % 6 AS DOUBLE) AS ay,
 CAST((s_suppkey * 3 + s_nationkey) % 10 AS DOUBLE) AS bx, CAST((s_nationkey + 1 + s_suppkey % 2) % 6 AS DOUBLE) AS by FROM supplier)"""

#: What the driver's codes stand for.
USES = {"ECONOMY": "R", "SMALL": "C", "MEDIUM": "GIC", "PROMO": "M", "STANDARD": "W", "LARGE": "C"}
LAND = {"HOUSEHOLD": "R", "MACHINERY": "M", "FURNITURE": "C", "BUILDING": "GIC", "AUTOMOBILE": "W"}


def coded(column: Column, codes: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for k, v in codes.items():
        out = F.when(column == k, F.lit(v)).otherwise(out)
    return out


def coded_sql(column: str, codes: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.items()) + f" ELSE '{other}' END"


#: function, energy, water and waste rates (low, high) by square metre or by person: sample values of our own.
RATES = (("R", 0.02, 0.05, 2.0, 3.5, 0.8, 1.2), ("C", 0.06, 0.12, 5.0, 8.0, 1.5, 2.5), ("GIC", 0.04, 0.09, 3.0, 6.0, 0.5, 1.0), ("M", 0.05, 0.2, 4.0, 9.0, 0.6, 1.4), ("W", 0.01, 0.03, 1.0, 2.0, 0.2, 0.4))
#: type, closed range of floors, square metres a person.
BANDS = ((0, 1, 6, 45), (1, 4, 12, 40), (2, 10, 25, 36), (3, 26, 40, 32), (4, 41, 45, 30))


def rates(spark: SparkSession, k: int) -> DataFrame:
    return spark.createDataFrame([(r[0], r[1 + 2 * k], r[2 + 2 * k]) for r in RATES], "function string, lo_rate double, hi_rate double")


def rates_sql(k: int) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join(f"('{r[0]}', CAST({r[1 + 2 * k]} AS DOUBLE), CAST({r[2 + 2 * k]} AS DOUBLE))" for r in RATES) + ") v(function, lo_rate, hi_rate))"


def bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(b) for b in BANDS], "type int, floor_lo int, floor_hi int, per_person int")


def building_parts(spark: SparkSession, d: str) -> DataFrame:
    """building (order), part, function, amount: floor area of each part."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    both = line.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").join(part.select("p_partkey", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return both.select(F.col("l_orderkey").alias("building"), F.col("l_linenumber").alias("part"), coded(F.col("p_type"), USES, "R").alias("function"), (F.col("l_quantity") * F.col("p_size") * 2.5).alias("amount"))


PARTS = f"""(SELECT l_orderkey AS building, l_linenumber AS part, {coded_sql("p_type", USES, "R")} AS function,
 l_quantity * p_size * CAST(2.5 AS DOUBLE) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """block_id, cluster_id, landuse, area, remain, acc."""
    c = table(spark, d, "customer")
    area = F.abs("c_acctbal") + 1
    return c.select(F.col("c_custkey").alias("block_id"), F.col("c_nationkey").cast("long").alias("cluster_id"), coded(F.col("c_mktsegment"), LAND, "R").alias("landuse"), area.alias("area"), (area * (F.col("c_custkey") % 5) * 0.25).alias("remain"), (F.col("c_custkey") % 97).cast("double").alias("acc"))


BLOCKS = f"""(SELECT c_custkey AS block_id, CAST(c_nationkey AS BIGINT) AS cluster_id, {coded_sql("c_mktsegment", LAND, "R")} AS landuse,
 abs(c_acctbal) + 1 AS area, (abs(c_acctbal) + 1) * (c_custkey % 5) * CAST(0.25 AS DOUBLE) AS remain, CAST(c_custkey % 97 AS DOUBLE) AS acc FROM customer)"""


def road_graph(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, w in both directions: nations that trade; w is the mean quantity."""
    line, orders, customer, supplier = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "supplier"))
    flow = line.select("l_orderkey", "l_suppkey", "l_quantity").join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    flow = flow.join(orders.select("o_orderkey", "o_custkey").join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    pair = flow.select(F.least("c_nationkey", "s_nationkey").cast("long").alias("a"), F.greatest("c_nationkey", "s_nationkey").cast("long").alias("b"), "l_quantity").where("a != b")
    one = pair.groupBy("a", "b").agg(F.bround(F.avg("l_quantity"), 6).alias("w"))
    return one.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(one.select("b", "a", "w"))


ROADS = """(SELECT a AS src, b AS dst, w FROM pair UNION ALL SELECT b, a, w FROM pair)"""
ROADS_WITH = """pair AS MATERIALIZED (SELECT a, b, round_even(avg(q), 6) AS w FROM (SELECT CAST(least(c_nationkey, s_nationkey) AS BIGINT) AS a,
 CAST(greatest(c_nationkey, s_nationkey) AS BIGINT) AS b, l_quantity AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
 JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) WHERE a <> b GROUP BY a, b)"""


def walks_sql(rounds: int = 5, weight: str = "w") -> str:
    """CTEs d0..dn with least distances over up to 2 ** n edges, and zero for a vertex to itself."""
    out = [ROADS_WITH, f"e AS MATERIALIZED (SELECT src, dst, CAST({weight} AS DOUBLE) AS w FROM {ROADS})", "d0 AS MATERIALIZED (SELECT src AS source, dst AS id, w AS dist FROM e UNION ALL SELECT DISTINCT src, src, CAST(0 AS DOUBLE) FROM e)"]
    for k in range(rounds):
        out.append(f"d{k + 1} AS MATERIALIZED (SELECT a.source, b.id, min(round_even(a.dist + b.dist, 6)) AS dist FROM d{k} a JOIN d{k} b ON a.id = b.source GROUP BY a.source, b.id)")
    return "WITH " + ", ".join(out)
