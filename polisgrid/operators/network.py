"""Facility coverage, distance matrices and water networks over road and pipe graphs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polisgrid.functions.geom import point_to_segment
from polisgrid.operators.graph import path_to, shortest_paths
from polisgrid.operators.planning import power_regression
from polisgrid.operators.spatial import dealt
from polisgrid.plans.rounds import Stored


def coverage(edges: DataFrame, sites: DataFrame, sources: DataFrame, radius: float) -> DataFrame:
    """source, site of the sites (site, vertex) whose vertex is within radius of the sources' vertices (id)."""
    reach = shortest_paths(edges, sources, radius)
    return reach.join(sites, reach["id"] == sites["vertex"]).select("source", "site").distinct()


def _entered(entries: DataFrame) -> DataFrame:
    """site, vertex, each once, and many: whether the site has several."""
    some = entries.where("site is not null and vertex is not null").select("site", "vertex").distinct()
    return some.join(some.groupBy("site").agg((F.count("*") > 1).alias("many")), "site")


def _between_entries(reach: DataFrame, entries: DataFrame, on: str) -> DataFrame:
    """i, j, dist of the pairs of sites that on lets through, by what is reached (source, id, dist) from entry to entry. Of two
    sites with an entry each there is one row; where one of them has several, theirs are put together."""
    e = _entered(entries)
    a = e.select(F.col("site").alias("i"), F.col("vertex").alias("source"), F.col("many").alias("mi"))
    b = e.select(F.col("site").alias("j"), F.col("vertex").alias("id"), F.col("many").alias("mj"))
    pairs = lambda x, y: dealt(reach.join(x, "source"), "i").join(y, "id").where(on).select("i", "j", "dist")
    several = pairs(a.where("mi"), b).union(pairs(a.where("not mi"), b.where("mj")))
    return pairs(a.where("not mi"), b.where("not mj")).union(several.groupBy("i", "j").agg(F.min("dist").alias("dist")))


def entry_coverage(edges: DataFrame, entries: DataFrame, radius: float, compensate: bool = True) -> DataFrame:
    """source, site: both sides by their entries (site, vertex). Without compensate the first step to an entry counts 1."""
    reach = shortest_paths(edges, entries.select(F.col("vertex").alias("id")).distinct(), radius if compensate else radius - 1)
    found = _between_entries(reach, entries, "true")
    return found.select(F.col("i").alias("source"), F.col("j").alias("site"))


def coverage_ratio(covered: DataFrame, areas: DataFrame) -> DataFrame:
    """source, ratio: covered area over all area (site, area)."""
    total = areas.agg(F.sum("area").alias("all"))
    return covered.join(areas, "site").groupBy("source").agg(F.sum("area").alias("area")).join(F.broadcast(total)).select("source", F.try_divide("area", "all").alias("ratio"))


def union_ratio(covered: DataFrame, areas: DataFrame) -> DataFrame:
    """ratio: the area of all sites that some source covers over all area; one row."""
    total = areas.agg(F.sum("area").alias("all"))
    own = covered.select("site").distinct().join(areas, "site").agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"))
    return own.join(total).select(F.coalesce(F.try_divide("area", "all"), F.lit(0.0)).alias("ratio"))


def connect_by_middles(sites: DataFrame, needles: DataFrame, roads: DataFrame, cell: float) -> DataFrame:
    """site, road, x, y: connections from sites (site, cx, cy) to the roads (road, ax, ay, bx, by) whose middles are nearest to
    the middles of the site's box (needles: site, k, x, y). A connection goes from the centre to the nearest place of the
    road; where that is an end of the road there is none, so a site can stay without."""
    from polisgrid.operators.spatial import nearest

    middle = roads.select(F.col("road").alias("rid"), ((F.col("ax") + F.col("bx")) / 2).alias("rx"), ((F.col("ay") + F.col("by")) / 2).alias("ry"))
    q = needles.select((F.col("site") * 4 + F.col("k")).alias("lid"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    chosen = nearest(q, middle, 1, cell).select(F.floor(F.col("lid") / 4).cast("long").alias("site"), F.col("rid").alias("road")).distinct()
    both = chosen.join(sites, "site").join(roads, "road")
    c = F.col
    x, y, _ = point_to_segment(c("cx"), c("cy"), c("ax"), c("ay"), c("bx"), c("by"))
    dx, dy = c("bx") - c("ax"), c("by") - c("ay")
    t = F.try_divide((c("cx") - c("ax")) * dx + (c("cy") - c("ay")) * dy, dx * dx + dy * dy)
    return both.where((t > 0) & (t < 1)).select("site", "road", x.alias("x"), y.alias("y"))


def distance_matrix(edges: DataFrame, entries: DataFrame, limit: float = float("inf"), places: int | None = None) -> DataFrame:
    """i < j, dist: least network distance between entries (site, vertex) of two sites, rounded if places are given; no row if
    not connected."""
    reach = shortest_paths(edges, entries.select(F.col("vertex").alias("id")).distinct(), limit)
    if places is not None:
        reach = reach.withColumn("dist", F.bround("dist", places))
    return _between_entries(reach, entries, "i < j")


def connect(points: DataFrame, segments: DataFrame, cell: float) -> DataFrame:
    """pid, sid, x, y, dist: the nearest place on a segment (sid, ax, ay, bx, by) within `cell` of each point (pid, px, py);
    ties go to the smallest sid. Segments are keyed by all cells their box, widened by `cell`, touches."""
    c = F.col
    f = lambda v: F.floor(v / F.lit(float(cell))).cast("long")
    s = segments.withColumn("_i", F.explode(F.sequence(f(F.least("ax", "bx")) - 1, f(F.greatest("ax", "bx")) + 1)))
    s = s.withColumn("_j", F.explode(F.sequence(f(F.least("ay", "by")) - 1, f(F.greatest("ay", "by")) + 1)))
    both = points.withColumn("_i", f(c("px"))).withColumn("_j", f(c("py"))).join(s, ["_i", "_j"])
    x, y, d = point_to_segment(c("px"), c("py"), c("ax"), c("ay"), c("bx"), c("by"))
    near = both.select("pid", F.struct(d.alias("dist"), c("sid").alias("sid"), x.alias("x"), y.alias("y")).alias("m")).where(c("m.dist") <= cell)
    return near.groupBy("pid").agg(F.min("m").alias("m")).select("pid", "m.sid", "m.x", "m.y", "m.dist")


def nearest_source(paths: DataFrame) -> DataFrame:
    """id, source, dist: the nearest source of each vertex (ties: smallest source)."""
    return paths.groupBy("id").agg(F.min(F.struct("dist", "source")).alias("m")).select("id", "m.source", "m.dist")


def water_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """junction, source, pipes: of each vertex that some source reaches, the edges (src, dst as structs a < b) on the path from
    the nearest source, ties going to the smallest one."""
    reached = shortest_paths(edges, sources)
    near = nearest_source(reached)
    own = reached.join(near.select("id", "source"), ["id", "source"]).select("source", "id", "dist", "prev", "hops")
    # The path of the nearest source runs through vertices that are nearest to it, too, so their own rows make it up.
    steps = path_to(own, own.select("id").distinct())
    back = own.select("source", "id", "prev").where("prev is not null")
    pipes_ = steps.join(back, ["source", "id"]).select("source", F.col("target").alias("junction"), F.struct(F.least("id", "prev").alias("a"), F.greatest("id", "prev").alias("b")).alias("pipe"))
    return pipes_.groupBy("junction", "source").agg(F.collect_set("pipe").alias("pipes"))


def pipe_flow(paths: DataFrame, demand: DataFrame) -> DataFrame:
    """pipe, flow: the sum of the demands (junction, demand) of all junctions whose path (junction, pipes) uses it."""
    return paths.join(demand, "junction").select(F.explode("pipes").alias("pipe"), "demand").groupBy("pipe").agg(F.sum("demand").alias("flow"))


#: Fixed values of the economic diameter formula.
M, E = 5.33, 1 / 3.0
PRICES_HELD = 1000


def flow_thresholds(costs: DataFrame) -> tuple[list[float], list[float]]:
    """Ascending diameters and the flows (litres) at which the next diameter pays, from diameter, cost: a price list; more
    than PRICES_HELD rows raise."""
    rows = costs.orderBy("diameter").limit(PRICES_HELD + 1).collect()
    if len(rows) > PRICES_HELD:
        raise ValueError(f"a price list has at most {PRICES_HELD} rows")
    fit = power_regression(costs.select(F.col("diameter").alias("x"), F.col("cost").alias("y")), []).first()
    if fit["r2"] is None or fit["r2"] < 0.5 or not fit["a"] or not fit["b"]:
        raise ValueError("costs do not follow a power of the diameter")
    d, b = [float(r["diameter"]) for r in rows], fit["b"]
    steps = [(M / b) ** E * ((v**b - u**b) / (u**-M - v**-M)) ** E * 1000 for u, v in zip(d, d[1:], strict=False)]
    return d, sorted(steps)


def diameter(flow: Column, diameters: list[float], thresholds: list[float]) -> Column:
    """The diameter whose number is the count of thresholds under the flow."""
    steps = F.array(*[F.lit(float(t)) for t in thresholds]) if thresholds else F.array().cast("array<double>")
    return F.element_at(F.array(*[F.lit(x) for x in diameters]), F.size(F.filter(steps, lambda t: t < flow)) + 1)


def ring_half_plane(ring: list[tuple[float, float]], a: tuple[float, float], b: tuple[float, float]) -> list[tuple[float, float]]:
    """The part of a convex or simple ring (open list) that is nearer to a than to b."""
    mx, my, nx, ny = (a[0] + b[0]) / 2, (a[1] + b[1]) / 2, b[0] - a[0], b[1] - a[1]
    side = [(x - mx) * nx + (y - my) * ny for x, y in ring]
    out = []
    for k, (p, s) in enumerate(zip(ring, side, strict=True)):
        q, t = ring[(k + 1) % len(ring)], side[(k + 1) % len(ring)]
        if s <= 0:
            out.append(p)
        if (s < 0 < t) or (t < 0 < s):
            u = s / (s - t)
            out.append((p[0] + u * (q[0] - p[0]), p[1] + u * (q[1] - p[1])))
    return out


def area_of(ring: list[tuple[float, float]]) -> float:
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True))) / 2 if len(ring) > 2 else 0.0


def voronoi_shares(ring: list[tuple[float, float]], centres: list[tuple[float, float]]) -> list[float]:
    """The area of the ring that is nearest to each centre, by half-plane cuts."""
    out = []
    for k, c in enumerate(centres):
        part = ring
        for j, other in enumerate(centres):
            if j != k and part and other != c:
                part = ring_half_plane(part, c, other)
        out.append(area_of(part) if math.isfinite(sum(c)) else 0.0)
    return out


def junction_demand(sites: DataFrame, junctions: DataFrame) -> DataFrame:
    """tid, demand: a site's demand (site, shell: an open simple ring, demand) dealt over its junctions (site, tid, x, y) by the
    part of its area that is nearest to each; a junction adds up what it gets from all sites."""

    def run(key, own, ends):
        if not len(own) or not len(ends):
            return pd.DataFrame({"tid": [], "demand": []})
        ends = ends.sort_values("tid")
        ring = [(p["x"], p["y"]) for p in own["shell"].iloc[0]]
        shares = voronoi_shares(ring, list(zip(ends["x"], ends["y"], strict=True)))
        whole = sum(shares)
        return pd.DataFrame({"tid": ends["tid"], "demand": [own["demand"].iloc[0] * s / whole if whole else 0.0 for s in shares]})

    other = junctions.select(F.col("site").alias("_site"), "tid", "x", "y")
    return sites.groupBy("site").cogroup(other.groupBy("_site")).applyInPandas(run, "tid long, demand double").groupBy("tid").agg(F.sum("demand").alias("demand"))


def connect_sites(sites: DataFrame, roads: DataFrame, cell: float) -> DataFrame:
    """site, k, x, y, rx, ry, road: connections of sites (site, shell: a closed ring) to the nearest places of roads (road, ax, ay,
    bx, by) within `cell`, from the middles of the four edges of the site's box. Those that cross another site's outline go;
    a site that keeps none gets one from its centre (k = 4), however far the nearest road is: the reach grows fourfold a
    round for those that are left, until all are connected or all roads are in reach. Without roads there is none."""
    from polisgrid.operators.design import box_edges, orientation
    from polisgrid.operators.spatial import crossings

    c = F.col
    turned = sites.withColumn("_turn", orientation(c("shell"))).withColumn("_m", box_edges(c("shell"), c("_turn")))
    needles = turned.select("site", F.posexplode("_m").alias("k", "p")).select("site", "k", c("p.x").alias("x"), c("p.y").alias("y"))
    n = F.size("shell") - 1
    mean = lambda k: F.aggregate(F.slice("shell", F.lit(1), n), F.lit(0.0), lambda s, p: s + p[k]) / n
    centres = sites.select("site", F.lit(4).alias("k"), mean("x").alias("x"), mean("y").alias("y"))
    every = needles.unionByName(centres)
    near = connect(every.select((c("site") * 5 + c("k")).alias("pid"), c("x").alias("px"), c("y").alias("py")), roads.withColumnRenamed("road", "sid"), cell)
    linked = every.withColumn("pid", c("site") * 5 + c("k")).join(near.select("pid", c("sid").alias("road"), c("x").alias("rx"), c("y").alias("ry")), "pid")
    edges = sites.select("site", F.posexplode(F.zip_with(F.slice("shell", F.lit(1), n), F.slice("shell", F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("k", "e"))
    l = linked.select(c("pid").alias("lid"), c("x").alias("lax"), c("y").alias("lay"), c("rx").alias("lbx"), c("ry").alias("lby"))
    r = edges.select(F.struct("site", "k").alias("rid"), c("e.a.x").alias("rax"), c("e.a.y").alias("ray"), c("e.b.x").alias("rbx"), c("e.b.y").alias("rby"))
    bad = crossings(l, r, cell).where(F.floor(c("lid") / 5) != c("rid.site")).select(c("lid").alias("pid")).distinct()
    first = Stored(linked.where("k < 4").join(bad, "pid", "left_anti").select("site", "k", "x", "y", "rx", "ry", "road"))
    todo, found = Stored(centres.join(first.df.select("site"), "site", "left_anti")), [first]
    # No place is farther from a road than this.
    places = todo.df.agg(F.max(F.abs("x")), F.max(F.abs("y"))).first()
    ends = roads.agg(F.max(F.greatest(F.abs("ax"), F.abs("bx"))), F.max(F.greatest(F.abs("ay"), F.abs("by")))).first()
    reach, most = float(cell), 0.0 if places[0] is None or ends[0] is None else sum(places) + sum(ends) + cell
    while most and not todo.df.isEmpty():
        near = connect(todo.df.select(c("site").alias("pid"), c("x").alias("px"), c("y").alias("py")), roads.withColumnRenamed("road", "sid"), reach)
        some = Stored(todo.df.join(near.select(c("pid").alias("site"), c("sid").alias("road"), c("x").alias("rx"), c("y").alias("ry")), "site").select("site", "k", "x", "y", "rx", "ry", "road"))
        found.append(some)
        rest = Stored(todo.df.join(some.df.select("site"), "site", "left_anti"))
        todo.drop()
        todo = rest
        if reach > most:
            break
        reach *= 4
    todo.drop()
    out = found[0].df
    for part in found[1:]:
        out = out.unionByName(part.df)
    return out


def junction_areas(junctions: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """site, tid, area: of each site's ring the part nearest to each of its junctions (site, tid, x, y)."""

    def run(key, pdf):
        pdf = pdf.sort_values("tid")
        shares = voronoi_shares(ring, list(zip(pdf["x"], pdf["y"], strict=True)))
        return pdf.assign(area=shares)[["site", "tid", "area"]]

    return junctions.groupBy("site").applyInPandas(run, "site long, tid long, area double")
