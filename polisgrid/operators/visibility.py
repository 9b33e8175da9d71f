"""Views in the plane and in space: rays, exposure of triangles, decay, measures and colours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polisgrid.functions.geom import length2, ray_hit
from polisgrid.functions.rays import Tree
from polisgrid.operators.spatial import stand_ins


def exposure_2d(viewpoints: DataFrame, outlines: DataFrame, rays: int, radius: float) -> DataFrame:
    """outline, hits: rays every round(360 / rays) degrees from each viewpoint (vid, x, y) that meet the outline first
    within radius. outlines: oid, ax, ay, bx, by (a row an edge). Joined on grid cells of the radius."""
    step = round(360 / rays)
    f = lambda v: F.floor(v / F.lit(float(radius))).cast("long")
    o = outlines.withColumn("_i", F.explode(F.sequence(f(F.least("ax", "bx")) - 1, f(F.greatest("ax", "bx")) + 1)))
    o = o.withColumn("_j", F.explode(F.sequence(f(F.least("ay", "by")) - 1, f(F.greatest("ay", "by")) + 1)))
    v = viewpoints.withColumn("_i", f(F.col("x"))).withColumn("_j", f(F.col("y")))
    both = v.join(o, ["_i", "_j"]).withColumn("deg", F.explode(F.sequence(F.lit(0), F.lit(359), F.lit(step))))
    rad = F.radians(F.col("deg").cast("double"))
    t = ray_hit(F.col("x"), F.col("y"), F.cos(rad), F.sin(rad), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    first = both.withColumn("t", F.bround(t, 6)).where(F.col("t") <= radius).groupBy("vid", "deg").agg(F.min(F.struct("t", "oid")).alias("m"))
    return first.groupBy(F.col("m.oid").alias("outline")).agg(F.count("*").alias("hits"))


def exposure_rate(hits: DataFrame, outlines: DataFrame) -> DataFrame:
    """outline, hits, rate: hits of each outline by its length, to four places. An outline that comes twice with the same
    edges raises."""
    a, b = (F.struct(F.col(f"{k}x").alias("x"), F.col(f"{k}y").alias("y")) for k in "ab")
    shape = outlines.select("oid", F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).alias("e"), length2(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")).alias("l"))
    whole = shape.groupBy("oid").agg(F.array_sort(F.collect_list("e")).alias("s"), F.sum("l").alias("length"))
    twice = whole.groupBy("s").agg(F.count("*").alias("n"), F.min("oid").alias("oid")).where("n > 1").select("oid").limit(1).collect()
    if twice:
        raise ValueError(f"outline {twice[0][0]} comes twice")
    out = whole.join(hits.withColumnRenamed("outline", "oid"), "oid", "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long"))
    return out.select(F.col("oid").alias("outline"), "hits", F.bround(F.try_divide(F.col("hits"), F.col("length")), 4).alias("rate"))


def walls(outlines: DataFrame) -> DataFrame:
    """Two triangles of each wall: oid, tri, p, q, r (points) from oid, seq, ax, ay, bx, by, height."""
    pt = lambda x, y, z: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), z.cast("double").alias("z"))
    lo, hi = F.lit(0.0), F.col("height")
    one = F.struct((F.col("seq") * 2).alias("tri"), pt("ax", "ay", lo).alias("p"), pt("bx", "by", lo).alias("q"), pt("bx", "by", hi).alias("r"))
    two = F.struct((F.col("seq") * 2 + 1).alias("tri"), pt("ax", "ay", lo).alias("p"), pt("bx", "by", hi).alias("q"), pt("ax", "ay", hi).alias("r"))
    return outlines.select("oid", F.explode(F.array(one, two)).alias("t")).select("oid", "t.tri", "t.p", "t.q", "t.r")


def ear_clip(ring: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Triangles (numbers of the ring's points) of a simple open ring in either direction, counter-clockwise."""
    n = len(ring)
    area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True))
    left = list(range(n)) if area > 0 else list(range(n - 1, -1, -1))
    cross = lambda a, b, c: (ring[b][0] - ring[a][0]) * (ring[c][1] - ring[a][1]) - (ring[b][1] - ring[a][1]) * (ring[c][0] - ring[a][0])
    out = []
    while len(left) > 3:
        for k in range(len(left)):
            a, b, c = left[k - 1], left[k], left[(k + 1) % len(left)]
            turn = cross(a, b, c)
            if turn < 0:
                continue
            if turn > 0 and any(cross(a, b, p) >= 0 and cross(b, c, p) >= 0 and cross(c, a, p) >= 0 for p in left if ring[p] not in (ring[a], ring[b], ring[c])):
                continue
            if turn > 0:
                out.append((a, b, c))
            del left[k]
            break
        else:
            raise ValueError("the ring is not simple")
    if len(left) == 3 and cross(*left) > 0:
        out.append(tuple(left))
    return out


def roofs(outlines: DataFrame) -> DataFrame:
    """oid, tri, p, q, r: the roof's triangles of outlines (oid, shell: an open ring of x, y; height), by ear clipping."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                ring = [(p["x"], p["y"]) for p in r.shell]
                pts = [{"x": x, "y": y, "z": float(r.height)} for x, y in ring]
                out += [(r.oid, k, *(pts[v] for v in t)) for k, t in enumerate(ear_clip(ring))]
            yield pd.DataFrame(out, columns=["oid", "tri", "p", "q", "r"])

    point = "struct<x:double,y:double,z:double>"
    return outlines.select("oid", "shell", "height").mapInPandas(run, f"oid long, tri long, p {point}, q {point}, r {point}")


def building_mesh(outlines: DataFrame) -> DataFrame:
    """oid, side ('wall' or 'roof'), p, q, r of extruded outlines (oid, shell: an open ring; height)."""
    n = F.size("shell")
    edges = outlines.select("oid", "height", "shell", F.posexplode("shell").alias("k", "a"))
    b = F.element_at("shell", (F.col("k") + 1) % n + 1)
    flat = edges.select("oid", F.col("k").cast("long").alias("seq"), F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), b["x"].alias("bx"), b["y"].alias("by"), "height")
    return walls(flat).select("oid", F.lit("wall").alias("side"), "p", "q", "r").unionByName(roofs(outlines).select("oid", F.lit("roof").alias("side"), "p", "q", "r"))


# --- half-edges --------------------------------------------------------------------------------------------------


def half_edges(faces: DataFrame) -> DataFrame:
    """mesh, face, k, a, b, twin of meshes given by faces (mesh, face, v: vertices in order); twin is the face that has the
    edge the other way round, null at a border."""
    n = F.size("v")
    one = faces.select("mesh", "face", "v", F.posexplode("v").alias("k", "a")).select("mesh", "face", "k", "a", F.element_at("v", (F.col("k") + 1) % n + 1).alias("b"))
    other = one.groupBy("mesh", F.col("b").alias("a"), F.col("a").alias("b")).agg(F.min("face").alias("twin"))
    return one.join(other, ["mesh", "a", "b"], "left").select("mesh", "face", "k", "a", "b", "twin")


def mesh_measures(faces: DataFrame, places: DataFrame) -> DataFrame:
    """mesh, faces, edges, vertices, naked (edges with one face), closed, volume (of closed meshes whose faces look outwards).
    places: mesh, vertex, x, y, z."""
    h = half_edges(faces)
    sides = h.groupBy("mesh").agg(F.count("*").alias("half"), F.count_if(F.col("twin").isNull()).alias("naked"), F.count_distinct("a").alias("vertices"), F.count_distinct("face").alias("faces"))
    p = places.select("mesh", "vertex", F.struct("x", "y", "z").alias("p"))
    corners = faces.select("mesh", "face", F.posexplode("v").alias("k", "vertex")).join(p, ["mesh", "vertex"])
    rings = corners.groupBy("mesh", "face").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("r"))
    fan = F.transform(F.sequence(F.lit(2), F.size("r") - 1), lambda k: F.struct(F.element_at("r", 1).alias("p"), F.element_at(F.col("r"), k).alias("q"), F.element_at(F.col("r"), k + 1).alias("s")))
    six = lambda t: t["p"]["x"] * (t["q"]["y"] * t["s"]["z"] - t["q"]["z"] * t["s"]["y"]) + t["p"]["y"] * (t["q"]["z"] * t["s"]["x"] - t["q"]["x"] * t["s"]["z"]) + t["p"]["z"] * (t["q"]["x"] * t["s"]["y"] - t["q"]["y"] * t["s"]["x"])
    volume = rings.select("mesh", (F.aggregate(F.transform(fan, six), F.lit(0.0), lambda s, v: s + v) / 6).alias("v")).groupBy("mesh").agg(F.sum("v").alias("volume"))
    out = sides.join(volume, "mesh")
    return out.select("mesh", "faces", ((F.col("half") + F.col("naked")) / 2).cast("long").alias("edges"), "vertices", "naked", (F.col("naked") == 0).alias("closed"), "volume")


def valence(faces: DataFrame) -> DataFrame:
    """mesh, vertex, valence: edges at each vertex."""
    h = half_edges(faces)
    ends = h.select("mesh", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return ends.select("mesh", F.explode(F.array("a", "b")).alias("vertex")).groupBy("mesh", "vertex").agg(F.count("*").alias("valence"))


def flip_edge(faces: DataFrame, edges: DataFrame) -> DataFrame:
    """Faces after the edges (mesh, a, b) between two triangles are turned to join their other corners. Edges of one call
    must not share a triangle."""
    h = half_edges(faces.where("size(v) = 3"))
    both = edges.join(h.select("mesh", "a", "b", F.col("face").alias("f"), F.col("twin").alias("g")), ["mesh", "a", "b"]).where("g is not null")
    corner = faces.select("mesh", F.col("face").alias("x"), "v")
    c = F.col
    both = both.join(corner.select("mesh", c("x").alias("f"), c("v").alias("vf")), ["mesh", "f"]).join(corner.select("mesh", c("x").alias("g"), c("v").alias("vg")), ["mesh", "g"])
    off = lambda v: F.filter(v, lambda x: (x != c("a")) & (x != c("b")))[0]
    p, q = off("vf"), off("vg")
    fresh = both.select("mesh", F.explode(F.array(F.struct(c("f").alias("face"), F.array(c("a"), q, p).alias("v")), F.struct(c("g").alias("face"), F.array(c("b"), p, q).alias("v")))).alias("n")).select("mesh", "n.face", c("n.v").alias("w"))
    return faces.join(fresh, ["mesh", "face"], "left").select("mesh", "face", F.coalesce("w", "v").alias("v"))


def triangle_area(p: Column, q: Column, r: Column) -> Column:
    u, v = [q[k] - p[k] for k in "xyz"], [r[k] - p[k] for k in "xyz"]
    cross = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    return F.sqrt(cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]) / 2


_PAIRS = 1 << 20  # rays times triangles whose temporaries are held at once


def first_hits(origins: np.ndarray, directions: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance to and number of the first triangle (n, 3, 3) that each ray meets; inf and -1 if none."""
    best, who = np.full(len(origins), np.inf), np.full(len(origins), -1)
    if not len(tri):
        return best, who
    e1, e2 = tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0]
    step = max(1, _PAIRS // len(tri))
    for at in range(0, len(origins), step):
        o, d = origins[at : at + step], directions[at : at + step]
        h = np.cross(d[:, None], e2[None])
        det = (h * e1).sum(2)
        safe = np.where(np.abs(det) > 1e-12, det, np.inf)
        s = o[:, None] - tri[None, :, 0]
        u = (s * h).sum(2) / safe
        q = np.cross(s, e1[None])
        v = (d[:, None] * q).sum(2) / safe
        t = (e2 * q).sum(2) / safe
        t = np.where(np.isfinite(safe) & (u >= -1e-9) & (v >= -1e-9) & (u + v <= 1 + 1e-9) & (t > 1e-9), t, np.inf)
        who[at : at + step] = np.where(np.isfinite(t.min(1)), t.argmin(1), -1)
        best[at : at + step] = t.min(1)
    return best, who


_XYZ, _CORNERS = list("xyz"), [c + k for c in "pqr" for k in "xyz"]
#: Triangles of one block: beyond so many a cell's triangles are dealt in blocks, and hits on blocks are put together.
BLOCK = 16_384


def _once(triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The triangles without those in the same place as one of a smaller number, and each triangle's number with that of the
    one that is left (shape)."""
    one, members = stand_ins(triangles.select("tri", "p", "q", "r"), ["p", "q", "r"], "tri")
    return one, members.select("tri", "shape")


def _cells(triangles: DataFrame, reach: float) -> DataFrame:
    """tri and its corners' coordinates, for each cell (_i, _j) from which some part of it is within reach."""
    cell = lambda v: F.floor(v / F.lit(float(reach))).cast("long")
    flat = triangles.select("tri", *(F.col(f"{c}.{k}").cast("double").alias(c + k) for c in "pqr" for k in "xyz"))
    side = lambda f, k, d: cell(f(*(F.col(c + k) for c in "pqr")) + F.lit(d * float(reach)))
    t = flat.withColumn("_i", F.explode(F.sequence(side(F.least, "x", -1), side(F.greatest, "x", 1))))
    return t.withColumn("_j", F.explode(F.sequence(side(F.least, "y", -1), side(F.greatest, "y", 1))))


def _in_blocks(cells: DataFrame, block: int) -> DataFrame:
    """The triangles of each cell with _block and the number of its blocks."""
    sizes = cells.groupBy("_i", "_j").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("_blocks"))
    return cells.join(sizes, ["_i", "_j"]).withColumn("_block", F.pmod(F.xxhash64("tri"), F.col("_blocks")).cast("int"))


def _keyed(points: DataFrame, reach: float) -> DataFrame:
    cell = lambda k: F.floor(F.col(k) / F.lit(float(reach))).cast("long")
    return points.withColumns({"_i": cell("x"), "_j": cell("y")})


def _in_parts(rays: DataFrame, key: str, most: int) -> DataFrame:
    """Rays of each cell dealt in parts of about so many rows."""
    parts = rays.groupBy("_i", "_j").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("_parts"))
    return rays.join(parts, ["_i", "_j"]).withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int"))


def ray_hits(rays: DataFrame, triangles: DataFrame, reach: float, block: int = BLOCK, part: int = 16_384) -> DataFrame:
    """ray, dist, tri: the first triangle (tri, p, q, r) within reach that each ray (ray, x, y, z, dx, dy, dz: a unit
    direction) meets; rays that meet none have no row. Ties: smallest tri.

    Both are keyed by cells of the reach. A cell's rays are dealt in parts and its triangles in blocks, each with a tree of
    boxes; a ray's hits on the blocks are put together by their least distance. A task holds a part and a block.
    """
    own = ["_i", "_j", "_part", "_block"]
    t = _in_blocks(_cells(_once(triangles)[0], reach), block)
    r = _in_parts(_keyed(rays, reach), "ray", part)
    blocks, parts = t.select("_i", "_j", "_blocks").distinct(), r.select("_i", "_j", "_parts").distinct()
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    r = r.join(blocks, ["_i", "_j"]).withColumn("_block", spread("_blocks")).select("ray", *_XYZ, "dx", "dy", "dz", *own)
    t = t.join(parts, ["_i", "_j"]).withColumn("_part", spread("_parts")).select("tri", *_CORNERS, *own)

    def run(key, own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("tri")
        tree = Tree(held[_CORNERS].to_numpy().reshape(-1, 3, 3))
        dist, who = tree.first(own[_XYZ].to_numpy(), own[["dx", "dy", "dz"]].to_numpy(), reach)
        on = who >= 0
        return pd.DataFrame({"ray": own["ray"].to_numpy()[on], "dist": dist[on], "tri": held["tri"].to_numpy()[who[on]]})

    found = r.groupBy(*own).cogroup(t.groupBy(*own)).applyInPandas(run, "ray long, dist double, tri long")
    return found.groupBy("ray").agg(F.min(F.struct("dist", "tri")).alias("m")).select("ray", "m.dist", "m.tri")


def exposure_3d(viewpoints: DataFrame, triangles: DataFrame, reach: float, decay: float | None = None, block: int = BLOCK, part: int = 128) -> DataFrame:
    """vid, tri, dist, amount of each triangle that a viewpoint sees: it faces the viewpoint, its centre is nearer than
    reach, and the first hit of the ray to its centre is there (within 1e-4). amount is the area, or
    area * exp(-decay * distance) with distance 0 taken as 1.

    triangles: tri, p, q, r; viewpoints: vid, x, y, z. Both are keyed by grid cells of the reach: a triangle by all cells
    from which some part of it is within reach. A cell's viewpoints are dealt in parts and its triangles in blocks; each
    task holds a part, a block of triangles to look at, and a block, as a tree of boxes, of those that may stand before
    them. What is seen is seen past every block. Triangles in the same place are looked at once.
    """
    own = ["_i", "_j", "_part", "_block", "_other"]
    one, members = _once(triangles)
    t = _in_blocks(_cells(one, reach), block)
    v = _in_parts(_keyed(viewpoints.select("vid", *(F.col(c).cast("double").alias(c) for c in "xyz")), reach), "vid", part)
    blocks, parts = t.select("_i", "_j", "_blocks").distinct(), v.select("_i", "_j", "_parts").distinct()
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v = v.join(blocks, ["_i", "_j"]).withColumn("_block", each("_blocks")).withColumn("_other", each("_blocks")).select("vid", *_XYZ, *own)
    t = t.join(parts, ["_i", "_j"]).withColumn("_part", each("_parts"))
    # A block is looked at before each block, and stands before each: one copy where both are the same.
    seen = t.withColumn("_other", each("_blocks")).withColumn("_role", F.when(F.col("_other") == F.col("_block"), F.lit(2)).otherwise(F.lit(0)))
    before = t.withColumn("_at", each("_blocks")).where("_at != _block").withColumn("_other", F.col("_block")).withColumn("_block", F.col("_at")).withColumn("_role", F.lit(1))
    t = seen.select("tri", *_CORNERS, "_role", *own).union(before.select("tri", *_CORNERS, "_role", *own))

    def run(key, views: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("tri")
        role = held["_role"].to_numpy()
        corners = held[_CORNERS].to_numpy().reshape(-1, 3, 3)
        ids, tri, other = held["tri"].to_numpy()[role != 1], corners[role != 1], corners[role != 0]
        tree = Tree(other)
        centre = tri.mean(1)
        normal = np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0])
        area = np.linalg.norm(normal, axis=1) / 2
        out = []
        for vid, *at in views[["vid", "x", "y", "z"]].itertuples(index=False):
            o = np.array(at, float)
            way = centre - o
            dist = np.linalg.norm(way, axis=1)
            k = np.flatnonzero((dist < reach) & (dist > 0) & ((normal * -way).sum(1) > 0))
            if not len(k):
                continue
            first, _ = tree.first(np.repeat(o[None], len(k), 0), way[k] / dist[k][:, None], dist[k] + 1e-4)
            free = first >= dist[k] - 1e-4
            k, met = k[free], np.isfinite(first[free])
            amount = area[k] if decay is None else area[k] * np.exp(-decay * np.where(dist[k] == 0, 1, dist[k]))
            out.append(pd.DataFrame({"vid": vid, "tri": ids[k], "dist": dist[k], "amount": amount, "met": met}))
        return pd.concat(out) if out else pd.DataFrame({"vid": [], "tri": [], "dist": [], "amount": [], "met": []})

    found = v.groupBy(*own).cogroup(t.groupBy(*own)).applyInPandas(run, "vid long, tri long, dist double, amount double, met boolean")
    # A row comes from each block that doesn't stand before the triangle; it is seen if all do, and one is met there.
    by = found.groupBy("vid", "tri").agg(F.first("dist").alias("dist"), F.first("amount").alias("amount"), F.count("*").alias("n"), F.max("met").alias("met"))
    at = _keyed(viewpoints.select("vid", "x", "y"), reach).join(blocks, ["_i", "_j"]).groupBy("vid").agg(F.max("_blocks").alias("_blocks"))
    free = by.join(at, "vid").where((F.col("n") == F.col("_blocks")) & F.col("met")).withColumnRenamed("tri", "shape")
    return free.join(members, "shape").select("vid", "tri", "dist", "amount")


def decayed(area: Column, dist: Column, beta: float) -> Column:
    return area * F.exp(F.lit(-beta) * F.when(dist == 0, F.lit(1.0)).otherwise(dist))


def vertex_hits(hits: DataFrame, corners: DataFrame) -> DataFrame:
    """vertex, hits: one for each corner of each seen triangle. corners: tri, v0, v1, v2."""
    return hits.join(corners, "tri").select(F.explode(F.array("v0", "v1", "v2")).alias("vertex")).groupBy("vertex").agg(F.count("*").alias("hits"))


def view_ratios(seen: DataFrame, triangles: DataFrame, viewpoints: DataFrame, reach: float) -> DataFrame:
    """vid, visible, ratio (of the area of centres within reach in the plane), share (of all that is seen)."""
    from polisgrid.operators.spatial import radius_sum

    v = viewpoints.select(F.col("vid").alias("lid"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    t = triangles.select(F.col("tri").alias("rid"), F.col("cx").alias("rx"), F.col("cy").alias("ry"), "area")
    near = radius_sum(v, t, reach, "area").withColumnRenamed("lid", "vid")
    per = seen.groupBy("vid").agg(F.sum("amount").alias("visible"))
    whole = per.agg(F.sum("visible").alias("all"))
    out = near.join(per, "vid", "left").join(F.broadcast(whole)).withColumn("visible", F.coalesce("visible", F.lit(0.0)))
    return out.select("vid", "visible", F.try_divide("visible", "total").alias("ratio"), F.try_divide("visible", "all").alias("share"))


def ray_fan(viewpoints: DataFrame, horizontal: int, vertical: int) -> DataFrame:
    """vid, h, v, dx, dy, dz: unit directions over the sphere."""
    h = F.explode(F.sequence(F.lit(0), F.lit(horizontal - 1))).alias("h")
    fan = viewpoints.select("vid", h).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(vertical))))
    a, b = F.col("h") * F.lit(2 * math.pi / horizontal), F.col("v") * F.lit(math.pi / vertical) - F.lit(math.pi / 2)
    return fan.select("vid", "h", "v", (F.cos(a) * F.cos(b)).alias("dx"), (F.sin(a) * F.cos(b)).alias("dy"), F.sin(b).alias("dz"))


def fan_hits(viewpoints: DataFrame, triangles: DataFrame, horizontal: int, vertical: int, reach: float) -> DataFrame:
    """tri, hits: how many rays of the fans of all viewpoints (vid, x, y, z) meet each triangle first, within reach."""
    v = viewpoints.select("vid", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    fans = v.join(ray_fan(viewpoints.select("vid"), horizontal, vertical), "vid")
    number = (F.col("vid").cast("long") * (vertical + 1) + F.col("v")) * horizontal + F.col("h")
    hit = ray_hits(fans.select(number.alias("ray"), *_XYZ, "dx", "dy", "dz"), triangles, reach)
    return hit.groupBy("tri").agg(F.count("*").alias("hits"))


def sun_hours(points: DataFrame, suns: DataFrame, triangles: DataFrame, reach: float) -> DataFrame:
    """pid, hours: for how long the sun (time, hours, dx, dy, dz: the unit direction to it, and the hours it stands for) is seen
    from each point (pid, x, y, z). A ray goes from the point to each place of the sun above the horizon; no triangle (tri,
    p, q, r) may stand in its way within reach. Points in the same place are looked from once."""
    up = suns.where("dz > 0").groupBy("time").agg(*(F.min(c).alias(c) for c in ("hours", "dx", "dy", "dz")))
    n = up.count()
    if n > SUNS_HELD:
        raise ValueError(f"{n} places of the sun; {SUNS_HELD} at most are sent to every task")
    p = points.select("pid", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    places = F.array(*(F.struct(F.lit(k).alias("k"), *(F.lit(float(r[c])).alias(c) for c in ("hours", "dx", "dy", "dz"))) for k, r in enumerate(up.orderBy("time").collect())))
    if not n:
        return p.select("pid", F.lit(0.0).alias("hours"))
    one, members = stand_ins(p, [*_XYZ], "pid")
    rays = one.withColumn("s", F.explode(places)).select("pid", (F.col("pid").cast("long") * n + F.col("s.k")).alias("ray"), *_XYZ, "s.hours", "s.dx", "s.dy", "s.dz")
    hit = ray_hits(rays.select("ray", *_XYZ, "dx", "dy", "dz"), triangles, reach)
    lit = rays.join(hit.select("ray"), "ray", "left_anti").groupBy("pid").agg(F.sum("hours").alias("hours"))
    return members.select("pid", "shape").join(lit.withColumnRenamed("pid", "shape"), "shape", "left").select("pid", F.coalesce("hours", F.lit(0.0)).alias("hours"))


#: Places of the sun in a day: every minute.
SUNS_HELD = 1440


def shade(count: Column, most: Column, low: float, high: float) -> Column:
    """One colour channel between low and high by ln(count) / ln(most); high where most is 1."""
    part = F.when(most <= 1, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(F.ln(count), F.ln(most)), F.lit(0.0)))
    return F.lit(low) + part * F.lit(high - low)


def road_totals(seen: DataFrame, places: DataFrame, reach_area: DataFrame) -> DataFrame:
    """road_id, visible, ratio, share, and the inverse of each, summed over the points of a road (vid, road_id): the area that
    is seen, by that in reach (vid, total), and by all that is seen from anywhere."""
    from polisgrid.functions.geom import inverse_score

    per = seen.groupBy("vid").agg(F.sum("amount").alias("visible"))
    whole = per.agg(F.coalesce(F.sum("visible"), F.lit(0.0)).alias("all"))
    own = places.join(per, "vid", "left").join(reach_area, "vid", "left").withColumn("visible", F.coalesce("visible", F.lit(0.0)))
    own = own.join(F.broadcast(whole))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = own.groupBy("road_id").agg(F.sum("visible").alias("visible"), F.sum(zero(F.try_divide("visible", "total"))).alias("ratio"), F.sum(zero(F.try_divide("visible", "all"))).alias("share"))
    return out.withColumns({f"{c}_score": inverse_score(F.col(c)) for c in ("visible", "ratio", "share")})


def road_views(seen: DataFrame, places: DataFrame) -> DataFrame:
    """road_id, visible, score (inverse of visible) summed over the points of a road. places: vid, road_id."""
    from polisgrid.functions.geom import inverse_score

    per = places.join(seen, "vid", "left").groupBy("road_id").agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("visible"))
    return per.withColumn("score", inverse_score(F.col("visible")))


def in_reach(viewpoints: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """vid, pid, dist of points within reach in the plane."""
    from polisgrid.operators.spatial import radius_join

    out = radius_join(viewpoints.select(F.col("vid").alias("lid"), F.col("x").alias("lx"), F.col("y").alias("ly")), points.select(F.col("pid").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry")), reach)
    return out.select(F.col("lid").alias("vid"), F.col("rid").alias("pid"), length2(F.col("lx"), F.col("ly"), F.col("rx"), F.col("ry")).alias("dist"))
