"""Interchanges drawn as many small roads, replaced by one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polisgrid.operators.centre import chained, length_of, segments_of
from polisgrid.operators.graph import components
from polisgrid.operators.overlay import faces
from polisgrid.operators.spatial import box_join, inside
from polisgrid.plans.rounds import Stored


def merged_boxes(boxes: DataFrame, cell: float) -> DataFrame:
    """id, x0, y0, x1, y1: the hull of each group of boxes that touch one another; id is the group's least."""
    side = lambda p: boxes.select(F.col("id").alias(f"{p}id"), *(F.col(c).alias(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")))
    touch = box_join(side("l"), side("r"), cell).where("lid < rid").select(F.col("lid").alias("src"), F.col("rid").alias("dst"))
    return boxes.join(components(boxes, touch), "id").groupBy(F.col("root").alias("id")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def _meets(ax: Column, ay: Column, bx: Column, by: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a segment and a closed box have a place in common: the segment's part within the box's slabs isn't empty."""
    low, high = F.lit(0.0), F.lit(1.0)
    for a, b, lo, hi in ((ax, bx, x0, x1), (ay, by, y0, y1)):
        d = b - a
        s, t = F.try_divide(lo - a, d), F.try_divide(hi - a, d)
        flat = d == 0
        out = flat & ((a < lo) | (a > hi))
        low = F.when(out, F.lit(2.0)).when(flat, low).otherwise(F.greatest(low, F.least(s, t)))
        high = F.when(flat, high).otherwise(F.least(high, F.greatest(s, t)))
    return low <= high


def simplify_interchanges(segments: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """ax, ay, bx, by of a road network (segments that meet at ends only) in which what lies in each box (id, x0, y0, x1, y1) is
    one place, joined to the roads that lead there.

    Boxes that touch are one. Roads are what lies between junctions. Of the roads that meet a box, and the shorter ones
    (than the root of twice its area) between their ends, the faces are traced: roads between corners of faces, roads from
    a corner to a dead end, and roads in a face go. The corners that other roads still reach are joined to their mean.
    A box without a face changes nothing. An empty network stays empty.
    """
    c = F.col
    roads = Stored(chained(segments))
    first, last = F.element_at("pts", 1), F.element_at("pts", -1)
    ends = Stored(roads.df.select("id", first.alias("a"), last.alias("b"), length_of(c("pts")).alias("size")))
    degree = ends.df.select(F.explode(F.array("a", "b")).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    merged = Stored(merged_boxes(boxes, cell)).df
    n = F.size("pts")
    pairs = F.zip_with(F.slice("pts", F.lit(1), n - 1), F.slice("pts", F.lit(2), n - 1), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    steps = Stored(roads.df.select("id", F.explode(pairs).alias("e")).select("id", "e.*"))
    left = steps.df.select(c("id").alias("lid"), "ax", "ay", "bx", "by", F.least("ax", "bx").alias("lx0"), F.greatest("ax", "bx").alias("lx1"), F.least("ay", "by").alias("ly0"), F.greatest("ay", "by").alias("ly1"))
    right = merged.select(c("id").alias("rid"), *(c(k).alias(f"r{k}") for k in ("x0", "y0", "x1", "y1")))
    hit = box_join(left, right, cell).where(_meets(c("ax"), c("ay"), c("bx"), c("by"), c("rx0"), c("ry0"), c("rx1"), c("ry1")))
    touched = Stored(hit.select(c("rid").alias("gid"), c("lid").alias("id")).distinct())
    corners = touched.df.join(ends.df, "id").select("gid", F.explode(F.array("a", "b")).alias("p")).distinct()
    area = merged.select(c("id").alias("gid"), ((c("x1") - c("x0")) * (c("y1") - c("y0"))).alias("area"))
    beside = ends.df.join(corners.withColumnRenamed("p", "a"), "a").join(corners.withColumnRenamed("p", "b"), ["gid", "b"]).join(area, "gid").where(c("size") < F.sqrt(2 * c("area"))).select("gid", "id")
    taken = Stored(touched.df.union(beside).distinct())
    own = taken.df.join(steps.df, "id").select("gid", F.least(F.struct(c("ax").alias("x"), c("ay").alias("y")), F.struct(c("bx").alias("x"), c("by").alias("y"))).alias("a"), F.greatest(F.struct(c("ax").alias("x"), c("ay").alias("y")), F.struct(c("bx").alias("x"), c("by").alias("y"))).alias("b")).distinct()
    found, sides = faces(own.select("gid", c("a.x").alias("ax"), c("a.y").alias("ay"), c("b.x").alias("bx"), c("b.y").alias("by")))
    shells, sides = Stored(found).df, Stored(sides).df
    # Junctions on the border of some face.
    place = lambda k: F.struct(c(f"{k}x").alias("x"), c(f"{k}y").alias("y"))
    rim = sides.where("borders").select("gid", F.explode(F.array(place("a"), place("b"))).alias("p")).distinct()
    nodes = Stored(rim.join(degree.select("p"), "p", "left_semi").select("gid", "p"))
    at = lambda k: nodes.df.select("gid", c("p").alias(k))
    between = ends.df.join(at("a"), "a").join(at("b"), ["gid", "b"]).select("id")
    dead = degree.where("n = 1").select("p")
    stubs = ends.df.join(nodes.df.select(c("p").alias("a")).distinct(), "a", "left_semi").join(dead.withColumnRenamed("p", "b"), "b", "left_semi").select("id")
    stubs = stubs.union(ends.df.join(nodes.df.select(c("p").alias("b")).distinct(), "b", "left_semi").join(dead.withColumnRenamed("p", "a"), "a", "left_semi").select("id"))
    middle = steps.df.select("id", ((c("ax") + c("bx")) / 2).alias("x"), ((c("ay") + c("by")) / 2).alias("y"), F.monotonically_increasing_id().alias("pid"))
    closed = shells.select(c("root").alias("gid"), F.concat("shell", F.slice("shell", 1, 1)).alias("shell"))
    within = inside(middle.select("pid", "x", "y"), closed, cell).select("pid").distinct()
    covered = middle.join(within.withColumn("in", F.lit(1)), "pid", "left").groupBy("id").agg(F.count("*").alias("n"), F.count("in").alias("m")).where("n = m").select("id")
    gone = Stored(between.union(stubs).union(covered).distinct())
    left_over = Stored(ends.df.join(gone.df, "id", "left_anti").select(F.explode(F.array("a", "b")).alias("p")).distinct())
    spokes = nodes.df.join(left_over.df, "p", "left_semi")
    hub = spokes.groupBy("gid").agg(F.avg("p.x").alias("hx"), F.avg("p.y").alias("hy"))
    star = spokes.join(hub, "gid").select(F.least(F.struct(c("hx").alias("x"), c("hy").alias("y")), "p").alias("a"), F.greatest(F.struct(c("hx").alias("x"), c("hy").alias("y")), "p").alias("b")).where("a != b")
    kept = segments_of(roads.df.join(gone.df, "id", "left_anti"))
    return kept.union(star.select(c("a.x").alias("ax"), c("a.y").alias("ay"), c("b.x").alias("bx"), c("b.y").alias("by"))).distinct()
