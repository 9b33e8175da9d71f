"""Editing of meshes that are given by faces (mesh, face, v: vertices in turn, counter-clockwise seen from outside) and
places (mesh, vertex, x, y, z). Every step is keyed by a face, an edge or a vertex of a mesh, so one mesh may be the whole
table. New numbers come from the old ones by arithmetic: they are unique and repeatable, but not consecutive.

Edits of one call may be in each other's way (two collapses at one vertex). They are then made in rounds: a round makes all
allowed edits that have the least draw among those near them, and the rounds end when no edit that is left is allowed.
Edits of what a mesh does not have are left out, repeated ones count once, and null numbers match nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polisgrid.plans.rounds import Stored


def _numbers(faces: DataFrame, places: DataFrame | None = None) -> tuple[int, int, int]:
    """The most sides of a face, and the next numbers of faces and vertices."""
    m = faces.agg(F.max(F.size("v")).alias("sides"), F.max("face").alias("face"), F.max(F.array_max("v")).alias("vertex")).first()
    alone = places.agg(F.max("vertex")).first()[0] if places is not None else None
    after = lambda *n: max((k + 1 for k in n if k is not None), default=0)
    return max(m.sides or 0, 1), after(m.face), after(m.vertex, alone)


def _faces(faces: DataFrame) -> DataFrame:
    return faces.select("mesh", F.col("face").cast("long").alias("face"), F.col("v").cast("array<long>").alias("v"))


def corners(faces: DataFrame) -> DataFrame:
    """mesh, face, k, p, a, b: each corner a with the corners before and after it; size is the face's."""
    n = F.size("v")
    at = lambda k: F.element_at("v", k % n + 1)
    one = _faces(faces).select("mesh", "face", "v", F.posexplode("v").alias("k", "a"))
    return one.select("mesh", "face", "k", at(F.col("k") + n - 1).alias("p"), "a", at(F.col("k") + 1).alias("b"), n.alias("size"))


def _edges(c: DataFrame, sides: int) -> DataFrame:
    """mesh, lo, hi, n (number of the edge), uses (faces), triangles, of corners."""
    ends = c.select("mesh", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), (F.col("face") * sides + F.col("k")).alias("n"), "size")
    return ends.groupBy("mesh", "lo", "hi").agg(F.min("n").alias("n"), F.count("*").alias("uses"), F.count_if(F.col("size") == 3).alias("triangles"))


def _both(edges: DataFrame) -> DataFrame:
    """mesh, at, to of edges in both directions."""
    return edges.select("mesh", F.explode(F.array(F.struct(F.col("lo").alias("at"), F.col("hi").alias("to")), F.struct(F.col("hi").alias("at"), F.col("lo").alias("to")))).alias("e")).select("mesh", "e.*")


def _rebuilt(c: DataFrame, w: Column) -> DataFrame:
    """Faces whose corners are replaced by the arrays w."""
    return c.groupBy("mesh", "face").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", w.alias("w")))), lambda x: x["w"])).alias("v"))


def _rings(c: DataFrame, *more: str) -> DataFrame:
    """mesh, a, closed, ring: the corners (b, p, ...) at each vertex, counter-clockwise; at a border from its edge on, else
    from the least b. Takes the square of a vertex's edges. A vertex at which several fans meet is an error."""
    at = c.groupBy("mesh", "a").agg(F.array_sort(F.collect_list(F.struct("b", "p", *more))).alias("at"))
    first = F.filter("at", lambda x: ~F.exists("at", lambda y: y["p"] == x["b"]))
    walk = F.aggregate("at", F.array(F.coalesce(F.get(first, F.lit(0)), F.get("at", F.lit(0)))), lambda s, _: F.concat(s, F.filter("at", lambda x: x["b"] == F.element_at(s, -1)["p"])))
    ring = at.select("mesh", "a", F.size("at").alias("n"), (F.size(first) == 0).alias("closed"), F.array_distinct(walk).alias("ring"))
    whole = F.when(F.size("ring") == F.col("n"), F.col("ring")).otherwise(F.raise_error(F.concat(F.lit("several fans at vertex "), F.col("a").cast("string"))))
    return ring.select("mesh", "a", "closed", whole.alias("ring"))


def _middles(faces: DataFrame, places: DataFrame) -> DataFrame:
    """mesh, face, x, y, z: the mean of a face's corners."""
    c = _faces(faces).select("mesh", "face", F.explode("v").alias("vertex"))
    return c.join(_spots(places), ["mesh", "vertex"]).groupBy("mesh", "face").agg(*(F.avg(k).alias(k) for k in "xyz"))


def _between(ends: DataFrame, places: DataFrame, t: float) -> DataFrame:
    """mesh, vertex, x, y, z: the share t of the way from the vertex s to the vertex e."""
    p = places.select("mesh", F.col("vertex").alias("s"), F.struct("x", "y", "z").alias("ps"))
    q = places.select("mesh", F.col("vertex").alias("e"), F.struct("x", "y", "z").alias("pe"))
    way = lambda k: (F.col("ps")[k] + (F.col("pe")[k] - F.col("ps")[k]) * t).alias(k)
    return ends.join(p, ["mesh", "s"]).join(q, ["mesh", "e"]).select("mesh", "vertex", *(way(k) for k in "xyz"))


def _spots(places: DataFrame) -> DataFrame:
    return places.select("mesh", F.col("vertex").cast("long").alias("vertex"), "x", "y", "z")


# --- edits that are never in each other's way ------------------------------------------------------------------------


def split_edges(faces: DataFrame, places: DataFrame, edges: DataFrame, t: float = 0.5, triangles: bool = False) -> tuple[DataFrame, DataFrame]:
    """Faces and places with a new vertex on each of the edges (mesh, a, b), at the share t of the way from a; if given both
    ways, from the lesser end. With triangles, a triangle with new vertices is cut into triangles: from the one vertex to the
    corner across; of two, off the corner between them, and the rest from the first of them; of three, off all corners."""
    sides, next_face, next_vertex = _numbers(faces, places)
    c = corners(faces)
    wanted = edges.select("mesh", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), (F.col("a") <= F.col("b")).alias("up")).groupBy("mesh", "lo", "hi").agg(F.max("up").alias("up"))
    fresh = _edges(c, sides).join(wanted, ["mesh", "lo", "hi"]).select("mesh", "lo", "hi", "up", (F.col("n") + next_vertex).alias("vertex"))
    held = c.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(fresh, ["mesh", "lo", "hi"], "left")
    s, e = F.when(F.col("up"), F.col("lo")).otherwise(F.col("hi")), F.when(F.col("up"), F.col("hi")).otherwise(F.col("lo"))
    spots = _spots(places).unionByName(_between(fresh.select("mesh", "vertex", s.alias("s"), e.alias("e")), places, t))
    if not triangles:
        return _rebuilt(held, F.when(F.col("vertex").isNull(), F.array("a")).otherwise(F.array("a", "vertex"))), spots
    cut = held.groupBy("mesh", "face").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "a", "vertex"))), lambda x: x.dropFields("k")).alias("r"))
    new = lambda k: F.get("r", F.lit(k))["vertex"].isNotNull()
    count = F.size(F.filter("r", lambda x: x["vertex"].isNotNull()))
    # Turned so that new vertices come first: one is on the first edge, two are on the first and second.
    by = F.when(count == 1, F.when(new(0), 0).when(new(1), 1).otherwise(2)).when(count == 2, F.when(~new(2), 0).when(~new(0), 1).otherwise(2)).otherwise(0)
    turned = cut.select("mesh", "face", "r", F.size("r").alias("size"), count.alias("count"), by.alias("by")).withColumn("q", F.concat(F.slice("r", F.col("by") + 1, F.greatest(F.col("size"), F.lit(1))), F.slice("r", 1, F.col("by"))))
    a, b, d = (F.get("q", F.lit(k))["a"] for k in range(3))
    u, w, x = (F.get("q", F.lit(k))["vertex"] for k in range(3))
    plain = F.flatten(F.transform("r", lambda y: F.when(y["vertex"].isNull(), F.array(y["a"])).otherwise(F.array(y["a"], y["vertex"]))))
    parts = (
        F.when(F.col("size") != 3, F.array(plain))
        .when(F.col("count") == 0, F.array(F.array(a, b, d)))
        .when(F.col("count") == 1, F.array(F.array(a, u, d), F.array(u, b, d)))
        .when(F.col("count") == 2, F.array(F.array(u, b, w), F.array(a, u, d), F.array(u, w, d)))
        .otherwise(F.array(F.array(a, u, x), F.array(u, b, w), F.array(w, d, x), F.array(u, w, x)))
    )
    out = turned.select("mesh", "face", F.posexplode(parts).alias("j", "v"))
    return out.select("mesh", F.when(F.col("j") == 0, F.col("face")).otherwise(F.col("face") * 3 + F.col("j") - 1 + next_face).alias("face"), "v"), spots


def split_faces(faces: DataFrame, cuts: DataFrame) -> DataFrame:
    """Faces cut by a new edge from corner a to corner b (mesh, face, a, b), which must not be neighbours: the face keeps what
    lies from a to b in turn. Of several cuts of a face the least is made."""
    _, next_face, _ = _numbers(faces)
    least = cuts.where("a is not null and b is not null").groupBy("mesh", F.col("face").cast("long").alias("face")).agg(F.min(F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))).alias("cut"))
    n, i = F.size("v"), F.array_position("v", F.col("cut.a")).cast("int")
    j = F.array_position("q", F.col("cut.b")).cast("int")
    turned = _faces(faces).join(least, ["mesh", "face"], "left").withColumn("q", F.when(i > 0, F.concat(F.slice("v", i, n), F.slice("v", 1, i - 1))))
    fits = F.coalesce((j > 2) & (j < n), F.lit(False))
    parts = F.when(fits, F.array(F.slice("q", 1, j), F.concat(F.slice("q", j, n), F.slice("q", 1, 1)))).otherwise(F.array("v"))
    out = turned.select("mesh", "face", F.posexplode(parts).alias("k", "w"))
    return out.select("mesh", (F.col("face") + F.col("k") * next_face).alias("face"), F.col("w").alias("v"))


def stellate(faces: DataFrame, places: DataFrame, chosen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Faces and places with each face (or those of chosen: mesh, face) cut into triangles about its middle."""
    sides, next_face, next_vertex = _numbers(faces, places)
    own = _faces(faces)
    key = chosen.select("mesh", F.col("face").cast("long").alias("face")).distinct() if chosen is not None else None
    cut, rest = (own, own.limit(0)) if key is None else (own.join(key, ["mesh", "face"], "left_semi"), own.join(key, ["mesh", "face"], "left_anti"))
    number = F.when(F.col("k") == 0, F.col("face")).otherwise(F.col("face") * sides + F.col("k") + next_face)
    fans = corners(cut).select("mesh", number.alias("face"), F.array(F.col("face") + next_vertex, "a", "b").alias("v"))
    spots = _middles(cut, places).select("mesh", (F.col("face") + next_vertex).alias("vertex"), "x", "y", "z")
    return fans.unionByName(rest), _spots(places).unionByName(spots)


def dual(faces: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The dual mesh: a vertex in the middle of each face, with its number, and a face for each vertex that isn't at a
    border; several fans at a border are no error here."""
    r = _rings(corners(faces), "face").where("closed")
    return r.select("mesh", F.col("a").alias("face"), F.transform("ring", lambda x: x["face"]).alias("v")), _middles(faces, places).withColumnRenamed("face", "vertex")


def truncate(faces: DataFrame, places: DataFrame, t: float = 1 / 3) -> tuple[DataFrame, DataFrame]:
    """The mesh with its vertices cut off at the share t of each edge. A vertex becomes a face of as many corners as it has
    edges, if these are three or more; at a border its face ends at the border's edges. Sides are as many as a mesh's corners,
    so they are always joined by a shuffle: none is sent through the driver."""
    sides, next_face, _ = _numbers(faces)
    c = corners(faces).withColumn("n", (F.col("face") * sides + F.col("k")) * 2)
    # The new vertex at a on the edge to b: that of the side a to b, or, where no face has that side, of the side b to a.
    side = c.select("mesh", "a", "b", "n")
    back = side.select("mesh", F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("m"))
    new = side.join(back.hint("merge"), ["mesh", "a", "b"], "full").select("mesh", "a", "b", F.coalesce(F.col("n"), F.col("m") + 1).alias("vertex"))
    there = new.select("mesh", F.col("a").alias("b"), F.col("b").alias("a"), F.col("vertex").alias("w"))
    own = _rebuilt(c.join(there.hint("merge"), ["mesh", "a", "b"]), F.array("n", "w"))
    before = new.select("mesh", "a", F.col("b").alias("p"), F.col("vertex").alias("pv"))
    ring = _rings(c.join(before.hint("merge"), ["mesh", "a", "p"]), "n", "pv")
    tips = F.concat(F.transform("ring", lambda x: x["n"]), F.when(F.col("closed"), F.slice(F.transform("ring", lambda x: x["pv"]), 1, 0)).otherwise(F.array(F.element_at("ring", -1)["pv"])))
    tip = ring.select("mesh", (F.col("a") + next_face).alias("face"), tips.alias("v")).where("size(v) > 2")
    return own.unionByName(tip), _between(new.select("mesh", "vertex", F.col("a").alias("s"), F.col("b").alias("e")), places, t)


# --- edits in rounds -----------------------------------------------------------------------------------------------


def _draw(*key: str) -> Column:
    return F.struct(F.xxhash64(*key).alias("draw"), *key)


def _spread(least: DataFrame, edges: DataFrame) -> DataFrame:
    """mesh, at, m: the least m of a vertex and its neighbours."""
    over = edges.join(least.withColumnRenamed("at", "to"), ["mesh", "to"]).select("mesh", "at", "m")
    return least.unionByName(over).groupBy("mesh", "at").agg(F.min("m").alias("m"))


def _first_near(ready: DataFrame, ends: list[str], edges: DataFrame, steps: int = 1) -> DataFrame:
    """Those of ready (mesh, ends, m) that have the least m of all within the steps of their ends."""
    least = ready.select("mesh", F.explode(F.array(*ends)).alias("at"), "m").groupBy("mesh", "at").agg(F.min("m").alias("m"))
    for _ in range(steps):
        least = _spread(least, edges)
    for e in ends:
        ready = ready.join(least.select("mesh", F.col("at").alias(e), F.col("m").alias("near")), ["mesh", e]).where("m = near").drop("near")
    return ready.drop("m")


def _rounds(faces: DataFrame, wanted: DataFrame, step) -> DataFrame:
    """Faces after the rounds. step(faces, wanted) gives the edits (stored) of a round, and what makes faces and wanted of them."""
    held, left = Stored(_faces(faces)), Stored(wanted)
    while True:
        edits, make = step(held.df, left.df)
        chosen = Stored(edits)
        if chosen.df.isEmpty():
            chosen.drop()
            left.drop()
            return held.df
        f, w = make(held.df, left.df, chosen.df)
        now, rest = Stored(f), Stored(w)
        for s in (held, left, chosen):
            s.drop()
        held, left = now, rest


def collapse_edges(faces: DataFrame, places: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces and places after each of the edges (mesh, a, b) is drawn together to a; b goes. Not allowed are an edge inside
    whose ends are both at a border, and one whose ends have more neighbours in common than triangles lie at it. An edge that
    is left and whose end goes is from then on an edge of the vertex that stays."""

    def step(f: DataFrame, w: DataFrame):
        e = _edges(corners(f), 1)
        link = _both(e)
        rim = e.where("uses = 1").select("mesh", F.explode(F.array("lo", "hi")).alias("at")).distinct().withColumn("rim", F.lit(True))
        about = link.groupBy("mesh", "at").agg(F.count("*").alias("degree")).join(rim, ["mesh", "at"], "left").select("mesh", "at", "degree", F.coalesce("rim", F.lit(False)).alias("rim"))
        c = w.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(e.drop("n"), ["mesh", "lo", "hi"])
        for x in "ab":
            c = c.join(about.select("mesh", F.col("at").alias(x), F.col("degree").alias(f"d{x}"), F.col("rim").alias(f"r{x}")), ["mesh", x])
        c = c.where("uses = 1 or not (ra and rb)")
        # The end with fewer edges looks for its neighbours at the other one, so that a hub costs no more than its edges do.
        few, many = F.when(F.col("da") <= F.col("db"), F.col("a")).otherwise(F.col("b")), F.when(F.col("da") <= F.col("db"), F.col("b")).otherwise(F.col("a"))
        look = c.select("mesh", "a", "b", few.alias("at"), many.alias("other")).join(link, ["mesh", "at"]).select("mesh", "a", "b", F.col("other").alias("at"), "to")
        common = look.join(link, ["mesh", "at", "to"]).groupBy("mesh", "a", "b").agg(F.count("*").alias("common"))
        ready = c.join(common, ["mesh", "a", "b"], "left").where("coalesce(common, 0) <= triangles").select("mesh", "a", "b", _draw("mesh", "a", "b").alias("m"))
        return _first_near(ready, ["a", "b"], link), make

    def make(f: DataFrame, w: DataFrame, chosen: DataFrame):
        to = chosen.select("mesh", F.col("b").alias("gone"), F.col("a").alias("stays"))
        c = corners(f)
        v = _rebuilt(c.join(to, (c["mesh"] == to["mesh"]) & (c["a"] == to["gone"]), "left").select(c["mesh"], "face", "k", "a", "stays"), F.array(F.coalesce("stays", "a")))
        once = F.filter("v", lambda x, k: x != F.element_at("v", F.when(k == 0, -1).otherwise(k)))
        f = v.select("mesh", "face", once.alias("v")).where("size(v) > 2")
        w = w.join(chosen, ["mesh", "a", "b"], "left_anti")
        for x in "ab":
            w = w.join(to.withColumnRenamed("gone", x), ["mesh", x], "left").withColumn(x, F.coalesce("stays", x)).drop("stays")
        return f, w.where("a != b").select("mesh", "a", "b").distinct()

    wanted = edges.select("mesh", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a != b").distinct()
    out = _rounds(faces, wanted, step)
    had = _faces(faces).select("mesh", F.explode("v").alias("vertex")).distinct()
    has = out.select("mesh", F.explode("v").alias("vertex")).distinct()
    return out, _spots(places).join(had.join(has, ["mesh", "vertex"], "left_anti"), ["mesh", "vertex"], "left_anti")


def merge_faces(faces: DataFrame, edges: DataFrame) -> DataFrame:
    """Faces after those at both sides of each of the edges (mesh, a, b) are made one, with the lesser number. Not allowed
    are edges at a border, with an end that has but two edges, or between faces that have other edges in common."""

    def step(f: DataFrame, w: DataFrame):
        c = corners(f)
        link = _both(_edges(c, 1))
        degree = link.groupBy("mesh", "at").agg(F.count("*").alias("degree")).where("degree > 2")
        pair = c.select("mesh", "a", "b", F.col("face").alias("f")).join(c.select("mesh", F.col("b").alias("a"), F.col("a").alias("b"), F.col("face").alias("g")), ["mesh", "a", "b"]).where("f < g")
        alone = pair.groupBy("mesh", "f", "g").agg(F.count("*").alias("n"), F.min("a").alias("a"), F.min("b").alias("b")).where("n = 1").drop("n")
        ready = alone.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")}).join(w, ["mesh", "lo", "hi"])
        for x in ("lo", "hi"):
            ready = ready.join(degree.select("mesh", F.col("at").alias(x)), ["mesh", x], "left_semi")
        ready = ready.withColumn("m", _draw("mesh", "lo", "hi"))
        for one, two in (("lo", "hi"), ("f", "g")):
            least = ready.select("mesh", F.explode(F.array(one, two)).alias("at"), "m").groupBy("mesh", "at").agg(F.min("m").alias("near"))
            for x in (one, two):
                ready = ready.join(least.select("mesh", F.col("at").alias(x), F.col("near").alias(f"near_{x}")), ["mesh", x])
        least = F.least("near_lo", "near_hi", "near_f", "near_g")
        return ready.where(F.col("m") == least).select("mesh", "lo", "hi", "f", "g", "a", "b"), make

    def make(f: DataFrame, w: DataFrame, chosen: DataFrame):
        other = f.select("mesh", F.col("face").alias("g"), F.col("v").alias("u"))
        new = chosen.join(other, ["mesh", "g"]).select("mesh", F.col("f").alias("face"), "g", "a", "b", "u")
        # Face f goes from b round to a, the other one from a round to b.
        turn = lambda v, x: F.concat(F.slice(v, F.array_position(v, x).cast("int"), F.size(v)), F.slice(v, 1, F.array_position(v, x).cast("int") - 1))
        both = F.concat(F.slice(turn(F.col("v"), F.col("b")), F.lit(1), F.size("v") - 1), F.slice(turn(F.col("u"), F.col("a")), F.lit(1), F.size("u") - 1))
        kept = f.join(new.select("mesh", F.col("g").alias("face")), ["mesh", "face"], "left_anti")
        f = kept.join(new, ["mesh", "face"], "left").select("mesh", "face", F.when(F.col("u").isNull(), F.col("v")).otherwise(both).alias("v"))
        return f, w.join(chosen, ["mesh", "lo", "hi"], "left_anti")

    wanted = edges.select("mesh", F.least("a", "b").cast("long").alias("lo"), F.greatest("a", "b").cast("long").alias("hi")).where("lo != hi").distinct()
    return _rounds(faces, wanted, step)


def erase_vertices(faces: DataFrame, places: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces and places without the vertices (mesh, vertex): the faces about one become one, with the least of their numbers.
    Not allowed are vertices at a border, with a neighbour that has but two edges, or whose faces would meet in a vertex twice."""

    def step(f: DataFrame, w: DataFrame):
        c = corners(f)
        link = _both(_edges(c, 1))
        weak = link.groupBy("mesh", "at").agg(F.count("*").alias("degree")).where("degree < 3").select("mesh", F.col("at").alias("to"))
        barred = link.join(weak, ["mesh", "to"]).select("mesh", F.col("at").alias("vertex"))
        near = c.join(w.select("mesh", F.col("vertex").alias("a")), ["mesh", "a"], "left_semi").join(f, ["mesh", "face"])
        i = F.array_position("v", F.col("a")).cast("int")
        turned = F.concat(F.slice("v", i + 1, F.size("v")), F.slice("v", F.lit(1), i - 1))
        ring = _rings(near.withColumn("way", F.slice(turned, F.lit(1), F.size("v") - 2)), "face", "way").where("closed")
        whole = ring.select("mesh", F.col("a").alias("vertex"), F.flatten(F.transform("ring", lambda x: x["way"])).alias("v"), F.transform("ring", lambda x: x["face"]).alias("faces"))
        ready = whole.where("size(array_distinct(v)) = size(v) and size(v) > 2").join(barred, ["mesh", "vertex"], "left_anti").withColumn("m", _draw("mesh", "vertex"))
        # Vertices of one face are near each other, whether or not an edge joins them.
        hubs = c.select("mesh", F.col("a").alias("at"), (-F.col("face") - 1).alias("to"))
        net = hubs.unionByName(hubs.select("mesh", F.col("to").alias("at"), F.col("at").alias("to")))
        return _first_near(ready, ["vertex"], net, 4), make

    def make(f: DataFrame, w: DataFrame, chosen: DataFrame):
        gone = chosen.select("mesh", F.explode("faces").alias("face"))
        new = chosen.select("mesh", F.array_min("faces").alias("face"), "v")
        return f.join(gone, ["mesh", "face"], "left_anti").unionByName(new), w.join(chosen, ["mesh", "vertex"], "left_anti")

    wanted = vertices.select("mesh", F.col("vertex").cast("long").alias("vertex")).distinct()
    out = _rounds(faces, wanted, step)
    had = _faces(faces).select("mesh", F.explode("v").alias("vertex")).distinct()
    has = out.select("mesh", F.explode("v").alias("vertex")).distinct()
    return out, _spots(places).join(had.join(has, ["mesh", "vertex"], "left_anti"), ["mesh", "vertex"], "left_anti")


def split_vertices(faces: DataFrame, places: DataFrame, at: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces and places after vertices (mesh, vertex, first, second: two of its neighbours) become two, joined by an edge: the
    edges from second on, counter-clockwise, until before first go to a new vertex at the same place; collapse_edges takes it
    back. Of several rows for a vertex the least counts; vertices at a border and unknown neighbours are left out."""
    _, _, next_vertex = _numbers(faces, places)
    long = [F.col(k).cast("long").alias(k) for k in ("vertex", "first", "second")]
    one = at.select("mesh", *long).where("first != second").groupBy("mesh", F.col("vertex").alias("a")).agg(F.min(F.struct("first", "second")).alias("s"))
    c = corners(faces)
    ring = _rings(c.join(one, ["mesh", "a"], "left_semi")).where("closed").join(one, ["mesh", "a"])
    order = F.transform("ring", lambda x: x["b"])
    i, j = F.array_position(order, F.col("s.first")).cast("int"), F.array_position(order, F.col("s.second")).cast("int")
    moved = F.when(j < i, F.slice(order, j, i - j)).otherwise(F.concat(F.slice(order, j, F.size("ring")), F.slice(order, F.lit(1), i - 1)))
    moves = ring.where((i > 0) & (j > 0)).select("mesh", "a", moved.alias("moved"), (F.col("a") + next_vertex).alias("twin"))
    to_b, to_p = F.array_contains("moved", F.col("b")), F.array_contains("moved", F.col("p"))
    w = F.when(F.col("twin").isNull() | ~(to_b | to_p), F.array("a")).when(to_b & to_p, F.array("twin")).when(to_b, F.array("a", "twin")).otherwise(F.array("twin", "a"))
    copies = _spots(places).join(moves.select("mesh", F.col("a").alias("vertex"), "twin"), ["mesh", "vertex"]).select("mesh", F.col("twin").alias("vertex"), "x", "y", "z")
    return _rebuilt(c.join(moves, ["mesh", "a"], "left"), w), _spots(places).unionByName(copies)


_BUCKET = 1 << 16  # numbers that renumber ranks in one task


def _ranks(df: DataFrame, key: str) -> DataFrame:
    """mesh, key, rank (from 0 on within each mesh) of distinct rows: ranks within ranges of numbers, above sums over the ranges."""
    rows = df.select("mesh", key).distinct().withColumn("bucket", F.floor(F.col(key) / _BUCKET))
    sums = rows.groupBy("mesh", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("mesh").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("mesh", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("mesh", "bucket").orderBy(key))
    return rows.join(sums, ["mesh", "bucket"]).select("mesh", key, (F.col("base") + within - 1).alias("rank"))


def renumber(faces: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces and places numbered from 0 on without gaps in each mesh, in the order of the old numbers."""
    own, spots = _faces(faces), _spots(places)
    f, v = _ranks(own, "face"), _ranks(spots, "vertex")
    c = corners(own).join(v.withColumnRenamed("vertex", "a"), ["mesh", "a"])
    out = _rebuilt(c, F.array("rank")).join(f, ["mesh", "face"]).select("mesh", F.col("rank").alias("face"), "v")
    return out, spots.join(v, ["mesh", "vertex"]).select("mesh", F.col("rank").alias("vertex"), "x", "y", "z")


def to_obj(faces: DataFrame, places: DataFrame) -> DataFrame:
    """mesh, seq, line: the lines of an OBJ file of each mesh, to be written in the order of seq: vertices, then faces. A file counts
    vertices from 1 on in their order, so numbers run from 0 on without gaps, as `renumber` gives them."""
    faces, places = renumber(faces, places)
    v = places.select("mesh", F.col("vertex").cast("long").alias("seq"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("line"))
    _, _, after = _numbers(faces, places)
    f = _faces(faces).select("mesh", (F.col("face") + after).alias("seq"), F.concat_ws(" ", F.lit("f"), F.transform("v", lambda x: (x + 1).cast("string"))).alias("line"))
    return v.unionByName(f)
