"""Graphs as edge tables: building, components, levels, shortest paths, centrality and its measures."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polisgrid.functions.geom import angle
from polisgrid.operators.spatial import radius_join
from polisgrid.plans.rounds import Stored


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of edges (src, dst, ...)."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edges with more of them; an edge that is there already keeps its row."""
    return edges.unionByName(more.join(edges, ["src", "dst"], "left_anti"))


def remove_vertices(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges without those at the vertices (id)."""
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_anti").join(ids.select(F.col("id").alias("dst")), "dst", "left_anti").select(edges.columns)


def degree(edges: DataFrame) -> DataFrame:
    """id, degree in the undirected graph."""
    return undirected(edges.select("src", "dst")).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def neighbours(edges: DataFrame, direction: str = "both") -> DataFrame:
    """id, neighbour: outgoing, incoming or both."""
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbour"))
    into = edges.select(F.col("dst").alias("id"), F.col("src").alias("neighbour"))
    return {"out": out, "in": into, "both": out.union(into)}[direction].distinct()


def dual_graph(segments: DataFrame) -> DataFrame:
    """Edges between segments (id, a, b with point structs x, y, z; length) that share an end: v < u, w_metric,
    w_angular. An end shared by very many segments is a join key like any other and may be split by AQE."""
    ends = segments.select("id", "length", F.explode(F.array(F.struct(F.col("a").alias("p"), F.col("b").alias("q")), F.struct(F.col("b").alias("p"), F.col("a").alias("q")))).alias("e")).select("id", "length", "e.p", "e.q")
    l = ends.select(F.col("id").alias("v"), F.col("length").alias("lv"), "p", F.col("q").alias("qv"))
    r = ends.select(F.col("id").alias("u"), F.col("length").alias("lu"), "p", F.col("q").alias("qu"))
    both = l.join(r, "p").where("v < u")
    d = [F.col("p")[k] - F.col("qv")[k] for k in "xyz"] + [F.col("qu")[k] - F.col("p")[k] for k in "xyz"]
    turn = F.coalesce(angle(*d), F.lit(0.0)) * F.lit(2.0 / np.pi)
    return both.groupBy("v", "u").agg(F.bround(F.min((F.col("lv") + F.col("lu")) / 2), 6).alias("w_metric"), F.bround(F.min(turn), 6).alias("w_angular"))


def custom_weights(dual: DataFrame, scores: DataFrame) -> DataFrame:
    """dual with w_custom, the mean of both segments' scores (id, score)."""
    a = scores.select(F.col("id").alias("v"), F.col("score").alias("sv"))
    b = scores.select(F.col("id").alias("u"), F.col("score").alias("su"))
    return dual.join(a, "v").join(b, "u").withColumn("w_custom", F.bround((F.col("sv") + F.col("su")) / 2, 6)).drop("sv", "su")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the smallest of the vertex and its neighbours."""
    both = undirected(edges)
    least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
    return both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src > dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are linked to the smallest of these. Edges come with src > dst."""
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    moved = edges.join(least, "src").where("dst > m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return least.select("src", F.col("m").alias("dst")).union(moved).where("src > dst").distinct()


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, root (smallest id of the component) of every vertex. Alternating large and small stars: one write a round, in
    about as many rounds as the logarithm of the longest path, until the edges stay as they are."""
    own = edges.where("src != dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    held, before = Stored(own), None
    while True:
        now = Stored(_small_star(_large_star(held.df)))
        held.drop()
        held = now
        state = tuple(held.df.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    out = Stored(vertices.select("id").distinct().join(held.df, F.col("id") == F.col("src"), "left").select("id", F.coalesce("dst", "id").alias("root")))
    held.drop()
    return out.df


def giant(components_: DataFrame) -> DataFrame:
    """root, size of the largest component (ties: smallest root)."""
    sizes = components_.groupBy("root").agg(F.count("*").alias("size"))
    return sizes.orderBy(F.desc("size"), "root").limit(1)


_MERGED = 8  # rounds of shortest_paths after which what was written is put together


def shortest_paths(edges: DataFrame, sources: DataFrame, limit: float = float("inf")) -> DataFrame:
    """source, id, dist, prev, hops of all vertices reached within limit from the sources (id), by relaxing the frontier in
    rounds: a graph of any size and any number of sources. Ties: fewer hops, then the smaller prev. Weights (w) must not
    be negative. A round writes only what it improved; the rounds end when nothing does."""
    held = Stored(edges.select("src", "dst", "w"))  # read each round: what it took to make them is done once
    edges = held.df
    if not edges.where("w < 0").isEmpty():
        raise ValueError("negative weight")
    columns = ["source", "id", "dist", "hops", "prev"]
    best = lambda df: df.groupBy("source", "id").agg(F.min(F.struct("dist", "hops", "prev")).alias("m")).select("source", "id", "m.dist", "m.hops", "m.prev")
    began = sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("dist"), F.lit(0).alias("hops"), F.lit(None).cast("long").alias("prev")).distinct()
    written = [Stored(began)]
    while True:
        known = written[0].df
        for w in written[1:]:
            known = known.unionByName(w.df)
        step = written[-1].df.join(edges.select("src", "dst", "w"), F.col("id") == F.col("src"))
        step = best(step.select("source", F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("dist"), (F.col("hops") + 1).alias("hops"), F.col("src").alias("prev")).where(F.col("dist") <= limit))
        old = best(known).select("source", "id", F.struct("dist", "hops", "prev").alias("old"))
        front = Stored(step.join(old, ["source", "id"], "left").where(F.col("old").isNull() | (F.struct("dist", "hops", "prev") < F.col("old"))).select(columns))
        if front.df.isEmpty():
            front.drop()
            out = Stored(best(known).select("source", "id", "dist", "prev", "hops"))
            for w in [*written, held]:
                w.drop()
            return out.df
        if len(written) >= _MERGED:
            whole = Stored(best(known).select(columns))
            for w in written:
                w.drop()
            written = [whole]
        written.append(front)


def levels(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """source, id, depth by breadth-first search."""
    return shortest_paths(edges.select("src", "dst", F.lit(1.0).alias("w")), sources).select("source", "id", F.col("dist").cast("long").alias("depth"))


def path_to(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target, step (0 at the target), id along the found paths; no row where a target is not reached. Every round
    doubles the length of what is known of the paths, and of the jumps back along them, so the rounds are as many as the
    logarithm of the longest path's steps."""
    jump = Stored(paths.where("prev is not null").select("source", F.col("id").alias("at"), F.col("prev").alias("to")))
    whole = Stored(paths.join(targets.select("id"), "id", "left_semi").select("source", F.col("id").alias("target"), F.lit(0).alias("step"), "id"))
    size = 1
    while True:
        more = whole.df.withColumnRenamed("id", "at").join(jump.df, ["source", "at"]).select("source", "target", (F.col("step") + size).alias("step"), F.col("to").alias("id"))
        fresh = Stored(more)
        if fresh.df.isEmpty():
            fresh.drop()
            jump.drop()
            return whole.df
        both = Stored(whole.df.union(fresh.df))
        second = jump.df.select("source", F.col("at").alias("to"), F.col("to").alias("far"))
        twice = Stored(jump.df.join(second, ["source", "to"]).select("source", "at", F.col("far").alias("to")))
        for table in (whole, fresh, jump):
            table.drop()
        whole, jump, size = both, twice, 2 * size


def choice(vertices: DataFrame, edges: DataFrame, limit: float = float("inf"), places: int = 6) -> DataFrame:
    """id, choice: over all ordered pairs of other vertices, the share of their shortest paths within limit that run through a
    vertex. For graphs of any size: no task or driver holds one.

    Brandes' sums as joins. An edge is tight for a source if it ends a shortest path, which is compared to so many places.
    Path counts go forward along tight edges, a number of edges a round: of each path that round counts that ends there.
    What depends on a vertex goes back along them, likewise a number of edges a round. A round reads only the vertices it
    starts from, and ends when there are none. Edges of weight 0 lead only to vertices with more steps, so none lead
    in a circle.
    """
    reach = shortest_paths(edges, vertices.select("id").distinct(), limit)
    near = F.bround(F.col("dist"), places)
    u = reach.select("source", F.col("id").alias("src"), near.alias("du"), F.col("hops").alias("hu"))
    v = reach.select("source", F.col("id").alias("dst"), near.alias("dv"), F.col("hops").alias("hv"))
    least = edges.where("src != dst").groupBy("src", "dst").agg(F.min("w").alias("w"))
    tight = u.join(least, "src").join(v, ["source", "dst"]).where((F.bround(F.col("du") + F.col("w"), places) == F.col("dv")) & ((F.col("dv") > F.col("du")) | (F.col("hv") > F.col("hu"))))
    steps = Stored(tight.select("source", "src", "dst"))

    def rounds(begin: DataFrame, step: Callable[[DataFrame], DataFrame]) -> list[Stored]:
        parts = [Stored(begin)]
        while not parts[-1].df.isEmpty():
            parts.append(Stored(step(parts[-1].df)))
        parts.pop().drop()
        return parts

    def together(parts: list[Stored]) -> DataFrame:
        out = parts[0].df
        for p in parts[1:]:
            out = out.union(p.df)
        return out

    began = reach.where("source = id").select("source", "id", F.lit(1.0).alias("n"))
    forward = rounds(began, lambda df: df.withColumnRenamed("id", "src").join(steps.df, ["source", "src"]).groupBy("source", F.col("dst").alias("id")).agg(F.sum("n").alias("n")))
    counts = Stored(together(forward).groupBy("source", "id").agg(F.sum("n").alias("n")))
    name = lambda k, n: counts.df.select("source", F.col("id").alias(k), F.col("n").alias(n))
    shares = Stored(steps.df.join(name("src", "a"), ["source", "src"]).join(name("dst", "b"), ["source", "dst"]).select("source", "src", "dst", (F.col("a") / F.col("b")).alias("part")))
    ones = counts.df.select("source", "id", F.lit(1.0).alias("x"))
    back = rounds(ones, lambda df: df.withColumnRenamed("id", "dst").join(shares.df, ["source", "dst"]).groupBy("source", F.col("src").alias("id")).agg(F.sum(F.col("x") * F.col("part")).alias("x")))
    through = together(back[1:]).where("source != id").groupBy("id").agg(F.sum("x").alias("choice")) if len(back) > 1 else ones.where("false").select("id", F.col("x").alias("choice"))
    out = Stored(vertices.select("id").distinct().join(through, "id", "left").select("id", F.coalesce("choice", F.lit(0.0)).alias("choice")))
    for table in (steps, counts, shares, *forward, *back):
        table.drop()
    return out.df


def depths(edges: DataFrame, sources: DataFrame, limit: float = float("inf")) -> DataFrame:
    """id, total_depth, reached (itself included) of each source, without any bound on the graph's size."""
    reach = shortest_paths(edges, sources, limit)
    return reach.groupBy(F.col("source").alias("id")).agg(F.sum("dist").alias("total_depth"), F.count("*").alias("reached"))


def update_weights(edges: DataFrame, given: DataFrame) -> DataFrame:
    """Edges with the weights of given (src, dst, w) where it has any; edges that are not there are not added."""
    g = given.select("src", "dst", F.col("w").alias("_w"))
    return edges.join(g, ["src", "dst"], "left").withColumn("w", F.coalesce("_w", "w")).drop("_w").select(edges.columns)


def common_edges(edges: DataFrame, others: DataFrame) -> DataFrame:
    """The edges that are in both."""
    return edges.select("src", "dst").intersect(others.select("src", "dst"))


# --- graphs of segments ------------------------------------------------------------------------------------------


def nodes(segments: DataFrame) -> DataFrame:
    """id, start, stop: the places of segments (id, a, b) as node numbers, which are 2 * id (+ 1 for the second end) of the
    first end there."""
    side = F.explode(F.array(*[F.struct((F.col("id") * 2 + k).cast("long").alias("end"), F.col(c).alias("p")) for k, c in enumerate("ab")])).alias("e")
    ends = segments.select(side).select("e.end", "e.p")
    first = ends.groupBy("p").agg(F.min("end").alias("node"))
    at = ends.join(first, "p").select(F.floor(F.col("end") / 2).cast("long").alias("id"), (F.col("end") % 2).alias("side"), "node")
    return at.groupBy("id").agg(F.max(F.when(F.col("side") == 0, F.col("node"))).alias("start"), F.max(F.when(F.col("side") == 1, F.col("node"))).alias("stop"))


def primal_graph(segments: DataFrame) -> DataFrame:
    """id, src, dst, w: an edge for each segment (id, a, b, length) between the nodes at its ends."""
    return segments.select("id", "length").join(nodes(segments), "id").select("id", F.col("start").alias("src"), F.col("stop").alias("dst"), F.col("length").alias("w"))


def directed_dual(segments: DataFrame) -> DataFrame:
    """src, dst: segments (id, a, b) of which one ends where the other begins."""
    l = segments.select(F.col("id").alias("src"), F.col("b").alias("p"))
    r = segments.select(F.col("id").alias("dst"), F.col("a").alias("p"))
    return l.join(r, "p").where("src != dst").select("src", "dst").distinct()


def roads_of(graph_: DataFrame, places: DataFrame) -> DataFrame:
    """src, dst, a, b: the edges of a graph as segments between the places (id, p) of its vertices."""
    a = places.select(F.col("id").alias("src"), F.col("p").alias("a"))
    b = places.select(F.col("id").alias("dst"), F.col("p").alias("b"))
    return graph_.select("src", "dst").join(a, "src").join(b, "dst")


def visual_weights(dual: DataFrame, scores: DataFrame, by_score: float = 1.0, by_angle: float = 0.0, by_length: float = 0.0) -> DataFrame:
    """v, u, w_metric, w_visual of a dual graph: the mean of both segments' scores (id, score), the turn as a part of a half
    circle, and the mean length, each times its weight."""
    a = scores.select(F.col("id").alias("v"), F.col("score").alias("sv"))
    b = scores.select(F.col("id").alias("u"), F.col("score").alias("su"))
    w = (F.col("sv") + F.col("su")) / 2 * by_score + F.col("w_angular") / 2 * by_angle + F.col("w_metric") * by_length
    return dual.join(a, "v").join(b, "u").select("v", "u", "w_metric", F.bround(w, 6).alias("w_visual"))


# --- kernels over a graph that fits a task --------------------------------------------------------------------

BYTES_HELD = 512 << 20  # of the arrays of a graph in a task


class Csr:
    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int):
        order = np.lexsort((dst, src))
        self.dst, self.w, self.n = dst[order], w[order], n
        self.at = np.append(0, np.cumsum(np.bincount(src, minlength=n)))


def single_source(g: Csr, s: int, limit: float, no_triangles: bool, within: np.ndarray | None = None) -> tuple[dict, list[int], dict, dict]:
    """Distances, order settled, predecessors and numbers of shortest paths, by vertex that is reached. Ties settle by
    vertex number.

    no_triangles: from a vertex one does not go on to a neighbour of one of its predecessors. within: the vertices that
    paths may use.
    """
    dist, sigma, preds = {s: 0.0}, {s: 1.0}, {s: []}
    heap, order, done = [(0.0, s)], [], set()
    while heap:
        d, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        order.append(v)
        near = set()
        if no_triangles:
            for p in preds[v]:
                near.update(g.dst[g.at[p] : g.at[p + 1]].tolist())
        a, b = g.at[v], g.at[v + 1]
        for u, weight in zip(g.dst[a:b].tolist(), g.w[a:b].tolist(), strict=True):
            if u in done or u in near or within is not None and not within[u]:
                continue
            to = round(d + weight, 6)
            if to > limit:
                continue
            if to < dist.get(u, np.inf):
                dist[u], sigma[u], preds[u] = to, sigma[v], [v]
                heapq.heappush(heap, (to, u))
            elif to == dist[u]:
                sigma[u] += sigma[v]
                preds[u].append(v)
    return dist, order, preds, sigma


def centrality(vertices: DataFrame, edges: DataFrame, limit: float = float("inf"), no_triangles: bool = False, parts: int | None = None, second: str | None = None) -> DataFrame:
    """id, total_depth, reached (itself included), choice (over ordered pairs) by one shortest-path tree a source.

    vertices: id, and perhaps limit, which replaces the common limit for this source. edges: src, dst, w in both
    directions. With second, w and the limit only say which vertices a source reaches, and the paths run among these by
    the weights in that column. The graph is held by every task, behind a check of its bytes before anything is
    collected; sources are dealt over tasks, and each gives partial sums of choice that Spark adds up. For a larger graph
    depths gives the first two measures.
    """
    kept = Stored(edges.select("src", "dst", F.col("w").cast("double").alias("w"), F.col(second or "w").cast("double").alias("w2")))
    edges = kept.df
    listed = vertices.select("id").distinct()
    n, m = listed.count(), edges.count()
    need = 8 * n + (24 + (8 if second else 0)) * m
    if need > BYTES_HELD:
        raise ValueError(f"a graph of {n} vertices and {m} edges takes {need} bytes; a task holds {BYTES_HELD}. Use depths, which is distributed")
    spark = edges.sparkSession
    ids = np.sort(listed.toPandas()["id"].to_numpy(np.int64))
    rows = edges.toPandas()
    kept.drop()
    if len(rows) and rows[["w", "w2"]].to_numpy().min() < 0:
        raise ValueError("negative weight")
    held = spark.sparkContext.broadcast((ids, *(np.searchsorted(ids, rows[c].to_numpy()) for c in ("src", "dst")), rows["w"].to_numpy(), rows["w2"].to_numpy() if second else None))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_, src, dst, w, w2 = held.value
        g = Csr(src, dst, w, len(ids_))
        other = None if w2 is None else Csr(src, dst, w2, len(ids_))
        choice = np.zeros(g.n)
        for pdf in batches:
            out = []
            for source, most in zip(pdf["id"], pdf["limit"], strict=True):
                s = int(np.searchsorted(ids_, source))
                dist, order, preds, sigma = single_source(g, s, most, no_triangles and other is None)
                if other is not None:
                    near = np.zeros(g.n, bool)
                    near[order] = True
                    dist, order, preds, sigma = single_source(other, s, float("inf"), no_triangles, near)
                delta = dict.fromkeys(order, 0.0)
                for v in reversed(order):
                    for p in preds[v]:
                        delta[p] += sigma[p] / sigma[v] * (1 + delta[v])
                    if v != s:
                        choice[v] += delta[v]
                out.append((source, float(sum(dist[v] for v in order)), len(order), 0.0))
            yield pd.DataFrame(out, columns=["id", "total_depth", "reached", "choice"])
        some = np.flatnonzero(choice)
        yield pd.DataFrame({"id": ids_[some], "total_depth": 0.0, "reached": 0, "choice": choice[some]})

    own = F.col("limit").cast("double") if "limit" in vertices.columns else F.lit(float(limit))
    dealt = vertices.select("id", own.alias("limit")).groupBy("id").agg(F.max("limit").alias("limit"))
    dealt = dealt.repartition(parts or spark.sparkContext.defaultParallelism, "id")
    part = dealt.mapInPandas(run, "id long, total_depth double, reached long, choice double")
    return part.groupBy("id").agg(F.sum("total_depth").alias("total_depth"), F.sum("reached").alias("reached"), F.sum("choice").alias("choice"))


def depth_first(edges: DataFrame, source: int) -> DataFrame:
    """id, n: the vertices reached from the source in the order of a depth-first walk that goes to the smallest neighbour
    first. The order depends on each step before, so one task walks; the graph's bytes are checked first."""
    own = edges.select("src", "dst").distinct()
    m = own.count()
    if 16 * m > BYTES_HELD:
        raise ValueError(f"a graph of {m} edges takes {16 * m} bytes; a task holds {BYTES_HELD}. Use levels, which is distributed")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near = {k: sorted(v) for k, v in pdf.groupby("src")["dst"]}
        seen, out, stack = set(), [], [source]
        while stack:
            v = stack.pop()
            if v in seen:
                continue
            seen.add(v)
            out.append((v, len(out)))
            stack += [u for u in reversed(near.get(v, [])) if u not in seen]
        return pd.DataFrame(out, columns=["id", "n"])

    return own.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, "id long, n long")


def measures(c: DataFrame, missing: float = 0.0) -> DataFrame:
    """Integration, mean depth, NAIN and NACH from total_depth, reached, choice; missing where the depth is 0."""
    n, td = F.col("reached").cast("double"), F.col("total_depth")
    some = lambda x: F.when(td != 0, x).otherwise(F.lit(missing))
    safe = F.when(td != 0, td)
    return c.withColumns(
        {
            "integration": some(n * n / safe),
            "mean_depth": some(F.try_divide(td, n - 1)),
            "nain": some(F.pow(n + 2, F.lit(1.2)) / safe),
            "nach": F.ln(F.col("choice") + 1) / F.ln(td + 3),
        }
    )


def closeness(reached: Column, total: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(reached - 1, n - 1) * F.try_divide(F.lit(1.0), total), F.lit(0.0))


def normalised(c: DataFrame, directed: bool = False) -> DataFrame:
    """closeness and betweenness of centrality's rows, by the number n of vertices: (reached - 1) / (n - 1) / total depth,
    and choice / ((n - 1)(n - 2)), twice that if directed."""
    n = F.col("_n").cast("double")
    both = c.join(F.broadcast(c.agg(F.count("*").alias("_n"))))
    part = F.coalesce(F.try_divide(F.col("choice"), (n - 1) * (n - 2)), F.lit(0.0)) * (2.0 if directed else 1.0)
    return both.withColumns({"closeness": closeness(F.col("reached"), F.col("total_depth"), n), "betweenness": part}).drop("_n")


def _joints(segments: DataFrame) -> DataFrame:
    """src, dst: the two segments (id, a, b) that meet at a place where no other ends."""
    ends = segments.select("id", F.explode(F.array("a", "b")).alias("p"))
    return ends.groupBy("p").agg(F.count("*").alias("n"), F.min("id").alias("src"), F.max("id").alias("dst")).where("n = 2 and src != dst").select("src", "dst")


def merge_chains(segments: DataFrame) -> DataFrame:
    """chain, parts of segments (id, a, b) joined over junctions of exactly two; chain is the smallest id."""
    found = components(segments.select("id"), _joints(segments))
    return found.groupBy(F.col("root").alias("chain")).agg(F.count("*").alias("parts"))


def chain_order(segments: DataFrame) -> DataFrame:
    """chain, seq, id, a, b: the segments (id, a, b of x, y) of each chain in the order and direction in which they are
    walked, from the end with the smaller place. A chain that closes on itself begins at the place where others meet it, or,
    if none do, with its smallest id, as it lies.

    Chains come from a distributed search; each is ordered by itself, so a task holds one road at a time.
    """
    found = components(segments.select("id"), _joints(segments))

    def run(key, pdf):
        rows = {i: (tuple(a.values()), tuple(b.values())) for i, a, b in zip(pdf["id"].tolist(), pdf["a"], pdf["b"], strict=True)}
        at: dict = {}
        for i, ends in sorted(rows.items()):
            for p in ends:
                at.setdefault(p, []).append(i)
        single = sorted(p for p, ids in at.items() if len(ids) == 1)
        met = sorted({tuple(p.values()) for c, n in (("a", "na"), ("b", "nb")) for p, k in zip(pdf[c], pdf[n], strict=True) if k > 2})
        now = single[0] if single else met[0] if met else rows[min(rows)][0]
        i = at[now][0] if single or met else min(rows)
        out, left = [], set(rows)
        while i is not None:
            left.discard(i)
            a, b = rows[i]
            a, b = (a, b) if a == now else (b, a)
            out.append((key[0], len(out) + 1, i, dict(zip("xy", a, strict=True)), dict(zip("xy", b, strict=True))))
            now = b
            i = next((k for k in at[now] if k in left), None)
        return pd.DataFrame(out, columns=["chain", "seq", "id", "a", "b"])

    xy = lambda c: F.struct(F.col(c)["x"].alias("x"), F.col(c)["y"].alias("y")).alias(c)
    own = segments.select("id", xy("a"), xy("b"))
    count = own.select(F.explode(F.array("a", "b")).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    at = lambda k: count.select(F.col("p").alias(k), F.col("n").alias(f"n{k}"))
    both = own.join(at("a"), "a").join(at("b"), "b").join(found, "id").select(F.col("root").alias("chain"), "id", "a", "b", "na", "nb")
    return both.groupBy("chain").applyInPandas(run, "chain long, seq long, id long, a struct<x:double,y:double>, b struct<x:double,y:double>")


# --- graphs of near points, by tiles --------------------------------------------------------------------------

_NEAR_BYTES = 128 << 20  # of neighbours that a tile keeps between passes; what is beyond is made again
_MOST = 8192  # units by which near_paths' last distances may fall
_SOURCES = 128  # that a tile's kernel takes at once


def near_paths(x: np.ndarray, y: np.ndarray, sources: np.ndarray, reach: float, limit: int, scale: int, span: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances (points by sources, in whole units; limit + 1: not within the limit) along edges between points closer
    than reach, whose weights are their lengths in units of 1 / scale, rounded; and the edges that end shortest paths
    and are not of weight 0, as from * s + k and to * s + k for the k-th of s sources. x is sorted.
    Edges that lead farther than span from the sources' box, by way of their first point, are left out.

    A pass from the middle outwards, over edges that lead away from it, leaves little to gain. Edges that are longer than the best way by
    under `most` then settle the rest; if no distance falls by more than that, the others can't shorten anything, else
    there is another pass, over all.
    """
    n, s = len(x), len(sources)
    wide = -(-s // 8) * 8  # so that eight columns are looked at as one word
    kind = np.int16 if limit + 2 + max(reach * scale, _MOST) < 32_000 else np.int64
    lo, hi = np.searchsorted(x, x - reach), np.searchsorted(x, x + reach, "right")
    apart = lambda p, q: np.maximum(0, np.maximum(q.min() - p, p - q.max()))
    least = np.hypot(apart(x, x[sources]), apart(y, y[sources]))
    out = np.hypot(x - x[sources].mean(), y - y[sources].mean())
    kept, held = {}, 0

    def near(v: int) -> tuple[np.ndarray, np.ndarray, int]:
        """From where an edge leads to a point, its weight, and how many of these are nearer to the middle, which come first."""
        nonlocal held
        if v in kept:
            return kept[v]
        a, b = lo[v], hi[v]
        dx, dy = x[a:b] - x[v], y[a:b] - y[v]
        d = np.sqrt(dx * dx + dy * dy)
        d[v - a] = np.inf
        some = (d < reach) & (least[a:b] + d <= span)
        inner = out[a:b] < out[v]
        first = np.flatnonzero(some & inner)
        k = np.append(first, np.flatnonzero(some & ~inner))
        found = k + a, np.rint(d[k] * scale).astype(kind)[:, None], len(first)
        if held < _NEAR_BYTES:
            kept[v] = found
            held += 10 * len(k)
        return found

    dist = np.full((n, wide), limit + 1, kind)
    bound = np.full(wide, -1, kind)
    for k, v in enumerate(sources.tolist()):
        to, w, _ = near(v)
        dist[to, k] = np.minimum(w[:, 0], limit + 1)
        dist[v, k] = 0
    order = out.argsort()
    middle = order[least[order] <= span].tolist()
    most, whole = 8, False
    while True:
        for v in middle:
            to, w, m = near(v)
            m = len(to) if whole else m
            if m:
                over = dist.take(to[:m], 0)
                over += w[:m]
                np.minimum(dist[v], over.min(0), out=dist[v])
        begin, ends, weights = [], [], []
        for v in middle:
            to, w, _ = near(v)
            over = dist.take(to, 0)
            over += w
            bound[:s] = dist[v, :s] + kind(most - 1)
            close = (over <= bound).reshape(-1)
            words = np.flatnonzero(close.view(np.uint64))
            word, bit = np.nonzero(close.reshape(-1, 8)[words])
            row, column = np.divmod(words[word] * 8 + bit, wide)
            begin.append(to[row] * wide + column)
            ends.append(v * wide + column)
            weights.append(w[row, 0])
        begin, ends, weights = (np.concatenate(c) for c in (begin, ends, weights))
        sort = np.argsort(ends, kind="stable")
        begin, ends, weights = begin[sort], ends[sort], weights[sort]
        at = np.flatnonzero(np.diff(ends, prepend=-1))
        flat, own = dist.reshape(-1), ends[at]
        before = flat.copy()
        while len(at):
            best = np.minimum.reduceat(flat[begin] + weights, at)
            if not (best < flat[own]).any():
                break
            flat[own] = np.minimum(flat[own], best)
        if not len(at) or (before - flat).max() <= most:
            break
        most, whole = min(2 * most, _MOST), True
    tight = (flat[begin] + weights == flat[ends]) & (weights > 0) & (flat[ends] <= limit)
    return dist[:, :s], *(k // wide * s + k % wide for k in (begin[tight], ends[tight]))


def path_shares(n: int, sources: np.ndarray, begin: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each of n points the sum over sources and targets of the share of shortest paths that run through it: Brandes' sums
    along near_paths' edges, in rounds of one edge of all paths."""
    s = len(sources)
    x = np.zeros(n * s)
    x[sources * s + np.arange(s)] = 1
    count = x.copy()
    while True:
        some = np.flatnonzero(x[begin])
        if not len(some):
            break
        x = np.bincount(ends[some], x[begin[some]], n * s)
        count += x
    some = np.flatnonzero(count[begin])
    begin, ends = begin[some], ends[some]
    part, x, through = count[begin] / count[ends], (count > 0).astype(float), np.zeros(n * s)
    while True:
        some = np.flatnonzero(x[ends])
        if not len(some):
            break
        x = np.bincount(begin[some], x[ends[some]] * part[some], n * s)
        through += x
    through[sources * s + np.arange(s)] = 0
    return through.reshape(n, s).sum(1)


def near_graph(points: DataFrame, reach: float, places: int = 3) -> DataFrame:
    """src, dst, w in both directions: points (id, x, y) closer than reach, and their distance to so many places."""
    l, r = (points.select(F.col("id").alias(f"{s}id"), F.col("x").alias(f"{s}x"), F.col("y").alias(f"{s}y")) for s in "lr")
    both = radius_join(l, r, reach).where("lid != rid")
    return both.select(F.col("lid").alias("src"), F.col("rid").alias("dst"), F.bround("dist", places).alias("w"))


def near_measures(points: DataFrame, reach: float, limit: float, places: int = 3, shares: bool = False) -> DataFrame:
    """id, total_depth, reached (itself included) and, with shares, choice (over ordered pairs) of the near_graph of points,
    within a finite limit. Edges of weight 0 are on no path that choice counts. A point without a place is alone.

    Neither edges nor distances are rows: a tile's task has the points around it as far as the limit and makes edges as it
    needs them, for some of its points at a time, so it holds no more than places, distances from so many points and the edges that
    end shortest paths. As rounded weights may be under the lengths, a path may get farther than the limit says. One that left
    what a task has would leave a point there that is nearer by edges than it lies by over the margin; if there is such a
    point, all is done again with more margin. Ids that lie at several places take the distributed joins.
    """
    points = points.where("id is not null")
    if not points.groupBy("id").count().where("count > 1").isEmpty():
        ids, edges = points.select("id").distinct(), near_graph(points, reach, places)
        return depths(edges, ids, limit).join(choice(ids, edges, limit, places), "id") if shares else depths(edges, ids, limit)
    scale, c = 10**places, F.col
    most, unit = int(np.floor(limit * scale + 1e-6)), 1 / scale
    kept = Stored(points.select("id", c("x").cast("double").alias("x"), c("y").cast("double").alias("y")))
    placed = kept.df.where("abs(x) < double('infinity') and abs(y) < double('infinity')")
    cell = lambda v: F.floor(v / F.lit(float(reach)))
    counts = placed.groupBy(cell(c("x")).alias("i"), cell(c("y")).alias("j")).agg(F.ceil(F.count("*") / _SOURCES).alias("parts"))
    spark = points.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x", kind="stable")
        ids, x, y = pdf["id"].to_numpy(), pdf["x"].to_numpy(), pdf["y"].to_numpy()
        every, through, out = np.flatnonzero(pdf["own"].to_numpy()), np.zeros(len(pdf)), []
        for k in range(0, len(every), _SOURCES):
            some = every[k : k + _SOURCES]
            dist, begin, ends = near_paths(x, y, some, reach, most, scale, span + unit)
            got = dist <= most
            far = np.hypot(x[:, None] - x[some], y[:, None] - y[some]) - dist / scale
            total = np.where(got, dist, 0).sum(0, dtype=np.int64) / scale
            out.append(pd.DataFrame({"id": ids[some], "total_depth": total, "reached": got.sum(0), "choice": 0.0, "gain": np.where(got, far, 0).max(0)}))
            if shares:
                through += path_shares(len(x), some, begin, ends)
        on = np.flatnonzero(through)
        out.append(pd.DataFrame({"id": ids[on], "total_depth": 0.0, "reached": 0, "choice": through[on], "gain": 0.0}))
        return pd.concat(out)

    margin = 64 * unit
    while True:
        span = limit + margin
        tiles = lambda v: F.explode(F.sequence(cell(c(v) - span), cell(c(v) + span)))  # noqa: B023, E731
        copies = placed.withColumn("i", tiles("x")).withColumn("j", tiles("y")).join(counts, ["i", "j"])
        copies = copies.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), c("parts") - 1)))
        own = (c("i") == cell(c("x"))) & (c("j") == cell(c("y"))) & (c("part") == F.pmod(F.xxhash64("id"), c("parts")))
        dealt = copies.select("i", "j", "part", "id", "x", "y", own.alias("own")).repartition(tasks, "i", "j", "part")
        found = dealt.groupBy("i", "j", "part").applyInPandas(run, "id long, total_depth double, reached long, choice double, gain double")
        sums = Stored(found.groupBy("id").agg(*(F.sum(k).alias(k) for k in ("total_depth", "reached", "choice")), F.max("gain").alias("gain")))
        gain = sums.df.agg(F.max("gain")).first()[0] or 0.0
        if gain < margin - unit:
            break
        sums.drop()
        margin = 4 * (gain + unit)
    values = [F.coalesce("total_depth", F.lit(0.0)).alias("total_depth"), F.coalesce("reached", F.lit(1)).alias("reached")]
    out = Stored(kept.df.select("id").join(sums.df, "id", "left").select("id", *values, *([F.coalesce("choice", F.lit(0.0)).alias("choice")] if shares else [])))
    for table in (kept, sums):
        table.drop()
    return out.df
