"""Connected components of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polisgrid.llm.shared import Table


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these. Edges come with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(moved).where("a > b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> Table:
    """Table (id, root): every node with an edge to a smaller root, the smallest id of its component.

    edges has a and b (long); nulls, loops and repeats are ignored. Roots themselves aren't listed. Each round is
    written to the shared folder, so no lineage grows; only two sums a round come to the driver.
    """
    own = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    held = Table(own, "edges")
    before = None
    for _ in range(most_rounds):
        now = Table(_small_star(_large_star(held.df)), "edges")
        held.drop()
        held = now
        # Done when the edges are stars: they stay as they are.
        state = tuple(held.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            roots = Table(held.df.select(F.col("a").alias("id"), F.col("b").alias("root")), "roots")
            held.drop()
            return roots
        before = state
    raise RuntimeError("components did not settle")
