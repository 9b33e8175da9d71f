"""Convex hulls of groups of any size, and the boxes about them that are narrowest or have the least area."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that the points of one group are dealt to before its hull is put together.
PARTS = 64
_TIE = 1e-9


def hull(xy: np.ndarray) -> np.ndarray:
    """The corners of the hull, counter-clockwise from the least point on, without points inside its edges."""
    pts = np.unique(np.asarray(xy, float).reshape(-1, 2), axis=0)
    if len(pts) < 3:
        return pts

    def half(way):
        out: list = []
        for p in way:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    rows = [tuple(p) for p in pts]
    return np.array(half(rows)[:-1] + half(rows[::-1])[:-1])


def least_box(ring: np.ndarray, by: str = "area") -> tuple[np.ndarray, float, float]:
    """Corners (counter-clockwise, the first two on an edge of the hull), length along that edge, width across it. Among
    equal boxes the one on the first edge counts; two points have a box without width, one has a box without size."""
    if len(ring) < 3:
        a, b = ring[0], ring[-1]
        return np.array([a, b, b, a]), float(np.hypot(*(b - a))), 0.0
    d = np.roll(ring, -1, 0) - ring
    u = d / np.hypot(d[:, 0], d[:, 1])[:, None]
    n = np.column_stack([-u[:, 1], u[:, 0]])
    # The edges of a hull turn left all the way round, so the corner that lies farthest some way is found by its edges' angles.
    angle = np.arctan2(u[:, 1], u[:, 0])
    angle = angle[0] + np.mod(angle - angle[0], 2 * np.pi)
    far = lambda turn: ring[np.searchsorted(angle, angle[0] + np.mod(angle + turn - angle[0], 2 * np.pi) - _TIE) % len(ring)]
    along = lambda p: ((p - ring) * u).sum(1)
    hi, lo = along(far(np.pi / 2)), along(far(3 * np.pi / 2))
    width = ((far(np.pi) - ring) * n).sum(1)
    size = width if by == "width" else width * (hi - lo)
    k = int(np.argmax(size <= size.min() * (1 + _TIE)))
    a, b = ring[k] + u[k] * lo[k], ring[k] + u[k] * hi[k]
    return np.array([a, b, b + n[k] * width[k], a + n[k] * width[k]]), float(hi[k] - lo[k]), float(width[k])


def _fewer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for g, rows in b.groupby("gid", sort=False):
            h = hull(rows[["x", "y"]].to_numpy())
            yield pd.DataFrame({"gid": g, "x": h[:, 0], "y": h[:, 1]})


def hulls(points: DataFrame) -> DataFrame:
    """gid, ring (array of x, y; counter-clockwise from the least point on) of points gid, x, y. Points are thinned out to
    the hulls of batches where they are, then of parts of each group, and what is left meets by group: a task holds hulls
    only. Points with a null or non-finite coordinate are left out, as are points without a group and groups without points."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    own = points.select(F.col("gid").cast("long").alias("gid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    own = own.where(fine("x") & fine("y") & F.col("gid").isNotNull())
    thin = own.mapInPandas(_fewer, "gid long, x double, y double")
    parts = thin.withColumn("part", F.pmod(F.xxhash64("x", "y"), F.lit(PARTS))).repartition("gid", "part").drop("part").mapInPandas(_fewer, "gid long, x double, y double")

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        h = hull(rows[["x", "y"]].to_numpy())
        return pd.DataFrame({"gid": [key[0]], "ring": [[{"x": x, "y": y} for x, y in h]]})

    return parts.groupBy("gid").applyInPandas(whole, "gid long, ring array<struct<x: double, y: double>>")


def least_boxes(rings: DataFrame, by: str = "area") -> DataFrame:
    """gid, corners (array of x, y), length, width, area of the box about each hull (gid, ring) that has the least area or, by
    'width', is narrowest; one of its sides lies on an edge of the hull. Hulls without corners are left out."""
    if by not in ("area", "width"):
        raise ValueError(by)

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [least_box(np.array([(p["x"], p["y"]) for p in r]), by) for r in b["ring"]]
            yield pd.DataFrame({"gid": b["gid"], "corners": [[{"x": x, "y": y} for x, y in c] for c, _, _ in made], "length": [m[1] for m in made], "width": [m[2] for m in made], "area": [m[1] * m[2] for m in made]})

    return rings.where("size(ring) > 0").select("gid", "ring").mapInPandas(boxes, "gid long, corners array<struct<x: double, y: double>>, length double, width double, area double")
