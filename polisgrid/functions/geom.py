"""Planar and spatial formulas as column expressions. Points are structs of doubles x, y (and z)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length2(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def length3(a: Column, b: Column) -> Column:
    """Distance of two points (structs with x, y, z)."""
    return F.sqrt(F.pow(a["x"] - b["x"], F.lit(2.0)) + F.pow(a["y"] - b["y"], F.lit(2.0)) + F.pow(a["z"] - b["z"], F.lit(2.0)))


def point(x: Column, y: Column, z: Column | None = None, places: int = 6) -> Column:
    """A point rounded half to even, so that equal places are equal keys."""
    parts = [F.bround(x, places).alias("x"), F.bround(y, places).alias("y")]
    return F.struct(*parts, *([F.bround(z, places).alias("z")] if z is not None else []))


def segment(a: Column, b: Column) -> tuple[Column, Column]:
    """The two ends in order: direction isn't part of a segment's identity."""
    return F.least(a, b), F.greatest(a, b)


def signed_area(ring: Column) -> Column:
    """Shoelace area of a closed ring (array of points whose last equals the first)."""
    nxt = F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0)))
    head = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.aggregate(F.zip_with(head, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, v: s + v) / 2


def angle(ux: Column, uy: Column, uz: Column, vx: Column, vy: Column, vz: Column) -> Column:
    """Angle of two vectors in radians; the cosine is rounded to 9 places and clamped."""
    dot = ux * vx + uy * vy + uz * vz
    size = F.sqrt(ux * ux + uy * uy + uz * uz) * F.sqrt(vx * vx + vy * vy + vz * vz)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.bround(F.try_divide(dot, size), 9))))


def point_to_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column, Column]:
    """Nearest point (x, y) of a segment and its distance."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    x, y = ax + t * dx, ay + t * dy
    return x, y, length2(px, py, x, y)


def ray_hit(ox: Column, oy: Column, dx: Column, dy: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance along the unit ray (o, d) to the segment a-b; null if it misses."""
    ex, ey = bx - ax, by - ay
    cross = dx * ey - dy * ex
    t = F.try_divide((ax - ox) * ey - (ay - oy) * ex, cross)
    u = F.try_divide((ax - ox) * dy - (ay - oy) * dx, cross)
    return F.when((t >= 0) & (u >= 0) & (u <= 1), t)


def inside_ring(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point is inside a closed ring, by counting crossings of a ray to the right."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    edges = F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = a["x"] + F.try_divide((py - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"])
        return ((a["y"] > py) != (b["y"] > py)) & F.coalesce(px < at, F.lit(False))

    return F.size(F.filter(edges, crosses)) % 2 == 1


def minmax(value: Column, low: Column, high: Column) -> Column:
    """(value - low) / (high - low); null where all are equal."""
    return F.try_divide(value - low, high - low)


def inverse_score(x: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(1.0), x), F.lit(999999.0))


def legal_name(name: Column) -> Column:
    """A trimmed name that isn't empty and holds no character of file or query syntax."""
    return (F.length(F.trim(name)) > 0) & ~F.trim(name).rlike(r"[\\/:*?\"<>|'%;&]")


def round_half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("long")
