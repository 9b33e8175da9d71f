"""Hulls and boxes against plain Python."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from polisgrid.operators import hulls


def _turned(pts, by):
    """Length along by, width across it, of points."""
    u = np.array(by, float) / math.hypot(*by)
    a, b = pts @ u, pts @ np.array([-u[1], u[0]])
    return np.ptp(a), np.ptp(b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=1, max_size=40))
def test_boxes_of_hulls(pts):
    p = np.array(pts, float)
    ring = hulls.hull(p)
    assert {tuple(r) for r in ring} <= {tuple(r) for r in p} and tuple(ring[0]) == min(map(tuple, p))
    ends = list(zip(ring, np.roll(ring, -1, 0), strict=True))
    if len(ring) > 2:
        for a, b in ends:
            cross = (b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0])
            assert (cross >= 0).all()
    for by in ("area", "width"):
        corners, length, width = hulls.least_box(ring, by)
        if len(ring) < 3:
            assert width == 0 and length == pytest.approx(max(math.dist(a, b) for a in p for b in p))
            continue
        sizes = [_turned(p, b - a) for a, b in ends]
        best = min(l * w if by == "area" else w for l, w in sizes)  # noqa: E741
        assert (length * width if by == "area" else width) == pytest.approx(best)
        assert np.linalg.norm(corners[1] - corners[0]) == pytest.approx(length) and np.linalg.norm(corners[2] - corners[1]) == pytest.approx(width)
        u, n = (corners[1] - corners[0]) / length, (corners[3] - corners[0]) / width
        for axis, most in ((u, length), (n, width)):
            at = (p - corners[0]) @ axis
            assert at.min() >= -1e-9 and at.max() <= most + 1e-9


def test_groups_of_any_size(spark):
    draw = random.Random(1)
    rows = [(k % 3, draw.gauss(0, 1), draw.gauss(0, 2)) for k in range(30_000)] + [(7, 1.0, 2.0)] * 3 + [(8, 0.0, 0.0), (8, 3.0, 4.0), (8, 1.5, 2.0)]
    odd = [(9, None, 1.0), (9, float("nan"), 1.0), (None, 1.0, 1.0), (0, float("inf"), 0.0)]
    points = spark.createDataFrame([*rows, *odd], "gid long, x double, y double").withColumns({"part": F.lit("a"), "ring": F.lit(1)}).repartition(7)
    got = {r.gid: [(p.x, p.y) for p in r.ring] for r in hulls.hulls(points).collect()}
    assert set(got) == {0, 1, 2, 7, 8} and got[7] == [(1.0, 2.0)] and got[8] == [(0.0, 0.0), (3.0, 4.0)]
    for g in range(3):
        assert got[g] == [tuple(p) for p in hulls.hull(np.array([r[1:] for r in rows if r[0] == g]))]
    boxes = {r.gid: r for r in hulls.least_boxes(hulls.hulls(points), "width").collect()}
    assert (boxes[8].length, boxes[8].width, boxes[8].area) == (5.0, 0.0, 0.0) and boxes[7].length == 0
    assert hulls.hulls(points.limit(0)).isEmpty() and hulls.least_boxes(hulls.hulls(points.limit(0))).isEmpty()
    with pytest.raises(ValueError, match="length"):
        hulls.least_boxes(hulls.hulls(points), "length")
