"""First hits of rays on triangles, by a tree of boxes."""

from __future__ import annotations

import numpy as np

_FAN = 8  # children of a box, and triangles of a leaf
_PAIRS = 1 << 20  # pairs of rays and boxes that are held at once


def _interleaved(at: np.ndarray) -> np.ndarray:
    """Places in the unit cube as numbers along a curve that keeps near places near."""
    out = np.zeros(len(at), np.uint64)
    q = (np.clip(at, 0, 1) * 1023).astype(np.uint64)
    for bit in range(10):
        for k in range(3):
            out |= ((q[:, k] >> np.uint64(bit)) & np.uint64(1)) << np.uint64(3 * bit + k)
    return out


class Tree:
    """Boxes over triangles (n, 3, 3): eight neighbours along the curve to a box, eight boxes to one of the next level."""

    def __init__(self, tri: np.ndarray):
        low, high = tri.min(1), tri.max(1)
        middle = (low + high) / 2
        size = np.maximum(np.ptp(middle, axis=0), 1e-12) if len(tri) else np.ones(3)
        self.order = np.argsort(_interleaved((middle - middle.min(0)) / size), kind="stable") if len(tri) else np.zeros(0, np.int64)
        self.tri = tri[self.order]
        self.e1, self.e2 = self.tri[:, 1] - self.tri[:, 0], self.tri[:, 2] - self.tri[:, 0]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        low, high = low[self.order], high[self.order]
        while len(low):
            at = np.arange(0, len(low), _FAN)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((low - 1e-9, high + 1e-9))
            if len(low) == 1:
                break

    def first(self, origins: np.ndarray, directions: np.ndarray, most: np.ndarray | float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Distance to, and number of, the first triangle within most that each ray meets; inf and -1 if none. Of several at
        one distance the smallest number counts."""
        best, who = np.full(len(origins), np.inf), np.full(len(origins), -1)
        if not len(self.order):
            return best, who
        most = np.broadcast_to(np.asarray(most, float), len(origins))
        step = 4096
        for at in range(0, len(origins), step):
            self._some(origins[at : at + step], directions[at : at + step], most[at : at + step], best[at : at + step], who[at : at + step])
        return best, who

    def _some(self, o: np.ndarray, d: np.ndarray, most: np.ndarray, best: np.ndarray, who: np.ndarray) -> None:
        with np.errstate(divide="ignore"):
            inverse = 1 / d
        todo = [(np.arange(len(o)), np.zeros(len(o), np.int64), len(self.levels) - 1)]
        while todo:
            ray, box, level = todo.pop()
            if len(ray) > _PAIRS // _FAN:  # one part after another, so that pairs stay few
                half = len(ray) // 2
                todo += [(ray[half:], box[half:], level), (ray[:half], box[:half], level)]
                continue
            low, high = self.levels[level]
            with np.errstate(invalid="ignore"):
                a, b = (low[box] - o[ray]) * inverse[ray], (high[box] - o[ray]) * inverse[ray]
            near, far = np.fmin(a, b).max(1), np.fmax(a, b).min(1)
            flat = (d[ray] == 0) & ((o[ray] < low[box]) | (o[ray] > high[box]))
            hit = (far >= np.maximum(near, 0)) & (near <= np.minimum(best[ray], most[ray]) + 1e-8) & ~flat.any(1)
            ray, box = ray[hit], box[hit]
            if not len(ray):
                continue
            n = len(self.tri) if level == 0 else len(self.levels[level - 1][0])
            child = (box[:, None] * _FAN + np.arange(_FAN)).ravel()
            ray = np.repeat(ray, _FAN)
            ray, child = ray[child < n], child[child < n]
            if level:
                todo.append((ray, child, level - 1))
            else:
                self._meet(ray, child, o, d, most, best, who)

    def _meet(self, ray: np.ndarray, k: np.ndarray, o: np.ndarray, d: np.ndarray, most: np.ndarray, best: np.ndarray, who: np.ndarray) -> None:
        h = np.cross(d[ray], self.e2[k])
        det = (h * self.e1[k]).sum(1)
        safe = np.where(np.abs(det) > 1e-12, det, np.inf)
        s = o[ray] - self.tri[k, 0]
        u = (s * h).sum(1) / safe
        q = np.cross(s, self.e1[k])
        v = (d[ray] * q).sum(1) / safe
        t = np.round((self.e2[k] * q).sum(1) / safe, 9)  # so that triangles in one place are at one distance
        ok = np.isfinite(safe) & (u >= -1e-9) & (v >= -1e-9) & (u + v <= 1 + 1e-9) & (t > 1e-9) & (t <= most[ray])
        ray, t, own = ray[ok], t[ok], self.order[k[ok]]
        order = np.lexsort((own, t, ray))
        ray, t, own = ray[order], t[order], own[order]
        new = np.append(True, ray[1:] != ray[:-1]) if len(ray) else np.zeros(0, bool)
        ray, t, own = ray[new], t[new], own[new]
        better = (t < best[ray]) | (t == best[ray]) & (own < who[ray])
        best[ray[better]], who[ray[better]] = t[better], own[better]
