"""Urban design: sunlight, densities, building choice, floor programs, parcel cuts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Setback bands (half-open: over low, up to high) by floors of homes and by height of others, city places,
#: largest site, mixing coefficient, floor-area and density intervals of site types.
SETBACK_HOMES = ((0, 3, 3.0), (3, 33, 4.5), (33, 3_000_000, 6.5))
SETBACK_OTHER = ((0, 24, 3.0), (24, 100, 4.5), (100, 3_000_000, 6.5))
CITIES = {"BeiJing": (116.41667, 39.91667), "ShangHai": (121.43333, 34.5), "TianJin": (117.2, 39.13333), "ShenZhen": (114.06667, 22.61667)}
MAX_AREA = {"R": 72000.0, "C": 21000.0, "GIC": 30000.0, "M": 35000.0, "W": 42000.0}
MIX_COEFFICIENT = {"R": 1.2, "C": 0.8, "GIC": 1.5, "M": 0.6, "W": 0.6}
FAR_INTERVAL = {"R": (0.9, 6.0), "C": (1.8, 15.0), "GIC": (1.8, 6.0), "M": (1.2, 4.0), "W": (1.2, 4.0)}
DENSITY_INTERVAL = {"R": (0.1, 0.35), "C": (0.2, 0.6), "GIC": (0.2, 0.35), "M": (0.4, 0.65), "W": (0.4, 0.65)}
#: Canopies of trees in metres across, in the order in which they are planted.
TREE_CANOPIES = (3.0, 3.0, 3.0, 6.0, 6.0, 9.0)


def band(value: Column, bands: tuple[tuple[float, float, float], ...]) -> Column:
    """The value of the half-open band (over low, up to high); the second band's where none fits."""
    out = F.lit(bands[1][2])
    for low, high, then in reversed(bands):
        out = F.when((value > low) & (value <= high), F.lit(then)).otherwise(out)
    return out


def _solar(latitude: Column, longitude: Column, zone: float, year: int, month: int, day: int, hour: float) -> tuple[Column, Column]:
    """Altitude and azimuth (from north, clockwise) of the sun in radians, by the usual low-precision series."""
    y, m = (year - 1, month + 12) if month <= 2 else (year, month)
    julian = math.floor(365.25 * (y + 4716)) + math.floor(30.6001 * (m + 1)) + day + 2 - y // 100 + y // 400 - 1524.5 + (hour - zone) / 24
    c = (julian - 2451545) / 36525
    long = (280.46646 + c * (36000.76983 + c * 0.0003032)) % 360
    anomaly = math.radians(357.52911 + c * (35999.05029 - 0.0001537 * c))
    centre = math.sin(anomaly) * (1.914602 - c * (0.004817 + 0.000014 * c)) + math.sin(2 * anomaly) * (0.019993 - 0.000101 * c) + math.sin(3 * anomaly) * 0.000289
    node = math.radians(125.04 - 1934.136 * c)
    apparent = math.radians(long + centre - 0.00569 - 0.00478 * math.sin(node))
    tilt = math.radians(23 + (26 + (21.448 - c * (46.815 + c * (0.00059 - c * 0.001813))) / 60) / 60 + 0.00256 * math.cos(node))
    declination = math.asin(math.sin(tilt) * math.sin(apparent))
    e, v, l0 = 0.016708634 - c * (0.000042037 + 0.0000001267 * c), math.tan(tilt / 2) ** 2, math.radians(long)
    equation = 4 * math.degrees(v * math.sin(2 * l0) - 2 * e * math.sin(anomaly) + 4 * e * v * math.sin(anomaly) * math.cos(2 * l0) - v * v / 2 * math.sin(4 * l0) - 1.25 * e * e * math.sin(2 * anomaly))
    solar_time = F.lit(hour * 60 + equation - 60 * zone) + F.lit(4.0) * longitude
    turn = F.radians(solar_time / 4 - 180)
    lat = F.radians(latitude)
    height = F.asin(F.sin(lat) * math.sin(declination) + F.cos(lat) * math.cos(declination) * F.cos(turn))
    azimuth = F.atan2(F.sin(turn), F.cos(turn) * F.sin(lat) - F.lit(math.tan(declination)) * F.cos(lat)) + F.lit(math.pi)
    return height, azimuth


def sun_distance(height: Column, latitude: Column, longitude: Column | None = None, zone: float = 0.0, year: int = 2018, month: int = 12, day: int = 23, hour: float = 12.0) -> Column:
    """Length to the north of the shadow of a height; null when the sun is down. Without a longitude the hour is that of
    longitude 0, as for the distances between buildings: noon by the sun, but for the equation of time."""
    longitude = F.lit(0.0) if longitude is None else longitude
    up, around = _solar(latitude, longitude, zone, year, month, day, hour)
    return F.when(up > 0, height * F.abs(F.cos(around)) / F.tan(up))


def sun_hours(blocked: Column) -> Column:
    """Of 37 rays over six hours."""
    return F.lit(6.0) * (F.lit(37) - blocked) / F.lit(37.0)


#: Fixed values of homes in rows: depth of a building, most floors, part of a row that is built, and how much of the
#: sunlight distance a site loses at its ends.
ROW_DEPTH, MOST_FLOORS, BUILT, END_LOSS = 26.0, 45.0, 0.9, 1 - 2 / 3.0


def density_cap(far: Column, density: Column, edge: Column, per_floor: Column) -> tuple[Column, Column, Column]:
    """Floor-area ratio, density and least floors of a residential site. edge: the box's second edge; per_floor: the
    sunlight distance of one floor.

    Rows of n floors stand n * per_floor + ROW_DEPTH apart, so a site holds (edge + END_LOSS * n * per_floor) / that many,
    and its floor area ratio is BUILT * ROW_DEPTH * n * rows / edge. The cap is that of MOST_FLOORS; the least n that
    reaches a ratio solves n^2 + b n + c = 0.
    """
    shade = per_floor * MOST_FLOORS
    highest = F.lit(BUILT * ROW_DEPTH * MOST_FLOORS) * (edge + F.lit(END_LOSS) * shade) / (edge * (shade + F.lit(ROW_DEPTH)))
    ratio = F.least(far, highest)
    free = per_floor * END_LOSS
    b = edge / free - edge * ratio / (ROW_DEPTH * BUILT * END_LOSS)
    c = -edge * ratio / (free * BUILT)
    needed = F.greatest((F.sqrt(b * b - c * 4) - b) / 2, F.lit(ROW_DEPTH) / per_floor)
    floors = F.least(F.ceil(needed), F.lit(int(MOST_FLOORS))).cast("long")
    part = F.least(density, ratio / floors)
    return ratio, part, F.greatest(floors, F.bround(ratio / part, 0).cast("long"))


def refine_count(area: Column, largest: Column, mix: Column, coefficient: Column) -> Column:
    """Into how many parts a big site is cut."""
    return F.greatest(F.lit(1), F.bround(area / (largest / (F.lit(1.0) - mix * coefficient)), 0).cast("int"))


def override(base: DataFrame, given: DataFrame, key: str, columns: list[str], whole: bool = False) -> DataFrame:
    """base with the columns of given where these aren't null. whole: a column that is given must be given for every row."""
    if whole:
        both = base.select(key).join(given, key, "left").agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in columns)).first()
        short = [c for c in columns if 0 < both[c] < both["n"]]
        if short:
            raise ValueError(f"not given for every row: {', '.join(short)}")
    g = given.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return base.join(g, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def draw(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on seed and keys only, by a hash that other engines have, too."""
    text = F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def shuffled(rows: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Rows in an order that depends on seed and key only."""
    return rows.orderBy(draw(seed, F.col(key)), key)


def choose_types(sites: DataFrame, types: DataFrame, seed: int = 0, most: int = 3) -> DataFrame:
    """site_id, type: building types whose floor range holds the site's average floors, all if none does; of more
    than three, those first by hash."""
    both = sites.select("site_id", "kind", (F.col("far") / F.col("density")).alias("avg")).join(F.broadcast(types), "kind")
    fits = both.withColumn("fits", F.col("avg").between(F.col("floor_lo"), F.col("floor_hi")))
    some = fits.withColumn("any", F.max("fits").over(Window.partitionBy("site_id"))).where("fits or not any")
    w = Window.partitionBy("site_id").orderBy(draw(seed, F.col("site_id"), F.col("type")), "type")
    return some.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("site_id", "type")


def correct_floors(building: Column, outline: Column, bottom: Column, top: Column) -> Column:
    """Upper floors after the outline replaced the type's area; at least one floor in all."""
    more = top + F.bround(F.try_divide((building - outline) * (bottom + top), outline), 0).cast("long")
    more = F.greatest(more, F.lit(0))
    return F.when(bottom + more < 1, F.lit(1)).otherwise(more)


def building_parts(buildings: DataFrame, lower_factor: float = 1.2) -> DataFrame:
    """Two stacked parts of each building (building_id, kind, footprint, bottom, top, floor_height): building_id, part,
    function, area, height. The lower part is commerce; a part without floors is left out."""
    low = F.struct(F.lit(0).alias("part"), F.lit("C").alias("function"), F.col("bottom").alias("floors"), F.lit(lower_factor).alias("k"))
    high = F.struct(F.lit(1).alias("part"), F.col("kind").alias("function"), F.col("top").alias("floors"), F.lit(1.0).alias("k"))
    p = buildings.withColumn("p", F.explode(F.array(low, high))).where("p.floors > 0")
    return p.select("building_id", "p.part", "p.function", F.bround(F.col("footprint") * F.col("p.floors"), 3).alias("area"), F.bround(F.col("p.floors") * F.col("floor_height") * F.col("p.k"), 3).alias("height"))


def roll_up_buildings(buildings: DataFrame, sites: DataFrame) -> DataFrame:
    """site_id, density, far of sites (site_id, area) from buildings (site_id, footprint, area), to three places."""
    per = buildings.groupBy("site_id").agg(F.sum("footprint").alias("f"), F.sum("area").alias("a"))
    return sites.join(per, "site_id").select("site_id", F.bround(F.col("f") / F.col("area"), 3).alias("density"), F.bround(F.col("a") / F.col("area"), 3).alias("far"))


def offset_length(length: Column, k: Column, distance: Column) -> Column:
    """Perimeter of a polygon moved outwards; k sums (1 + cos) / sin over its corners."""
    return length + distance * k * 2


def offset_distance(length: Column, k: Column, area: Column, target: Column) -> Column:
    """How far to move outwards so that the area becomes target: k d^2 + length d + area = target."""
    root = F.sqrt(length * length + k * (target - area) * 4)
    return F.when(k == 0, F.try_divide(target - area, length)).otherwise((root - length) / (k * 2))


def count_program(areas: list[float], capacity: float) -> list[int]:
    """Counts n of buildings with the largest sum n * area not over capacity (ties: fewest buildings, then more of the
    earlier kinds). All zero becomes one of the first."""
    if not areas:
        return []
    total, counts = _sums(areas, [(0, max(0, int(capacity // a))) for a in areas], capacity)
    best = _best(total, counts)
    return best if any(best) else [1] + [0] * (len(areas) - 1)


def floor_program(footprints: list[float], ranges: list[tuple[int, int]], capacity: float) -> list[int]:
    """Floors within ranges with the largest sum floors * footprint not over capacity (ties: fewest floors, then more of
    the earlier kinds); where even the least floors are over it, these. 0 becomes 1."""
    total, counts = _sums(footprints, ranges, capacity)
    best = _best(total, counts) if len(total) else [r[0] for r in ranges]
    return [max(1, f) for f in best]


PROGRAM_HELD = 20_000_000  # combinations of a program that are weighed at once


def _sums(sizes: list[float], ranges: list[tuple[int, int]], capacity: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums not over capacity, and their counts, of all combinations within ranges; of the last kind only the largest count
    that fits."""
    total, counts = np.zeros(1), np.zeros((1, 0), np.int64)
    for k, (size, (low, high)) in enumerate(zip(sizes, ranges, strict=True)):
        if k < len(sizes) - 1:
            steps = np.arange(low, high + 1)
            if len(total) * len(steps) > PROGRAM_HELD:
                raise ValueError("too many combinations; use fewer kinds of buildings")
            counts = np.column_stack([np.repeat(counts, len(steps), axis=0), np.tile(steps, len(total))])
            total = (total[:, None] + steps * size).ravel()
            on = total <= capacity
        else:
            most = np.minimum(high, np.floor((capacity - total) / size).astype(np.int64))
            counts, total = np.column_stack([counts, most]), total + most * size
            on = most >= low
        total, counts = total[on], counts[on]
    return total, counts


def _best(total: np.ndarray, counts: np.ndarray) -> list[int]:
    near = counts[total >= total.max() - 1e-9]
    near = near[near.sum(1) == near.sum(1).min()]
    return list(max(map(tuple, near.tolist())))


def programs(sites: DataFrame) -> DataFrame:
    """site_id, k, count, floors from sites (site_id, capacity, floor_area, areas, floor_lo, floor_hi): building counts,
    then floors, of a few types. Rows are independent, so they are solved batch by batch."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                n = count_program(list(r.areas), r.capacity)
                f = floor_program([a * max(1, c) for a, c in zip(r.areas, n, strict=True)], list(zip(r.floor_lo, r.floor_hi, strict=True)), r.floor_area)
                out += [(r.site_id, k, c, x) for k, (c, x) in enumerate(zip(n, f, strict=True))]
            yield pd.DataFrame(out, columns=["site_id", "k", "count", "floors"])

    return sites.mapInPandas(run, "site_id long, k int, count int, floors int")


# --- parcel cuts --------------------------------------------------------------------------------------------

Ring = list[tuple[float, float]]


def ring_area(ring: Ring) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) / 2 if len(ring) > 2 else 0.0


def cut(ring: Ring, nx: float, ny: float, at: float) -> tuple[Ring, Ring]:
    """The parts with n . p <= at and >= at of a convex ring."""
    low, high = [], []
    for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
        s, t = nx * p[0] + ny * p[1] - at, nx * q[0] + ny * q[1] - at
        if s <= 0:
            low.append(p)
        if s >= 0:
            high.append(p)
        if s * t < 0:
            u = s / (s - t)
            x = (p[0] + u * (q[0] - p[0]), p[1] + u * (q[1] - p[1]))
            low.append(x)
            high.append(x)
    return low, high


def halve(ring: Ring, share: float) -> tuple[Ring, Ring]:
    """A convex ring cut across its longest direction so that the first part has the share of the area."""
    a, b = max(((p, q) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)), key=lambda e: (math.dist(*e), e))
    size = math.dist(a, b)
    ux, uy = (b[0] - a[0]) / size, (b[1] - a[1]) / size
    along = [ux * x + uy * y for x, y in ring]
    across = [-uy * x + ux * y for x, y in ring]
    if max(across) - min(across) > max(along) - min(along):
        ux, uy = -uy, ux
        along = across
    low, high, whole = min(along), max(along), abs(ring_area(ring))
    for _ in range(60):
        mid = (low + high) / 2
        if abs(ring_area(cut(ring, ux, uy, mid)[0])) < share * whole:
            low = mid
        else:
            high = mid
    return cut(ring, ux, uy, (low + high) / 2)


def halve_box(ring: Ring, share: float) -> tuple[Ring, Ring]:
    """A convex ring cut across its longest direction where its box has the share: no search, and areas only near it."""
    a, b = max(((p, q) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)), key=lambda e: (math.dist(*e), e))
    size = math.dist(a, b)
    ux, uy = (b[0] - a[0]) / size, (b[1] - a[1]) / size
    along, across = [ux * x + uy * y for x, y in ring], [-uy * x + ux * y for x, y in ring]
    if max(across) - min(across) > max(along) - min(along):
        ux, uy, along = -uy, ux, across
    return cut(ring, ux, uy, min(along) + share * (max(along) - min(along)))


def split_ring(ring: Ring, shares: list[float], halve=halve) -> list[tuple[int, Ring]]:
    """(number of share, part): shares, largest first, are halved into groups and the ring cut accordingly, by halve exactly or
    by halve_box nearly."""
    order = sorted(range(len(shares)), key=lambda k: (-shares[k], k))

    def go(part: Ring, who: list[int]) -> list[tuple[int, Ring]]:
        if len(who) == 1:
            return [(who[0], part)]
        half = len(who) // 2
        left, right = who[:half], who[half:]
        total = sum(shares[k] for k in who)
        a, b = halve(part, sum(shares[k] for k in left) / total)
        return go(a, left) + go(b, right)

    return sorted(go(ring, order))


def split_sites(sites: DataFrame) -> DataFrame:
    """site_id, k, area, shell of sites (site_id, shell of x, y; convex and open; shares)."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                ring = [(p["x"], p["y"]) for p in r.shell]
                out += [(r.site_id, k, abs(ring_area(x)), [{"x": a, "y": b} for a, b in x]) for k, x in split_ring(ring, list(r.shares))]
            yield pd.DataFrame(out, columns=["site_id", "k", "area", "shell"])

    return sites.mapInPandas(run, "site_id long, k int, area double, shell array<struct<x:double,y:double>>")


def place_trees(sites: DataFrame, share: float = 0.3) -> DataFrame:
    """site_id, n, x, y, radius: the trees of sites (site_id, shell: a convex open ring) in the middle of their own parts. The
    ring is split into a part for each canopy and one for the free land beside it."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                ring = [(p["x"], p["y"]) for p in r.shell]
                left, radii = abs(ring_area(ring)) * share, []
                while left > 1e-9:
                    radii.append(TREE_CANOPIES[len(radii) % len(TREE_CANOPIES)] / 2)
                    left -= math.pi * radii[-1] ** 2
                if not radii:
                    continue
                parts = split_ring(ring, [a for q in radii for a in (math.pi * q * q, math.pi * q * q * (1 - share) / share)])
                for n, (_, part) in enumerate(parts[::2]):
                    out.append((r.site_id, n, sum(p[0] for p in part) / len(part), sum(p[1] for p in part) / len(part), radii[n]))
            yield pd.DataFrame(out, columns=["site_id", "n", "x", "y", "radius"])

    return sites.select("site_id", "shell").mapInPandas(run, "site_id long, n long, x double, y double, radius double")


def courtyards(sites: DataFrame, seed: int = 0) -> DataFrame:
    """site_id, k, shell: the strips of courtyard_strips cut out of sites (site_id, shell: a convex open ring; width of the box;
    u0 and turn: where it begins in its direction, and that direction)."""
    strips = courtyard_strips(sites.select("site_id", "width"), seed).join(sites.select("site_id", "shell", "u0", "turn"), "site_id")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                c, s = math.cos(r.turn), math.sin(r.turn)
                part = cut(cut([(p["x"], p["y"]) for p in r.shell], c, s, r.u0 + r.x1)[0], c, s, r.u0 + r.x0)[1]
                if len(part) > 2:
                    out.append((r.site_id, r.k, [{"x": x, "y": y} for x, y in part]))
            yield pd.DataFrame(out, columns=["site_id", "k", "shell"])

    return strips.mapInPandas(run, "site_id long, k long, shell array<struct<x:double,y:double>>")


def refined(sites: DataFrame, setback_area: Column) -> DataFrame:
    """Sites (site_id, area, density, far, mix, kind) with the number of their parts, and density and floor-area ratio by the area
    within the setback, which their buildings have to stand on."""
    largest, coefficient = F.lit(None).cast("double"), F.lit(None).cast("double")
    for kind in MAX_AREA:
        largest = F.when(F.col("kind") == kind, F.lit(MAX_AREA[kind])).otherwise(largest)
        coefficient = F.when(F.col("kind") == kind, F.lit(MIX_COEFFICIENT[kind])).otherwise(coefficient)
    grow = F.try_divide(F.col("area"), setback_area)
    return sites.withColumns({"parts": refine_count(F.col("area"), largest, F.col("mix"), coefficient), "density": F.least(F.col("density") * grow, F.lit(1.0)), "far": F.col("far") * grow})


# --- numbers -----------------------------------------------------------------------------------------------------


def bisect(f, low: float, high: float, tolerance: float = 1e-9, most: int = 200) -> float:
    """A root of f between two places where its signs differ."""
    a, b = f(low), f(high)
    if a * b > 0:
        raise ValueError("the signs do not differ")
    for _ in range(most):
        mid = (low + high) / 2
        m = f(mid)
        if m == 0 or high - low < tolerance:
            return mid
        low, high, a = (mid, high, m) if (m > 0) == (a > 0) else (low, mid, a)
    return (low + high) / 2


def newton(f, slope, start: float, tolerance: float = 1e-12, most: int = 100) -> float:
    """A root of f from its slope; raises if the steps do not settle."""
    x = start
    for _ in range(most):
        step = f(x) / slope(x)
        x -= step
        if abs(step) < tolerance:
            return x
    raise ValueError("no root was found")


def quadratic(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Roots of a x^2 + b x + c, the smaller first; null where there is none. A root of a line comes twice."""
    gap = b * b - a * c * 4
    root = F.when(gap >= 0, F.sqrt(F.greatest(gap, F.lit(0.0))))
    line = F.try_divide(-c, b)
    x, y = F.try_divide(-b - root, a * 2), F.try_divide(-b + root, a * 2)
    both = x.isNotNull() & y.isNotNull()  # least and greatest pass over nulls
    return F.when(a == 0, line).when(both, F.least(x, y)), F.when(a == 0, line).when(both, F.greatest(x, y))


def parabola(p: tuple[float, float], q: tuple[float, float], r: tuple[float, float]) -> tuple[float, float, float]:
    """a, b, c of y = a x^2 + b x + c through three points of different x."""
    a, b, c = np.linalg.solve(np.array([[x * x, x, 1.0] for x, _ in (p, q, r)]), np.array([y for _, y in (p, q, r)]))
    return float(a), float(b), float(c)


def trees(sites: DataFrame, share: Column) -> DataFrame:
    """site_id, n, radius: canopies of cycling sizes until they cover the share of a site's area. The sizes of a whole
    cycle have a fixed area, so the number follows without a loop."""
    circle = [math.pi * (s / 2) ** 2 for s in TREE_CANOPIES]
    cycle = sum(circle)
    want = F.col("area") * share
    full = F.floor(want / cycle).cast("long")
    rest = want - full * F.lit(cycle)
    partial, total = F.lit(0), 0.0
    for a in circle:
        partial = partial + F.when(rest > F.lit(total) + F.lit(1e-9), F.lit(1)).otherwise(F.lit(0))
        total += a
    n = full * len(circle) + partial
    one = sites.withColumn("count", n).where("count > 0").withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    return one.select("site_id", "n", F.element_at(F.array(*[F.lit(s / 2) for s in TREE_CANOPIES]), (F.col("n") % len(TREE_CANOPIES) + 1).cast("int")).alias("radius"))


def courtyard_strips(sites: DataFrame, seed: int = 0) -> DataFrame:
    """site_id, k, x0, x1: strips 16 to 24 wide along the width of a site; first and last are dropped."""
    most = F.ceil(F.col("width") / 16).cast("int")
    s = sites.withColumn("k", F.explode(F.sequence(F.lit(0), most)))
    s = s.withColumn("w", F.lit(16.0) + draw(seed, F.col("site_id"), F.col("k")) * 8)
    w = Window.partitionBy("site_id").orderBy("k")
    s = s.withColumn("x1", F.sum("w").over(w)).withColumn("x0", F.col("x1") - F.col("w")).where(F.col("x0") < F.col("width"))
    s = s.withColumn("last", F.max("k").over(Window.partitionBy("site_id"))).where("k > 0 and k < last")
    return s.select("site_id", F.col("k").cast("long").alias("k"), "x0", "x1")


# --- sites and whole designs -------------------------------------------------------------------------------------


def orientation(ring: Column) -> Column:
    """Direction of the longest edge of a closed ring (the first of equal ones), folded to -pi/4..pi/4."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    edges = F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")))
    sized = F.transform(edges, lambda e, i: F.struct(F.bround(F.sqrt(e["x"] * e["x"] + e["y"] * e["y"]), 6).alias("l"), (-i).alias("i"), e.alias("e")))
    longest = F.array_max(sized)["e"]
    turn = F.atan2(longest["y"], longest["x"])
    return turn - F.lit(math.pi / 2) * F.ceil(turn / F.lit(math.pi / 2) - F.lit(0.5) - F.lit(1e-9))


def box_edges(ring: Column, turn: Column) -> Column:
    """The middles of the four edges of the box of a ring in that direction: below, right, above, left."""
    c, s = F.cos(turn), F.sin(turn)
    u = F.transform(ring, lambda p: p["x"] * c + p["y"] * s)
    v = F.transform(ring, lambda p: p["y"] * c - p["x"] * s)
    u0, u1, v0, v1 = F.array_min(u), F.array_max(u), F.array_min(v), F.array_max(v)
    at = lambda a, b: F.struct((a * c - b * s).alias("x"), (a * s + b * c).alias("y"))
    mu, mv = (u0 + u1) / 2, (v0 + v1) / 2
    return F.array(at(mu, v0), at(u1, mv), at(mu, v1), at(u0, mv))


def _by_kind(kind: Column, table: dict[str, tuple[float, float]], k: int) -> Column:
    out = F.lit(None).cast("double")
    for name, pair in table.items():
        out = F.when(kind == name, F.lit(pair[k])).otherwise(out)
    return out


def site_parameters(sites: DataFrame, seed: int = 0, most_mix: float = 0.3) -> DataFrame:
    """site_id, turn, needles (middles of the box's edges), kind, density, far, mix of sites (site_id, shell: a closed ring).

    Kind, density and floor-area ratio are drawn within the intervals of their kind, each from its own draw."""
    kinds = list(FAR_INTERVAL)
    s = sites.select("site_id", orientation(F.col("shell")).alias("turn"), "shell")
    s = s.withColumn("needles", box_edges(F.col("shell"), F.col("turn")))
    own = lambda k: draw(seed, F.col("site_id"), F.lit(k))
    s = s.withColumn("kind", F.element_at(F.array(*map(F.lit, kinds)), F.floor(own(0) * len(kinds)).cast("int") + 1))
    within = lambda table, k: _by_kind(F.col("kind"), table, 0) + own(k) * (_by_kind(F.col("kind"), table, 1) - _by_kind(F.col("kind"), table, 0))
    return s.select("site_id", "turn", "needles", "kind", within(DENSITY_INTERVAL, 1).alias("density"), within(FAR_INTERVAL, 2).alias("far"), (own(3) * most_mix).alias("mix"))


def mix_class(mix: Column) -> Column:
    """How uses mix: none up to 0.05, in one building up to 0.12, side by side beyond."""
    return F.when(mix <= 0.05, "none").when(mix <= 0.12, "vertical").otherwise("horizontal")


def row_layout(sites: DataFrame, ends: float = 1 / 3.0) -> DataFrame:
    """Rows of homes on sites (site_id, along, across, turn, far_area, type, area, storey, depth_lo, depth_hi, latitude,
    floor_lo): for each type the least floors, up to MOST_FLOORS, with which the rows hold enough buildings; of these the
    type whose floors are closest to the site's average (avg_floors; ties: first name).

    along and across are the setback's box edges. Rows stand a sunlight distance apart; their depth fills the site within
    the type's range, and a building's width is its area over that depth.
    """
    most = int(MOST_FLOORS)
    s = sites.withColumn("floors", F.explode(F.sequence(F.greatest(F.col("floor_lo"), F.lit(1)), F.lit(most))))
    c = F.col
    sun = sun_distance(c("storey") * c("floors"), c("latitude")) * F.cos("turn")
    s = s.withColumn("sun", sun)
    lost = F.lit(2 * ends - 1) * c("sun")
    rows = lambda depth: F.floor((c("across") - lost) / (c("sun") + depth)).cast("long")
    s = s.withColumn("n", rows((c("depth_lo") + c("depth_hi")) / 2)).where("n > 0")
    depth = F.bround((c("across") - lost * F.cos("turn")) / c("n") - c("sun") * F.cos("turn"), 3)
    s = s.withColumn("free", depth).withColumn("depth", F.greatest("depth_lo", F.least("depth_hi", "free")))
    s = s.withColumn("rows", F.when(c("free") == c("depth"), c("n")).otherwise(rows(c("depth")))).where("rows > 0")
    s = s.withColumn("width", F.bround(c("area") / c("depth"), 2))
    gap = band(c("floors"), SETBACK_HOMES) * 2
    s = s.withColumn("per_row", F.floor((c("along") + gap) / (c("width") + gap)).cast("long")).where("per_row > 0")
    need = F.ceil(c("far_area") / (c("area") * c("floors"))).cast("long")
    s = s.withColumn("count", F.greatest(need, F.lit(1))).where(c("rows") * c("per_row") >= c("count"))
    first = s.groupBy("site_id", "type").agg(F.min(F.struct("floors", "rows", "per_row", "depth", "width", "count", "avg_floors")).alias("m"))
    away = F.abs(c("m.floors") - c("m.avg_floors"))
    best = first.groupBy("site_id").agg(F.min(F.struct(away.alias("away"), c("type"), c("m"))).alias("b"))
    return best.select("site_id", "b.type", "b.m.floors", "b.m.rows", "b.m.per_row", "b.m.depth", "b.m.width", "b.m.count")


def non_residential(sites: DataFrame) -> DataFrame:
    """site_id, part, k, count, bottom, top of the buildings of sites (site_id, kind, area, density, far, mix, main and other:
    areas of the kinds' building types, main_lo, main_hi, other_lo, other_hi: their floors).

    By the class of the mix: none, one program; vertical, counts of the whole site and floors of both parts; horizontal,
    the site is shared and each share has its own program. A site whose program fails gets a row with its error instead.
    """

    def one(areas, low, high, land, built):
        n = count_program(list(areas), land)
        sizes = [a * max(1, c) for a, c in zip(areas, n, strict=True)]
        return n, floor_program(sizes, list(zip(low, high, strict=True)), built)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    mixed = "none" if r.mix <= 0.05 else "vertical" if r.mix <= 0.12 else "horizontal"
                    built, land = r.far * r.area, r.density * r.area
                    part = r.mix * MIX_COEFFICIENT[r.kind]
                    if mixed == "horizontal":
                        n, f = one(r.main, r.main_lo, r.main_hi, land * (1 - part), built * (1 - r.mix))
                        rows = [("main", k, c, 0, x) for k, (c, x) in enumerate(zip(n, f, strict=True))]
                        n, f = one(r.other, r.other_lo, r.other_hi, land * part, built * r.mix)
                        rows += [("other", k, c, 0, x) for k, (c, x) in enumerate(zip(n, f, strict=True))]
                    else:
                        n, f = one(r.main, r.main_lo, r.main_hi, land, built * (1 - r.mix if mixed == "vertical" else 1))
                        low = [0] * len(n)
                        if mixed == "vertical":
                            low = one(r.main, [0] * len(n), r.main_hi, land, built * r.mix)[1]
                        rows = [("main", k, c, b, x) for k, (c, b, x) in enumerate(zip(n, low, f, strict=True))]
                    out += [(r.site_id, *row, None) for row in rows]
                except (KeyError, ValueError, TypeError) as error:
                    out.append((r.site_id, None, None, None, None, None, str(error)))
            yield pd.DataFrame(out, columns=["site_id", "part", "k", "count", "bottom", "top", "error"]).astype({c: "Int64" for c in ("k", "count", "bottom", "top")})

    return sites.mapInPandas(run, "site_id long, part string, k long, count long, bottom long, top long, error string")


def place_boxes(setbacks: DataFrame) -> DataFrame:
    """site_id, k, shell: count rectangles (width by depth) in rows on the box of a site (site_id, x0, y0, turn, along, across,
    rows, per_row, width, depth, count), the rows from below, evenly apart, and a row's buildings from the left."""
    s = setbacks.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count").cast("long") - 1)))
    c = F.col
    row, place = F.floor(c("k") / c("per_row")), c("k") % c("per_row")
    gap = lambda whole, size, n: F.when(n > 1, (whole - n * size) / (n - 1)).otherwise(F.lit(0.0))
    u = place * (c("width") + gap(c("along"), c("width"), c("per_row")))
    v = row * (c("depth") + gap(c("across"), c("depth"), c("rows")))
    co, si = F.cos("turn"), F.sin("turn")
    at = lambda a, b: F.struct((c("x0") + a * co - b * si).alias("x"), (c("y0") + a * si + b * co).alias("y"))
    ring = F.array(at(u, v), at(u + c("width"), v), at(u + c("width"), v + c("depth")), at(u, v + c("depth")), at(u, v))
    return s.select("site_id", "k", ring.alias("shell"))


def fillet(ring: Column, radius: float, steps: int = 4) -> Column:
    """A closed convex ring whose corners are arcs of so many pieces; an arc takes at most half of either edge."""
    n = F.size(ring) - 1
    open_ = F.slice(ring, F.lit(1), n)
    at = lambda k: F.element_at(open_, (F.pmod(k, n) + 1).cast("int"))

    def corner(p: Column, i: Column) -> Column:
        a, b = at(i + n - 1), at(i + 1)
        ux, uy, vx, vy = a["x"] - p["x"], a["y"] - p["y"], b["x"] - p["x"], b["y"] - p["y"]
        lu, lv = F.sqrt(ux * ux + uy * uy), F.sqrt(vx * vx + vy * vy)
        half = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / (lu * lv)))) / 2
        cut = F.least(F.lit(float(radius)) / F.tan(half), lu / 2, lv / 2)
        r = cut * F.tan(half)
        bx, by = ux / lu + vx / lv, uy / lu + vy / lv
        far = F.sqrt(bx * bx + by * by)
        cx, cy = p["x"] + bx / far * r / F.sin(half), p["y"] + by / far * r / F.sin(half)
        first = F.atan2(p["y"] + uy / lu * cut - cy, p["x"] + ux / lu * cut - cx)
        last = F.atan2(p["y"] + vy / lv * cut - cy, p["x"] + vx / lv * cut - cx)
        turn = last - first
        turn = turn - F.lit(2 * math.pi) * F.round(turn / F.lit(2 * math.pi))
        return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: F.struct((cx + r * F.cos(first + turn * k / steps)).alias("x"), (cy + r * F.sin(first + turn * k / steps)).alias("y")))

    flat = F.flatten(F.transform(open_, corner))
    return F.concat(flat, F.slice(flat, 1, 1))


def whole_design(sites: DataFrame, homes: DataFrame, others: DataFrame) -> DataFrame:
    """site_id, building_id, kind, footprint, bottom, top, floor_height, error of the buildings of sites.

    sites: the columns that row_layout and non_residential need of a site; homes: type, area, storey, depth_lo, depth_hi,
    floor_lo; others: kind, areas, lo, hi, storey (one row a kind; of several the least counts). Homes stand in rows,
    other uses by their programs; a site that cannot be designed, has no kind, or a kind without building types, has one
    row with an error and no building.
    """
    c = F.col
    rows = sites.where("kind = 'R'").join(F.broadcast(homes)).withColumns({"far_area": c("far") * c("site_area"), "avg_floors": c("far") / c("density")})
    laid = row_layout(rows).join(F.broadcast(homes.select("type", "area", "storey")), "type")
    numbered = laid.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), c("count") - 1)))
    none = F.lit(None).cast("string").alias("error")
    first = numbered.select("site_id", "k", F.lit("R").alias("kind"), c("area").alias("footprint"), F.lit(0).cast("long").alias("bottom"), c("floors").cast("long").alias("top"), c("storey").alias("floor_height"), none)
    blank = [F.lit(None).cast(t).alias(n) for n, t in (("k", "long"), ("kind", "string"), ("footprint", "double"), ("bottom", "long"), ("top", "long"), ("floor_height", "double"))]
    left = sites.where("kind = 'R'").select("site_id").join(laid.select("site_id"), "site_id", "left_anti")
    failed = left.select("site_id", *blank, F.lit("no row of homes fits").alias("error"))
    # One row a kind: of several the least.
    types = others.groupBy("kind").agg(F.min(F.struct("areas", "lo", "hi", "storey")).alias("v"))
    none_ = lambda name, of: F.coalesce(c(name), F.array().cast(of))
    shops = types.where("kind = 'C'").select(c("v.areas").alias("other"), c("v.lo").alias("other_lo"), c("v.hi").alias("other_hi"))
    own = types.select("kind", c("v.areas").alias("main"), c("v.lo").alias("main_lo"), c("v.hi").alias("main_hi"), "v.storey")
    # Left joins: a site of no kind, or of a kind without building types, keeps its row.
    rest = sites.where("kind is null or kind != 'R'").join(F.broadcast(own), "kind", "left").join(F.broadcast(shops), F.lit(True), "left")
    rest = rest.withColumns({"other": none_("other", "array<double>"), "other_lo": none_("other_lo", "array<int>"), "other_hi": none_("other_hi", "array<int>")})
    why = F.when(c("kind").isNull(), "no kind").when(c("main").isNull() | (F.size("main") < 1), "no building types of this kind")
    why = why.when((mix_class(c("mix")) == "horizontal") & (F.size("other") == 0), "no building types of the other kind")
    judged = rest.withColumn("why", why)
    unknown = judged.where("why is not null").select("site_id", *blank, c("why").alias("error"))
    rest = judged.where("why is null").drop("why")
    program = non_residential(rest.select("site_id", "kind", c("site_area").alias("area"), "density", "far", "mix", "main", "main_lo", "main_hi", "other", "other_lo", "other_hi"))
    both = program.join(rest.select("site_id", "kind", "main", "other", "storey"), "site_id")
    size = F.element_at(F.when(c("part") == "main", c("main")).otherwise(c("other")), (c("k") + 1).cast("int"))
    copies = both.where("error is null and count > 0").withColumn("footprint", size).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), c("count") - 1)))
    use = F.when(c("part") == "main", c("kind")).otherwise("C")
    # Part, type and copy side by side in the bits of a number, so that none runs into another.
    number = F.shiftleft(F.when(c("part") == "main", F.lit(0)).otherwise(F.lit(1)).cast("long"), 56) + F.shiftleft(c("k").cast("long"), 40) + c("copy")
    second = copies.select("site_id", number.cast("long").alias("k"), use.alias("kind"), "footprint", "bottom", "top", c("storey").alias("floor_height"), none)
    wrong = program.where("error is not null").select("site_id", *blank, "error").unionByName(unknown)
    return first.unionByName(failed).unionByName(second).unionByName(wrong).withColumnRenamed("k", "building_id")
