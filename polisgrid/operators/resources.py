"""Energy, water, waste and population of buildings, and the carbon that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polisgrid.functions.geom import round_half_even

#: Hours and days of a year, and factors of the formulas.
HOURS, DAYS = 8766.0, 365.25
ENERGY_CARBON = 0.75
WASTE_CARBON = {0: 2.13, 1: 0.321, 2: 0.12}


BANDS_HELD = 1000


def _mid(low: Column, high: Column) -> Column:
    return (low + high) / F.lit(2.0)


def consumption(parts: DataFrame, coefficients: DataFrame, scale: float) -> DataFrame:
    """parts (function, amount, ...) with lo, hi (half to even) and use = their middle times scale.

    coefficients: function, lo_rate, hi_rate; one row a function. A function without coefficients raises at run time.
    """
    both = parts.join(coefficients, "function", "left")
    rate = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit("no coefficients for "), F.coalesce("function", F.lit("null")))).cast("double")).otherwise(F.col(c))
    out = both.withColumn("lo", round_half_even(F.col("amount") * rate("lo_rate"))).withColumn("hi", round_half_even(F.col("amount") * rate("hi_rate")))
    return out.withColumn("use", _mid(F.col("lo"), F.col("hi")) * F.lit(scale)).drop("lo_rate", "hi_rate")


def energy(parts: DataFrame, coefficients: DataFrame) -> DataFrame:
    return consumption(parts, coefficients, HOURS)


def water(parts: DataFrame, coefficients: DataFrame) -> DataFrame:
    return consumption(parts, coefficients, DAYS * 0.001)


def waste(people: DataFrame, coefficients: DataFrame) -> DataFrame:
    """amount is the number of people."""
    return consumption(people, coefficients, DAYS * 0.001)


def energy_carbon(kwh: Column) -> Column:
    return F.lit(ENERGY_CARBON) * kwh * F.lit(0.001)


def waste_carbon(tonnes: Column, method: Column) -> Column:
    """By treatment: 0 landfill, 1 incineration, 2 compost; other methods 0."""
    out = F.lit(0.0)
    for code, factor in WASTE_CARBON.items():
        out = F.when(method == code, tonnes * F.lit(factor)).otherwise(out)
    return out


def storeys(height: Column, storey: float = 3.0) -> Column:
    return F.ceil(height / F.lit(storey)).cast("long")


def population(buildings: DataFrame, bands: DataFrame) -> DataFrame:
    """buildings (area, floors, ...) with the band of their floors (type, closed interval; the first that fits, the
    last one above all) and people = area / square metres per person. bands: type, floor_lo, floor_hi, per_person.

    bands is a dimension of a few rows: collected once, it becomes one CASE expression without any join. More than
    BANDS_HELD rows raise.
    """
    rows = bands.orderBy("type").limit(BANDS_HELD + 1).collect()
    if not 0 < len(rows) <= BANDS_HELD:
        raise ValueError(f"population takes 1 to {BANDS_HELD} bands")
    area = F.col("area")
    last = rows[-1]
    kind, per = F.lit(None).cast("int"), F.lit(None).cast("double")
    kind = F.when(F.col("floors") > last["floor_hi"], F.lit(last["type"])).otherwise(kind)
    per = F.when(F.col("floors") > last["floor_hi"], F.lit(float(last["per_person"]))).otherwise(per)
    for r in reversed(rows):
        fits = F.col("floors").between(r["floor_lo"], r["floor_hi"])
        kind, per = F.when(fits, F.lit(r["type"])).otherwise(kind), F.when(fits, F.lit(float(r["per_person"]))).otherwise(per)
    return buildings.withColumn("band", kind).withColumn("people", round_half_even(area / per))


def roll_up(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of lo and hi by keys, and their middle by integer division."""
    out = parts.groupBy(*keys).agg(F.sum("lo").alias("lo"), F.sum("hi").alias("hi"))
    return out.withColumn("mid", F.expr("(lo + hi) div 2"))


def custom(parts: DataFrame, coefficients: DataFrame) -> DataFrame:
    """lo, hi in base units, not scaled, of buildings (function, base, zmin, zmax): storeys of 3 metres from the lowest point
    to the highest, which is at least 0, times the base area and the rates."""
    floors = storeys(F.greatest(F.col("zmax"), F.lit(0.0)) - F.col("zmin"))
    return consumption(parts.withColumn("amount", F.col("base") * floors), coefficients, 1.0).withColumnRenamed("use", "mid")


def by_block(blocks: DataFrame, coefficients: DataFrame) -> DataFrame:
    """lo, hi of blocks (block_id, landuse, area): area times the rates of the use, not rounded."""
    rates = coefficients.select(F.col("function").alias("landuse"), "lo_rate", "hi_rate")
    return blocks.join(rates, "landuse").select("block_id", "landuse", (F.col("area") * F.col("lo_rate")).alias("lo"), (F.col("area") * F.col("hi_rate")).alias("hi"))
