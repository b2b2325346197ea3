"""Features of what lies within a radius, by an equi-join on grid cells.

The sphere is cut into bands of latitude a radius high, and each band into cells at least a radius wide. A row of the left side looks into
its own cell and those around it; the right side has one cell for each row. Cells that wrap around the date line meet.

Distances are those between different places: rows of one place are counted before the join, and what a place finds goes to all its rows.
"""

import math

from pyspark.sql import functions as F

from ..boundary import AS_OF, q
from ..functions.aggregations import EARTH_M, haversine

DEGREE_M = math.pi * EARTH_M / 180


def bands(within):
    """Height of a band in degrees."""
    return min(180.0, within / DEGREE_M * 1.000001)


def cells_of(band, lon, within):
    """(number of cells around a band, cell of a longitude): cells are wide enough at the band's edge farthest from the equator."""
    h = bands(within)
    edge = F.least(F.lit(90.0), F.greatest(F.abs(band * h - 90.0), F.abs((band + 1) * h - 90.0)))
    around = F.greatest(F.lit(1), F.floor(F.cos(F.radians(edge)) * (2 * math.pi * EARTH_M) / (within * 1.6))).cast("long")
    return around, F.pmod(F.floor((lon + 180.0) / 360.0 * around).cast("long"), around)


def features(c, entity, spec, columns):
    """Rows (__node, as_of_date where the right side has a time, features), one for each left id; without neighbours the count is 0."""
    right = c.planner.graph.entities[spec.right]
    if not (entity.lat and entity.lon and right.lat and right.lon and right.id):
        raise ValueError(f"{spec.name}: both sides of a spatial relationship need an id, lat and lon")
    at = [AS_OF] if right.temporal_ix else []
    left = c.tables(entity.table).select(q(entity.id).alias("__node"), q(entity.lat).cast("double").alias("la"), q(entity.lon).cast("double").alias("lo"))
    ids = left.select("__node").distinct()
    other = c.tables(right.table).select(q(right.id).alias("r"), q(right.lat).cast("double").alias("rla"), q(right.lon).cast("double").alias("rlo"), *([q(right.temporal_ix).alias("ts")] if at else [])).where("rla is not null and rlo is not null")
    within, same = float(spec.within_m), spec.left == spec.right
    width = float(spec.bandwidth_m or within)
    placed = left.where("la is not null and lo is not null" + " and __node is not null" * same)
    other = c.dated(other, "ts") if at else other
    if same:
        other = other.where("r is not null")
        places = placed.groupBy("__node").agg(F.min(F.struct("la", "lo")).alias("one"), F.max(F.struct("la", "lo")).alias("last")).select("__node", (F.col("one") != F.col("last")).alias("moves"))
        placed = placed.join(places, "__node")
        rows = others_near(placed.where("not moves"), other, within, width, at).unionByName(others_near_moving(placed.where("moves"), other, within, width, at))
    else:
        rows = placed.join(around(placed, other, within, width, at).select(*at, "la", "lo", (F.col("here") + F.col("away")).alias("n"), F.when(F.col("here") > 0, 0.0).otherwise(F.col("d")).alias("d"), (F.col("here") + F.col("k")).alias("k")), ["la", "lo"])
    value = {"colocation_count": F.sum("n"), "distance_to_nearest": F.min("d"), "kde_intensity": F.sum("k")}
    found = rows.groupBy(*at, "__node").agg(*(value[f].alias(n) for f, _, n in columns))
    every = c.dated(ids) if at else ids
    zero = {n: 0 for f, _, n in columns if f == "colocation_count"}
    joined = every.join(found, [*at, "__node"], "left")
    return joined.select(*at, "__node", *(F.coalesce(q(n), F.lit(0)).alias(n) if n in zero else q(n) for _, _, n in columns))


def around(placed, other, within, width, at):
    """For each place of the left rows what lies within the radius: rows of this very place as ``here``, and of others the number, the least distance and the density."""
    counts = other.groupBy(*at, "rla", "rlo").agg(F.count("*").alias("n"))
    pairs = near_pairs(placed.select("la", "lo").distinct(), counts, within).withColumn("at", (F.col("la") == F.col("rla")) & (F.col("lo") == F.col("rlo")))
    here, away, n = F.col("at"), ~F.col("at"), F.col("n")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return pairs.groupBy(*at, "la", "lo").agg(
        zero(F.when(here, n)).alias("here"),
        zero(F.when(away, n)).alias("away"), F.min(F.when(away, F.col("d"))).alias("d"), zero(F.when(away, n * density(width))).alias("k"),
    )


def density(width):
    return F.exp(-F.col("d") * F.col("d") / (2 * width * width))


def others_near(placed, other, within, width, at):
    """What lies around entities that have one place, without their own rows, all of which are there."""
    own = other.groupBy(*at, F.col("r").alias("__node")).agg(F.count("*").alias("own"))
    d = placed.join(around(placed, other, within, width, at), ["la", "lo"]).join(own, [*at, "__node"], "left")
    here = F.col("here") - F.coalesce(F.col("own"), F.lit(0))
    return d.select(*at, "__node", (here + F.col("away")).alias("n"), F.when(here > 0, 0.0).otherwise(F.col("d")).alias("d"), (here + F.col("k")).alias("k")).where("n > 0")


def others_near_moving(placed, other, within, width, at):
    """The same for entities with rows in several places, row by row."""
    pairs = near_pairs(placed, other, within).where("r <> __node")
    return pairs.groupBy(*at, "__node").agg(F.count("*").alias("n"), F.min("d").alias("d"), F.sum(density(width)).alias("k"))


def near_pairs(left, other, within):
    """All pairs at most ``within`` metres apart, with their distance ``d``."""
    h = bands(within)
    band = lambda lat: F.floor((lat + 90.0) / h).cast("long")
    near = left.withColumn("b", F.explode(F.array(*(band(F.col("la")) + k for k in (-1, 0, 1)))))
    around, own = cells_of(F.col("b"), F.col("lo"), within)
    near = near.withColumn("x", F.explode(F.array_distinct(F.array(*(F.pmod(own + k, around) for k in (-1, 0, 1))))))
    other = other.withColumn("b", band(F.col("rla")))
    other = other.withColumn("x", cells_of(F.col("b"), F.col("rlo"), within)[1])
    pairs = near.join(other, ["b", "x"])
    return pairs.withColumn("d", haversine(F.col("la"), F.col("lo"), F.col("rla"), F.col("rlo"))).where(F.col("d") <= within).drop("b", "x")
