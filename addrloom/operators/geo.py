"""Places on the globe: a hierarchical cell code, and the nearest unit by equi-joins over cells.

A level cuts latitude and longitude into 2^level bands each; a code interleaves the
bits of both bands, so a cell's code begins with those of all cells around it. The
nearest unit to a place is looked for in its cell and the eight around it, on the finest
level first. What lies outside them is at least as far as their nearest edge, so a unit
that is closer than that is the nearest; a place without one goes on to cells that are four
times larger each way, and after the largest to all units. The first level is that on
which the units' own area has about as many cells as units.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrloom.operators.extensions import EARTH_KM, distance_km
from addrloom.operators.stages import cut

#: Finest level of a code; its cells are some 600 m from south to north.
FINEST = 15
#: Coarsest level that a search by cells uses, and the levels between two of its steps.
COARSEST, STEP = 2, 2


def band(degrees: Column, low: float, span: float, level: int) -> Column:
    """The band of a latitude (-90, 180) or longitude (-180, 360) on a level, the upper end in the last one."""
    return F.least(F.floor((degrees - low) / span * (1 << level)), F.lit((1 << level) - 1)).cast("int")


def lat_band(lat: Column, level: int) -> Column:
    return band(lat, -90.0, 180.0, level)


def lon_band(lon: Column, level: int) -> Column:
    """180 degrees are -180 degrees."""
    return F.pmod(band(lon, -180.0, 360.0, level) + F.when(lon >= 180, 1).otherwise(0), F.lit(1 << level)).cast("int")


def valid(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def cell_code(lat: Column, lon: Column, level: int = FINEST) -> Column:
    """A digit 0 to 3 for each level, the widest cell's first; null outside the globe."""
    y, x = lat_band(lat, level), lon_band(lon, level)
    digits = [(F.shiftright(y, k).bitwiseAND(1) * 2 + F.shiftright(x, k).bitwiseAND(1)).cast("string") for k in reversed(range(level))]
    return F.when(valid(lat, lon), F.concat(*digits))


def clearance(lat: Column, lon: Column, level: int) -> Column:
    """Kilometres that no place outside the nine cells around can be closer than."""
    y, x = lat_band(lat, level), F.floor((lon + 180) / 360 * (1 << level))
    high, wide = 180.0 / (1 << level), 360.0 / (1 << level)
    # No edge beyond a pole: cells of the last band hold it.
    north = F.when(y + 2 <= (1 << level) - 1, (y + 2) * high - 90 - lat)
    south = F.when(y - 1 >= 1, lat - ((y - 1) * high - 90))
    east, west = (x + 2) * wide - 180 - lon, lon - ((x - 1) * wide - 180)
    # The distance to a meridian less than 90 degrees away, along the great circle that meets it at a right angle.
    side = F.asin(F.cos(F.radians(lat)) * F.sin(F.radians(F.least(east, west, F.lit(90.0)))))
    across = F.least(F.radians(F.least(F.coalesce(north, F.lit(180.0)), F.coalesce(south, F.lit(180.0)))), side)
    return across * EARTH_KM


def _around(rows: DataFrame, level: int) -> DataFrame:
    """Each row once for each of the nine cells, as (_y, _x); a cell that comes twice counts once."""
    n = 1 << level
    steps = F.array(*[F.struct((lat_band(F.col("lat"), level) + a).alias("y"), F.pmod(lon_band(F.col("lon"), level) + b, F.lit(n)).cast("int").alias("x")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    return rows.withColumn("_c", F.explode(F.array_distinct(steps))).where(F.col("_c.y").between(0, n - 1)).select(*rows.columns, F.col("_c.y").alias("_y"), F.col("_c.x").alias("_x"))


def _first_level(spots: DataFrame) -> int:
    """The level on which the box around (_lat, _lon) rows has about as many cells as rows."""
    n, *box = spots.agg(F.count(F.lit(1)), F.min("_lat"), F.max("_lat"), F.min("_lon"), F.max("_lon")).first()
    if not n:
        return COARSEST
    area = max(box[1] - box[0], 0.01) * max(box[3] - box[2], 0.01)
    return max(COARSEST, min(FINEST, round(math.log2(n * 180 * 360 / area) / 2)))


def nearest(places: DataFrame, units: DataFrame) -> DataFrame:
    """(place_id, unit_id, km) for (place_id, lat, lon) and (unit_id, lat, lon): the nearest unit, of equally near ones the smaller id.

    Places and units off the globe or without a coordinate take no part; a place has no
    row if there are no units. ``place_id`` is the places' key. Distances are compared
    to the millimetre. The last step compares places that have no unit within
    thousands of kilometres with distinct positions of units; where units lie around
    the places, as in a gazetteer, there are none.
    """
    every = cut(places.where(valid(F.col("lat"), F.col("lon"))).select("place_id", "lat", "lon"))
    # Places at one position are looked for once, by the smallest id.
    sites = left = cut(every.groupBy("lat", "lon").agg(F.min("place_id").alias("place_id")))
    # Units at one position are one: the smallest id.
    spots = cut(units.where(valid(F.col("lat"), F.col("lon"))).groupBy("lat", "lon").agg(F.min("unit_id").alias("unit_id")).withColumnsRenamed({"lat": "_lat", "lon": "_lon"}))
    km = F.round(distance_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")), 6)
    best = lambda met: met.groupBy("place_id").agg(F.min(F.struct(km.alias("km"), "unit_id")).alias("b")).select("place_id", "b.unit_id", "b.km")
    found = []
    for level in range(_first_level(spots), COARSEST - 1, -STEP):
        at = spots.withColumn("_y", lat_band(F.col("_lat"), level)).withColumn("_x", lon_band(F.col("_lon"), level))
        near = best(_around(left, level).join(at, ["_y", "_x"]))
        done = cut(near.join(left, "place_id").where(F.col("km") < clearance(F.col("lat"), F.col("lon"), level) - 1e-5).select("place_id", "unit_id", "km"))
        found.append(done)
        left = cut(left.join(done.select("place_id"), "place_id", "left_anti"))
        if left.isEmpty():
            break
    else:
        # Units by the eighth of the globe: each of the places left meets each eighth's units by an equi-join.
        eighth = lambda lat, lon: lat_band(lat, 1) * 4 + lon_band(lon, 2)
        found.append(best(left.withColumn("_e", F.explode(F.sequence(F.lit(0), F.lit(7)))).join(spots.withColumn("_e", eighth(F.col("_lat"), F.col("_lon"))), "_e")))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return every.join(out.join(sites, "place_id").drop("place_id"), ["lat", "lon"]).select("place_id", "unit_id", "km")

