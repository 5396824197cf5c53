"""Cells on the globe and the nearest unit, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from addrloom.operators import geo

SCHEMA = "lat double, lon double"


def all_pairs(a, b):
    p, q = np.radians(np.array(a, float)), np.radians(np.array(b, float))
    h = np.sin((q[None, :, 0] - p[:, None, 0]) / 2) ** 2 + np.cos(p[:, None, 0]) * np.cos(q[None, :, 0]) * np.sin((q[None, :, 1] - p[:, None, 1]) / 2) ** 2
    return np.round(2 * geo.EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1))), 6)


@pytest.mark.parametrize("where", ["globe", "country"])
def test_nearest_equals_all_pairs(spark, where):
    rng = np.random.default_rng(5)
    if where == "globe":
        a = [(90.0, 0.0), (-90.0, 12.0), (0.0, 180.0), (0.0, -180.0), (10.0, 179.99), (89.9, -170.0), (0.0, 0.0), *zip(rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300))]
        b = [(0.0, -179.5), (89.0, 10.0), (10.0, -179.9), (-60.0, 100.0), (-60.0, 100.0), *zip(rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60))]
    else:
        a = [*zip(rng.uniform(8, 23, 300), rng.uniform(102, 110, 300)), (-34.0, -58.0)]
        b = [*zip(rng.uniform(8, 23, 400), rng.uniform(102, 110, 400))]
    places = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "place_id int, " + SCHEMA)
    units = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(b)], "unit_id int, " + SCHEMA)
    got = {r["place_id"]: (r["unit_id"], r["km"]) for r in geo.nearest(places, units).collect()}
    want = all_pairs(a, b)
    assert sorted(got) == list(range(len(a)))
    for i, (unit, km) in got.items():
        assert abs(km - want[i].min()) < 1e-5 and abs(want[i][unit] - km) < 1e-5 and unit <= int(want[i].argmin())


def test_rows_off_the_globe_and_empty_tables(spark):
    places = spark.createDataFrame([(1, 10.0, 20.0), (2, None, 0.0), (3, 91.0, 0.0), (4, 0.0, float("nan"))], "place_id int, " + SCHEMA)
    units = spark.createDataFrame([(7, 11.0, 20.0), (6, 11.0, 20.0), (1, None, None), (0, 10.0, 200.0)], "unit_id int, " + SCHEMA)
    assert [(r["place_id"], r["unit_id"]) for r in geo.nearest(places, units).collect()] == [(1, 6)]
    assert geo.nearest(places, units.limit(0)).isEmpty() and geo.nearest(places.limit(0), units).isEmpty()


def test_codes_are_nested(spark):
    rows = spark.createDataFrame([(21.03, 105.85), (-90.0, -180.0), (90.0, 180.0), (90.1, 0.0)], SCHEMA)
    for row in rows.select(*[geo.cell_code(F.col("lat"), F.col("lon"), k).alias(f"c{k}") for k in (1, 6, 15)]).collect():
        assert row["c15"] is None or (row["c15"].startswith(row["c6"]) and row["c6"].startswith(row["c1"]) and len(row["c15"]) == 15)
    assert [r[0] for r in rows.select(geo.cell_code(F.col("lat"), F.col("lon"), 2)).collect()] == ["31", "00", "22", None]


def test_places_at_one_position_are_looked_for_once(spark, monkeypatch):
    """Fifty places at each of four positions meet the units around as four do."""
    seen, around = [], geo._around
    monkeypatch.setattr(geo, "_around", lambda rows, level: seen.append(rows.count()) or around(rows, level))
    places = spark.createDataFrame([(i, float(i % 4), 10.0) for i in range(200)], "place_id int, " + SCHEMA)
    units = spark.createDataFrame([(i, float(i), 10.1) for i in range(4)], "unit_id int, " + SCHEMA)
    got = geo.nearest(places, units).collect()
    assert sorted((r["place_id"], r["unit_id"]) for r in got) == [(i, i % 4) for i in range(200)] and max(seen) == 4
