"""The increasing fit against its definition, and what it does to scores."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from addrloom.operators import calibration as cal
from addrloom.operators import extensions


def by_definition(right, n):
    """The greatest, over beginnings, of the least rate over ends."""
    rate = lambda i, j: sum(right[i : j + 1]) / sum(n[i : j + 1])
    return [max(min(rate(i, j) for j in range(k, len(n))) for i in range(k + 1)) for k in range(len(n))]


def test_pooled_equals_its_definition():
    rng = np.random.default_rng(2)
    for size in (1, 2, 7, 30):
        n = rng.integers(1, 9, size).tolist()
        right = [int(rng.integers(0, m + 1)) for m in n]
        assert cal.pooled(right, n) == pytest.approx(by_definition(right, n), abs=1e-12)
    assert cal.pooled([], []) == [] and cal.pooled([1, 1], [2, 2]) == [0.5, 0.5]


def test_fit_table_and_report(spark):
    rng = np.random.default_rng(4)
    score = rng.random(4000)
    rows = [(float(s), bool(rng.random() < s**3)) for s in score] + [(None, True), (0.5, None), (float("nan"), True), (1.0, True), (1.5, True), (-0.5, False)]
    samples = spark.createDataFrame(rows, "confidence double, correct boolean")
    fitted = cal.isotonic(cal.binned(samples, bins=20))
    table = sorted((r["bin"], r["n"], r["fitted"]) for r in fitted.collect())
    assert sum(n for _, n, _ in table) == 4003 and [f for *_, f in table] == sorted(f for *_, f in table)
    one = cal.report(fitted).first()
    assert one["n"] == 4003 and one["error_after"] < one["error_before"] / 3


def test_gaps_and_empty_tables(spark):
    samples = spark.createDataFrame([(0.35, False), (0.35, True), (0.75, True)], "confidence double, correct boolean")
    fitted = cal.isotonic(cal.binned(samples, bins=10))
    asked = spark.createDataFrame([(1, 0.1), (2, 0.3), (3, 0.6), (4, 0.99), (5, None), (6, float("nan"))], "k int, confidence double")
    got = {r["k"]: r["probability"] for r in cal.calibrated(asked, fitted, bins=10).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 0.5, 4: 1.0, 5: None, 6: None}
    none = cal.isotonic(cal.binned(samples.limit(0), bins=10))
    assert none.isEmpty() and cal.report(none).first()["n"] == 0
    assert {r["probability"] for r in cal.calibrated(asked, none, bins=10).collect()} == {None}
    with pytest.raises(ValueError, match="bins"):
        cal.binned(samples, bins=0)


def test_a_trained_model_scores_after_an_observed_query(spark):
    rows = spark.createDataFrame([(i / 40, int(i > 20)) for i in range(40)], "confidence double, correct int")
    seen = Observation()
    assert rows.observe(seen, F.count(F.lit(1)).alias("n")).count() == 40 and seen.get["n"] == 40
    found = extensions.calibrate(rows, ["confidence"]).transform(rows).orderBy("confidence").collect()
    assert found[0]["probability"][1] < 0.2 < 0.8 < found[-1]["probability"][1]
