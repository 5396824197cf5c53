"""The approximate vector index: its recall, and rows that take no part."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from addrloom import registry
from addrloom.operators import ann


def nearest(spark, rows, asked, k=5, lists=16, parts=16, probes=4, again=80):
    model = ann.fit(rows, lists, parts)
    return {(r["query_id"], r["vec_id"]) for r in ann.search(asked, rows, ann.index(rows, model), model, k, probes, again).collect()}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    """On vectors without clusters, with three of four lists probed."""
    rows = lambda name: {(r["query_id"], r["vec_id"]) for r in registry.QUERIES[name](spark, f"/root/testdata/{sf}").collect()}
    want = rows("vector_knn")
    assert len(want & rows("vector_ann")) / len(want) >= 0.95


def test_recall_in_clusters(spark):
    """A quarter of the lists is enough where vectors lie in clusters, and a hot one holds a third of them."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 32))
    at = np.where(rng.random(3000) < 1 / 3, 0, rng.integers(30, size=3000))
    a = centres[at] + 0.3 * rng.normal(size=(3000, 32))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "vec_id long, embedding array<double>")
    unit = a / np.linalg.norm(a, axis=1, keepdims=True)
    near = unit[::100] @ unit.T
    near[np.arange(30), np.arange(0, 3000, 100)] = -1
    want = {(q * 100, int(v)) for q in range(30) for v in np.argsort(-near[q])[:5]}
    got = nearest(spark, rows, rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"))
    assert len(got) == len(want) and len(want & got) / len(want) >= 0.95


def test_rows_that_take_no_part(spark):
    bad = [(100, None), (101, [1.0]), (102, [0.0] * 4), (103, [1.0, None, 0.0, 0.0]), (104, [float("nan"), 1.0, 0.0, 0.0]), (105, [float("inf"), 1.0, 0.0, 0.0])]
    good = [(i, [1.0, float(i), 0.0, 1e300 if i == 7 else 0.0]) for i in range(8)] + [(3, [1.0, 3.0, 0.0, 0.0])]
    rows = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>").coalesce(1)
    asked = rows.withColumnRenamed("vec_id", "query_id").dropDuplicates(["query_id"])
    model = ann.fit(rows, 3, 3)
    assert model.words.shape[0] == 2
    blocks = ann.index(rows, model)
    assert blocks.agg(F.sum("n")).first()[0] == len(good)
    found = ann.search(asked, rows, blocks, model, 3, 3, 50).collect()
    assert {r["query_id"] for r in found} == set(range(8)) and all(r["vec_id"] != r["query_id"] for r in found)
    assert ann.fit(rows.where("vec_id >= 102"), 3, 3) is None and ann.fit(rows.limit(0), 3, 3) is None


def test_repeated_vectors_go_to_the_smaller_id(spark):
    rows = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "vec_id long, embedding array<double>")
    model = ann.fit(rows, 4, 2)
    got = ann.search(spark.createDataFrame([(10, [1.0, 2.0])], "query_id long, embedding array<double>"), rows, ann.index(rows, model), model, 3, 4, 50).orderBy("rank").collect()
    assert [(r["vec_id"], r["cosine"]) for r in got] == [(0, 1.0), (1, 1.0), (2, 1.0)]
