"""Every query against its SQL on the smallest test data."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from addrloom import registry

DATA = os.environ.get("ADDRLOOM_TESTDATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    cell = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else round(float(v), 9) if isinstance(v, (float, np.floating)) else v.item() if isinstance(v, np.generic) else v
    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", list(registry.ORACLES))
def test_query(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [q for q in registry.QUERIES if q not in registry.ORACLES])
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
