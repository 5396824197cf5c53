"""Tables of many copies: each two texts are compared once, and results equal the SQL that compares all rows."""

from __future__ import annotations

import duckdb
import pytest

from addrloom import registry
from addrloom.operators import vectors
from test_queries import rows
from test_simjoin import join_rows

TESTDATA, COPIES = "/root/testdata/sf0.001", 7
KEYS = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "nation": None, "region": None}


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """The smallest tables seven times over with shifted keys, and one row without a text."""
    folder, con = tmp_path_factory.mktemp("copies"), duckdb.connect()
    for t, key in KEYS.items():
        source = f"'{TESTDATA}/{t}.parquet'"
        rest = f"SELECT * REPLACE (CAST({key} + i * (SELECT max({key}) + 1 FROM {source}) AS BIGINT) AS {key}) FROM {source}, range({COPIES}) AS r(i)" if key else f"FROM {source}"
        rest = rest.replace("* REPLACE", "* EXCLUDE (i) REPLACE")
        con.execute(f"COPY ({rest}) TO '{folder}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["fuzzy_topk_parent", "fuzzy_topk_many", "fuzzy_topk_global", "fuzzy_join_strategies", "levenshtein_topk", "string_distances", "token_set_ratio", "cascade_pre"])
def test_copies(spark, copies, name):
    folder, con = copies
    assert rows(registry.QUERIES[name](spark, folder).toPandas()) == rows(con.execute(registry.ORACLES[name]).df())


def calls(plan, out):
    """Rows that leave each node, by its text."""
    name = plan.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return calls(plan.executedPlan(), out)
    if name.endswith("QueryStage"):
        return calls(plan.plan(), out)
    if "Join" in name:
        out.append(plan.metrics().get("numOutputRows").get().value())
    for i in range(plan.children().size()):
        calls(plan.children().apply(i), out)
    return out


def test_copies_are_not_compared_again(spark):
    """Forty copies of a name below a parent make no more pairs than one."""
    asked = spark.createDataFrame([(f"name {i % 5}", 1) for i in range(200)], "query string, parent bigint")
    names = spark.createDataFrame([(f"nome {i % 4}", 1) for i in range(160)], "ascii_name string, parent bigint")
    found = vectors.nearest_by_edits(asked, names, 3)
    got = found.collect()
    assert len(got) == 15 and all(r["ascii_name"] == f"nome {min(int(r['query'][-1]), 3) if int(r['query'][-1]) < 4 else 0}" for r in got)
    assert sum(calls(found._jdf.queryExecution().executedPlan(), [])) == 20


def test_trigrams_of_copies_are_met_once(spark, copies):
    from addrloom.operators import match

    units = registry._supplier_units(spark, copies[0])
    assert match.first_units(units).count() * COPIES == units.count()
    asked = units.selectExpr("id request", "'ward' level", "parent_id parent", "DATE'2026-01-01' as_of", "0.08D threshold", "array(lower(ascii_name)) variants")
    met = lambda table: join_rows(match.scored(asked.selectExpr("level", "parent", "as_of", "threshold", "variants[0] variant"), match.index_units(table)))
    assert met(match.first_units(units)) * COPIES == met(units) > 0
