"""Names that share a template: blocks are compared, and no join puts out all pairs."""

from __future__ import annotations

import random
from datetime import date

import pytest

from addrloom import registry
from addrloom.operators import blocks, match, vectors
from test_copies import calls
from test_simjoin import sim, units

DAYS = [date(2005, 1, 1), date(2026, 1, 1)]


@pytest.mark.parametrize("group", [16_384, 40])
def test_best_names_equal_comparing_all(spark, monkeypatch, group):
    monkeypatch.setattr(blocks, "GROUP", group)
    monkeypatch.setattr(blocks, "AT_ONCE", 700)
    r = random.Random(3)
    rows = [(i, f"Supplier#{r.randrange(900):09d}" if i % 5 else r.choice(["", "--", "Đông Hà 7", "x" * 5000]), i % 2, date(2010, 1, 1) if i % 4 == 0 else None) for i in range(200)]
    asked = sorted({(p, q, d) for p in (0, 1, 9) for d in DAYS for q in [f"cusomer#{r.randrange(900):09d}" for _ in range(30)] + ["", "đông hà", "#", "x" * 4000]})
    pairs = spark.createDataFrame([("ward", *x) for x in asked], "level string, parent bigint, variant string, as_of date")
    got = {}
    for x in blocks.best_names(pairs, match.name_index(units(spark, rows)).names, ["level", "parent"], 3).collect():
        got.setdefault((x["parent"], x["variant"], x["as_of"]), []).append((-x["sim"], x["unit_id"]))
    for p, q, d in asked:
        want = sorted((-s, i) for i, n, up, end in rows if up == p and (end is None or end >= d) and (s := sim(q, n)) > 0)[:3]
        assert sorted(got.get((p, q, d), []))[:3] == want


@pytest.mark.parametrize("name", ["fuzzy_topk_parent", "fuzzy_join_strategies"])
def test_no_join_puts_out_all_pairs(spark, tmp_path, name):
    """A hundred customers and forty suppliers of one nation; each row meets a few others at most."""
    spark.range(100).selectExpr("id c_custkey", "concat('Customer#', lpad(id, 9, '0')) c_name", "1 c_nationkey", "0D c_acctbal", "'X' c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(40).selectExpr("id s_suppkey", "concat('Supplier#', lpad(id, 9, '0')) s_name", "1 s_nationkey", "0D s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    df = registry.QUERIES[name](spark, str(tmp_path))
    assert df.count() == (300 if name == "fuzzy_topk_parent" else 1)
    df.collect()
    assert max(calls(df._jdf.queryExecution().executedPlan(), [])) <= 300


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distances_of_all_pairs():
    r = random.Random(6)
    made = lambda n: sorted({"".join(r.choices("abđ𝄞", k=r.randrange(n))) for _ in range(60)} | {"", "a", "aa"})
    for n in (1, 9, 90):
        left, right = made(n), made(7)
        assert vectors.edit_distances(left, right).tolist() == [[_edits(a, b) for b in right] for a in left]


@pytest.mark.parametrize("few", [0, 10**9])
def test_nearest_by_edits_either_way(spark, monkeypatch, few):
    monkeypatch.setattr(vectors, "FEW_PAIRS", few)
    monkeypatch.setattr(blocks, "GROUP", 20)
    monkeypatch.setattr(blocks, "AT_ONCE", 500)
    r = random.Random(7)
    name = lambda: r.choice(["", "đà", f"Supplier#{r.randrange(99):05d}", None])
    asked, names = [(name(), r.randrange(3)) for _ in range(90)], [(name(), r.randrange(2)) for _ in range(70)]
    got = vectors.nearest_by_edits(spark.createDataFrame(asked, "query string, parent bigint"), spark.createDataFrame(names, "ascii_name string, parent bigint"), 3).collect()
    want = set()
    for q, p in set(asked):
        every = sorted((None in (q, n), 0 if None in (q, n) else _edits(q, n), n is None, n or "") for n, up in names if up == p for _ in range(asked.count((q, p))))
        want |= {(q, p, None if gone else n, None if null else d, rank) for rank, (null, d, gone, n) in enumerate(every[:3], 1)}
    assert {tuple(x) for x in got} == want and len(got) == len(want)
