"""Prefix-filtered similarity joins against comparing everything, and how many candidates they meet."""

from __future__ import annotations

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from addrloom.operators import match, simjoin

DAY = date(2026, 1, 1)
ONSETS, RHYMES = "b c d g h kh l m n ng nh ph qu s t th tr v x".split(), "a an ang anh ao at e en i ich inh o oan oc on ong u uc ung uong uy yen".split()


def names(seed, n):
    """Names of two or three syllables, in which some syllables are far more common than others."""
    r = random.Random(seed)
    syllables = [a + b for a in ONSETS for b in RHYMES]
    r.shuffle(syllables)
    weights = [1 / (k + 1) for k in range(len(syllables))]
    return sorted({" ".join(r.choices(syllables, weights, k=r.choice([2, 2, 3]))) for _ in range(n)})


def misspelt(r, name):
    k = r.randrange(len(name))
    return r.choice([name[:k] + name[k + 1 :], name[:k] + r.choice("aeiou") + name[k:], name])


def trigrams(s):
    words = "".join(c if c.isalnum() else " " for c in s.lower()).split()
    return {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}


def sim(a, b):
    x, y = trigrams(a), trigrams(b)
    return float(np.float32(len(x & y) / len(x | y))) if x | y else 0.0


def units(spark, rows):
    return spark.createDataFrame([(i, str(i), n, n, "ward", n, p, date(2000, 1, 1), end) for i, n, p, end in rows], "id bigint, gso_code string, full_name string, name string, unit_type string, ascii_name string, parent_id bigint, valid_from date, valid_to date")


def join_rows(df):
    """Rows that the joins on trigrams put out."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(p.plan())
            continue
        if "Join" in name and "g#" in p.leftKeys().toString():
            total += p.metrics().get("numOutputRows").get().value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return total


def test_best_units_and_their_candidates(spark):
    r = random.Random(1)
    pool = names(2, 14_000)
    rows = [(i, n, None, date(2010, 1, 1) if i % 9 == 0 else None) for i, n in enumerate(pool)] + [(90_000 + k, pool[k], None, None) for k in range(5)] + [(95_000, "--", None, None), (95_001, None, None, None)]
    asked = [(i, misspelt(r, r.choice(pool))) for i in range(150)] + [(900, ""), (901, "!"), (902, "zzzz"), (903, None)]
    pairs = spark.createDataFrame([("ward", match.ROOT, q, DAY, 0.05) for _, q in asked] * 2 + [("district", match.ROOT, pool[0], DAY, 0.05)], "level string, parent bigint, variant string, as_of date, threshold double")
    table = units(spark, rows)
    pruned = match.scored_best(pairs, match.prefix_index(table, below_root=True), 5)
    plain = match.scored(pairs, match.index_units(table, below_root=True))
    got = {}
    for x in pruned.collect():
        got.setdefault(x["variant"], {})[x["unit_id"]] = x["sim"]
    live = [(i, n) for i, n, _, end in rows if end is None and n]
    for _, q in asked:
        every = {i: s for i, n in live if (s := sim(q or "", n)) > 0.05}
        fifth = sorted(every.values(), reverse=True)[:5][-1:]
        assert got.get(q, {}) == {i: s for i, s in every.items() if s >= fifth[0]}
    met, before = join_rows(pruned), join_rows(plain)
    assert 0 < met < before / 10, (met, before)


def test_a_request_finds_the_same_units_either_way(spark):
    r = random.Random(4)
    pool = names(5, 600)
    table = units(spark, [(i, n, i % 3, None) for i, n in enumerate(pool)])
    requests = spark.createDataFrame([(i, "ward", r.choice([0, 1, 2, 7]), DAY, 0.08, [misspelt(r, r.choice(pool)) for _ in range(r.choice([0, 1, 4]))]) for i in range(60)], "request bigint, level string, parent bigint, as_of date, threshold double, variants array<string>")
    aliases = spark.createDataFrame([(pool[5], 9, 0.4), (pool[8], 5, 2.0)], "alias string, unit_id bigint, weight double")
    rows = lambda index: sorted((x["request"], x["rank"], x["unit"]["id"], x["score"]) for x in match.best_match(requests, table, aliases, 3, index).collect())
    assert rows(match.prefix_index(table)) == rows(match.index_units(table)) != []


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.85, 1.0])
def test_threshold_join(spark, threshold):
    r = random.Random(int(threshold * 100))
    pool = names(7, 250)
    left = [(i, misspelt(r, r.choice(pool)), r.choice(["p", "q", None])) for i in range(200)] + [(None, pool[0], "p"), (3, pool[0], "p"), (3, pool[0], "p"), (4, None, "p"), (5, "", "q")]
    right = [(i, n, r.choice(["p", "q", None])) for i, n in enumerate(pool)] + [(7, pool[0], "p"), (7, pool[0], "p"), (8, None, "p"), (9, "...", "p")]
    df = lambda rows, key: spark.createDataFrame(rows, f"{key} bigint, name string, block string")
    got = simjoin.threshold_join(df(left, "a"), df(right, "b"), "a", "b", "name", threshold, ["block"]).collect()
    want = [(a, b, s) for a, x, p in left for b, y, q in right if x and y and p is not None and p == q and (s := sim(x, y)) > 0 and s >= np.float32(threshold)]
    key = lambda t: (t[0] is None, t)
    assert sorted((tuple(x) for x in got), key=key) == sorted(want, key=key) and want


def test_nothing_to_join(spark):
    none, some = spark.createDataFrame([], "a bigint, name string"), spark.createDataFrame([(1, "x y")], "b bigint, name string")
    assert simjoin.threshold_join(none, some, "a", "b", "name", 0.5).collect() == []
    assert simjoin.threshold_join(some.withColumnRenamed("b", "a"), none.withColumnRenamed("a", "b"), "a", "b", "name", 0.5).collect() == []
    for bad in (0.0, 1.1):
        with pytest.raises(ValueError):
            simjoin.threshold_join(none, some, "a", "b", "name", bad)


def test_common_trigrams_are_not_looked_up(spark):
    """The prefix of a set holds its rarest trigrams alone."""
    rows = spark.createDataFrame([(i, f"kho {w}") for i, w in enumerate(["alpha", "bravo", "carol", "delta"] * 5)], "i int, name string")
    freq = simjoin.frequencies(rows, "name")
    row = simjoin.by_rarity(rows.where("i = 0").unionByName(spark.createDataFrame([(99, "kho zzz")], rows.schema)), ["i"], "name", freq).orderBy("i").collect()
    known = {x["g"]: x["id"] for x in freq.collect()}
    assert len(row[0]["x"]) == row[0]["m"] == 10 and set(row[0]["x"][-4:]) == {known[g] for g in trigrams("kho")} and row[0]["x"] == sorted(row[0]["x"])
    assert len(row[1]["x"]) == 4 and row[1]["m"] == 8
    assert spark.range(1).select(simjoin.prefix(F.lit(10), F.lit(0.5))).first()[0] == 6


def test_rows_of_one_text_are_spread_after_the_joins(spark):
    """The join of what is alike with the rows puts out texts, not all pairs of their rows; a score is taken of texts too."""
    rows = lambda key: spark.createDataFrame([(None if i == 7 else i % 50, f"kho {w}") for w in ("alpha", "bravo") for i in range(60)], f"{key} bigint, name string").repartition(2)
    df = simjoin.threshold_join(rows("a"), rows("b"), "a", "b", "name", 0.9, score=F.col("sim") * 2)
    keys = [None if i == 7 else i % 50 for i in range(60)]
    key = lambda t: (t[0] is None, t[0] or 0, t[1] is None, t[1] or 0)
    assert sorted((tuple(x) for x in df.collect()), key=key) == sorted([(a, b, 2.0) for a in keys for b in keys] * 2, key=key)
    made, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(p.plan())
        else:
            if "Join" in name and "_right#" in p.leftKeys().toString():
                made.append(p.metrics().get("numOutputRows").get().value())
            todo += [p.children().apply(i) for i in range(p.children().size())]
    assert made and max(made) <= 2 * 2 * 2 * 2


def test_names_of_few_trigrams_meet_at_two(spark):
    """Digits have few trigrams, which many names share; no join puts out the names that share one."""
    left = spark.range(400).selectExpr("id a", "concat('cusomer#', lpad(id * 7, 9, '0')) name")
    right = spark.range(400).selectExpr("id b", "concat('customer#', lpad(id * 7, 9, '0')) name")
    df = simjoin.threshold_join(left, right, "a", "b", "name", 0.6)
    full = {(a, b): s for a in range(400) for b in range(400) if (s := sim(f"cusomer#{a * 7:09d}", f"customer#{b * 7:09d}")) >= np.float32(0.6)}
    assert {(x["a"], x["b"]): x["sim"] for x in df.collect()} == full
    # Each text joins the sizes of the few groups that it goes to.
    assert join_rows(df) < 10_000


def test_the_best_of_names_of_few_trigrams(spark):
    """Steps of similarity give the hits that comparing all gives, also where too few are very similar or not valid, and no join puts out all that share a trigram."""
    r = random.Random(9)
    table = units(spark, [(i, f"customer#{i * 37:09d}", None, date(2010, 1, 1) if i % 3 == 0 else None) for i in range(150)] + [(900 + i, n, None, None) for i, n in enumerate(["zz", "zzz q", "--"])])
    asked = [(i, "ward", None, DAY, 0.3, [f"cusomer#{r.randrange(6000):09d}"]) for i in range(60)] + [(90, "ward", None, DAY, 0.3, ["zzz", None, ""])]
    requests = spark.createDataFrame(asked, "request bigint, level string, parent bigint, as_of date, threshold double, variants array<string>")
    none = spark.createDataFrame([], "alias string, unit_id bigint, weight double")
    rows = lambda index: sorted((x["request"], x["rank"], x["unit"]["id"], x["score"]) for x in match.best_match(requests, table, none, 3, index).collect())
    assert rows(match.alike_index(table)) == rows(match.index_units(table)) != []
