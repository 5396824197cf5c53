"""Sound keys, search by sound, and token-set ratios against plain statements."""

from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from addrloom.functions import phonetic, text
from addrloom.operators import match, vectors
from addrloom.plans import resolve as plan

DAY = date(2026, 1, 1)


def keys(spark, names):
    rows = spark.createDataFrame(list(enumerate(names)), "i int, s string")
    return [x[0] for x in rows.orderBy("i").select(phonetic.sound_key(F.col("s"))).collect()]


def test_names_that_are_confused_have_one_key(spark):
    alike = [("Sơn Kỳ", "xơn kì"), ("Trung Chính", "chung trinh"), ("Long", "Nong"), ("Lý Nam", "ni lam"), ("Gia Lai", "ra nai"), ("Nghĩa", "ngia"), ("Hòa", "hua"), ("Quý", "cúi"), ("Phan", "fang"), ("Tân Định", "tang đin"), ("Bắc", "bat"), ("Ghềnh", "gên"), ("Đồng", "dong")]
    for a, b in alike:
        x, y = keys(spark, [a, b])
        assert x == y, (a, b, x, y)
    apart = ["Tân", "Thân", "Ban", "Man", "Han", "Khan", "Can", "Van", "Phan", "Nhan", "Ngan", "Tam", "Tap", "Tat", "Ton", "12", "13"]
    assert len(set(keys(spark, apart))) == len(apart)
    assert keys(spark, [None, "", " - ", "Quận 1"]) == [None, "", "", "Kuan 1"]


def test_tones(spark):
    rows = spark.createDataFrame([("Mả Mã ma mà má mạ",), ("Nguyễn Thị, Hương 3",), (None,), ("",)], "s string")
    assert [x[0] for x in rows.select(phonetic.tone_classes(F.col("s"))).collect()] == ["330124", "3400", None, ""]
    decomposed = spark.createDataFrame([("Mả Mã",)], "s string")
    assert decomposed.select(phonetic.tone_classes(F.col("s"))).first()[0] == "33"


def test_search_by_sound_finds_what_trigrams_miss(spark):
    names = ["tra vinh", "cha la", "son la", "soc trang", "lang son", "quy nhon", "gia nghia", "ly son"]
    units = spark.createDataFrame([(i, str(i), n, n, "province", n, None, date(2000, 1, 1), None) for i, n in enumerate(names)], "id bigint, gso_code string, full_name string, name string, unit_type string, ascii_name string, parent_id bigint, valid_from date, valid_to date")
    gaz = plan.Gazetteer(units, spark.createDataFrame([], "alias string, unit_id bigint, weight double"))
    asked = {"nan xong": 4, "ni xon": 7, "da ngia": 6, "xon na": 2, "cui nhong": 5}
    missed = 0
    for q, want in asked.items():
        rows = plan.search(spark, q, gaz, DAY, limit=1, by_sound=True).collect()
        assert rows and rows[0]["id"] == want and rows[0]["score"] >= 0.5
        plain = plan.search(spark, q, gaz, DAY, limit=1).collect()
        missed += not plain or plain[0]["id"] != want
    assert missed >= 2
    assert plan.search(spark, "zzz", gaz, DAY, by_sound=True).collect() == []


# --- token sets


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = last + 1 if x == y else max(row[j], row[j - 1]), row[j]
    return row[-1]


def plain_ratio(a, b):
    x, y = set(a.split()), set(b.split())
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 1.0
    one, other = (f"{both} {s}".strip() for s in (left, right))
    if not one or not other:
        return 0.0
    ratio = lambda s, t: 2 * lcs(s, t) / (len(s) + len(t))
    return max([ratio(one, other), *((ratio(both, one), ratio(both, other)) if both else ())])


def test_token_set_ratio(spark):
    r = random.Random(2)
    words = ["tan", "phu", "tân", "phuoc", "long", "binh", "x" * 70, "日本", "😀", "ab", "ba"]
    made = lambda: r.choice([" ", "  ", "\t"]).join(r.choices(words, k=r.choice([0, 1, 2, 3, 6])))
    rows = [(i, made(), made()) for i in range(400)] + [(900, None, "a"), (901, "a b" * 60, "b a" * 70), (902, "a b", "b  a a"), (903, "", "")]
    got = {x["i"]: x["r"] for x in spark.createDataFrame(rows, "i int, a string, b string").select("i", vectors.token_set_ratio(F.col("a"), F.col("b")).alias("r")).collect()}
    for i, a, b in rows:
        assert got[i] == (None if None in (a, b) else pytest.approx(plain_ratio(a, b))), (a, b)


def test_common_subsequences():
    r = random.Random(7)
    pairs = [("".join(r.choices("abcé😀", k=r.randint(0, 200))), "".join(r.choices("abcé😀", k=r.randint(0, 200)))) for _ in range(120)]
    assert vectors.lcs_lengths(*map(list, zip(*pairs))).tolist() == [lcs(a, b) for a, b in pairs]
    assert vectors.lcs_lengths([], []).tolist() == [] and vectors.lcs_lengths(["", "a"], ["b", ""]).tolist() == [0, 0]


def test_a_request_by_sound_keeps_its_other_hits(spark):
    units = spark.createDataFrame([(1, "1", "a", "a", "ward", "son la", 5, date(2000, 1, 1), None), (2, "2", "a", "a", "ward", "xon na", 5, date(2000, 1, 1), date(2001, 1, 1))], "id bigint, gso_code string, full_name string, name string, unit_type string, ascii_name string, parent_id bigint, valid_from date, valid_to date")
    asked = spark.createDataFrame([(1, "ward", 5, DAY, 0.1, ["xon na"]), (2, "ward", 6, DAY, 0.1, ["xon na"])], "request bigint, level string, parent bigint, as_of date, threshold double, variants array<string>")
    none = spark.createDataFrame([], "alias string, unit_id bigint, weight double")
    rows = match.best_match(asked, units, none, 3, sounds=match.index_sounds(units)).collect()
    assert [(x["request"], x["unit"]["id"]) for x in rows] == [(1, 1)]
    assert rows[0]["score"] == pytest.approx((1 + spark.range(1).select(text.similarity(F.lit("xon na"), F.lit("son la"))).first()[0]) / 2, abs=1e-6)
