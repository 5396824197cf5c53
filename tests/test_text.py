from __future__ import annotations

import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from addrloom.functions import dicts, scoring, text


def one(spark, rows, *columns):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string")
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in df.select("i", *columns).orderBy("i").collect()]


def plain_normalize(s: str) -> str:
    s = re.sub("[​‌‍﻿'’‘ʼ`]", "", unicodedata.normalize("NFC", s))
    s = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn").lower()
    s = re.sub(r"\s+", " ", re.sub("[,/\\-–—]+", " ", s)).strip()
    numbered = {f"q{d}{i}": f"quan {i}" for d in ("", ".") for i in dicts.DISTRICT_NUMBERS}
    for table in (dict(dicts.PROVINCES), dict(dicts.UNIT_TYPES) | numbered):
        for k in sorted(table, key=len, reverse=True):
            s = re.sub(rf"\b{re.escape(k)}\b", table[k], s)
    return re.sub(r"\s+", " ", s).strip()


GOLDEN = {
    "q1 hcm": "quan 1 ho chi minh", "q.13": "quan.13", "Ea H'leo": "ea hleo", "son la": "son long an", "sl": "son la", "ba ria vung tau": "ba ria ba ria vung tau",
    "đường": "đuong", "12/4a nguyen hue": "12 4a nguyen hue",
}


def test_normalize_golden(spark):
    assert one(spark, list(GOLDEN), text.normalize(F.col("s"))) == list(GOLDEN.values())


def test_normalize_against_rescanning(spark):
    words = [k for k, _ in dicts.PROVINCES] + [k for k, _ in dicts.UNIT_TYPES] + ["q.1", "q.12", "q.13", "q10", "tp.hcm", "Đường", "é'à", "a​b", "x/y", "12-3b", "  ", "ba", "ria", "–"]
    state, rows = 7, []
    for _ in range(1500):
        row = []
        for _ in range(1 + state % 5):
            state = (state * 1103515245 + 12345) % 2**31
            row.append(words[state // 65536 % len(words)])
        rows.append(" ".join(row))
    assert one(spark, rows, text.normalize(F.col("s"))) == [plain_normalize(r) for r in rows]


def test_normalize_without_compat_folds_the_stroke(spark):
    assert one(spark, ["Đường số 5"], text.normalize(F.col("s"), compat=False)) == ["duong so 5"]


def test_variants_golden(spark):
    assert one(spark, ["quan ho chi minh"], text.variants(F.col("s"))) == [["quan ho chi minh", "ho chi minh", "ho", "chi", "minh", "quan ho", "ho chi", "chi minh", "quan ho chi"]]
    assert one(spark, ["", "a"], text.variants(F.col("s"))) == [[], ["a"]]


@pytest.mark.parametrize(("a", "b", "sim"), [("ho chi minh", "Ho Chi Minh", 1.0), ("word", "two words", 0.36363637), ("eahleo", "Ea Hleo", 0.5), ("đoai phuong", "doai phuong", 0.6), ("cat", "concat", 0.375), ("", "x", 0.0), ("", "", 0.0)])
def test_similarity_golden(spark, a, b, sim):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(text.read_back(text.similarity(F.col("a"), F.col("b"))))
    assert df.first()[0] == pytest.approx(sim, abs=1e-8)


def plain_trigrams(s: str) -> set[str]:
    return {f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", s.lower()) for i in range(len(w) + 1)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("abc đé1- ", max_size=12), min_size=20, max_size=20))
def test_similarity_properties(spark, texts):
    pairs = [(texts[i], texts[j]) for i in range(0, 20, 2) for j in (i, i + 1)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", text.similarity(F.col("a"), F.col("b")), text.similarity(F.col("b"), F.col("a"))).orderBy("i").collect()
    for (a, b), (_, x, y) in zip(pairs, got):
        p, q = plain_trigrams(a), plain_trigrams(b)
        assert x == y == pytest.approx(len(p & q) / len(p | q) if p | q else 0.0, abs=1e-6)


def test_house_number_golden(spark):
    cases = {"so 6 db phu thi tran": ("6", "db phu thi tran"), "duong so 5": ("5", "duong"), "12 b nguyen hue": ("12", "b nguyen hue"), "12 4a nguyen hue": ("12", "4a nguyen hue"), "quan 1 ho chi minh": ("1", "quan ho chi minh"), "iso 5 so 5": ("5", "iso 5"), "123": ("123", ""), "ha noi": (None, "ha noi")}
    assert one(spark, list(cases), text.house_number(F.col("s")), text.without_house_number(F.col("s"))) == list(cases.values())


def test_street(spark):
    names = F.array(F.lit("Ea Hleo"), F.lit(None).cast("string"))
    assert one(spark, ["db phu thi tran eahleo ea x", "quan hleo"], text.street(F.col("s"), names)) == ["Dien Bien phu", None]


def test_place_names(spark):
    assert one(spark, ["Nhà hàng X", "nam dinh", "12 le loi"], text.is_place_name(F.col("s"))) == [True, True, False]


def test_prefixes(spark):
    prefix, name = text.split_prefix(F.col("s"))
    assert one(spark, ["Thành phố Hà Nội", "Thị xã Phước Long", "Đặc khu Phú Quốc"], prefix, name) == [("Thành phố", "Hà Nội"), ("Thị xã", "Phước Long"), ("", "Đặc khu Phú Quốc")]
    assert one(spark, [" Quận ", "Thị trấn", "Tỉnh"], text.unit_type_of(F.col("s"))) == ["district", "ward", "province"]
    with pytest.raises(Exception, match="unknown prefix"):
        one(spark, ["Bang"], text.unit_type_of(F.col("s")))


def test_reply_address(spark):
    rows = ['```json\n{"address": "Hà Nội"}\n```', "plain words", '{"address": ""}', "x" * 301]
    assert one(spark, rows, text.reply_address(F.col("s"))) == ["Hà Nội", "plain words", None, None]


@pytest.mark.parametrize(
    ("era", "p", "d", "w", "runner", "score", "confidence", "action"),
    [("post_merger", 1.0, None, 1.0, 10.0, 26.0, 1.0, "auto_accept"), ("post_merger", 1.0, None, 0.85, 23.0, 25.1, 0.821, "auto_accept"), ("post_merger", 1.0, None, None, None, 10.0, 0.269, "low_confidence"), ("pre_merger", 1.0, 1.0, 1.0, None, 40.0, 1.0, "auto_accept"), ("pre_merger", 1.0, 1.0, None, None, 24.0, 0.528, "low_confidence"), ("pre_merger", 1.0, None, None, None, 10.0, 0.175, "low_confidence"), ("pre_merger", None, None, None, None, 0.0, 0.0, "low_confidence")],
)
def test_scores_golden(spark, era, p, d, w, runner, score, confidence, action):
    df = spark.createDataFrame([(era, p, d, w, runner)], "era string, p double, d double, w double, r double")
    df = df.withColumn("s", scoring.candidate_score(F.col("p"), F.col("d"), F.col("w")))
    df = df.withColumn("c", scoring.confidence(F.col("s"), F.col("r"), scoring.depth(F.col("p"), F.col("d"), F.col("w")), F.col("era")))
    assert tuple(df.select("s", "c", scoring.action(F.col("c"))).first()) == (score, confidence, action)
