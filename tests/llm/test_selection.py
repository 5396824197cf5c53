"""Resampling, toxicity and the filter audit against plain statements of their contracts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from addrloom.llm import interactions, queries, resample, textkit, toxicity

SCHEMA = "doc_id bigint, text string"
GAP = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


# --- resampling


def plain_features(text):
    words = GAP.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]]


def plain_draw(docs, target):
    """Rows as they come, with those of one (score, doc_id) ranked in any order among themselves."""
    found = [(i, *plain_features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in plain_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    rows = []
    for i, n, f in found:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = order[: 25 * len(order) // 100]
    return Counter((i, f, w, s) for i, _, f, w, s in rows), [(k, i, s) for k, (i, _, _, _, s) in enumerate(drawn, 1)]


def test_draw_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resample, "RUN", 1000)
    monkeypatch.setattr(resample, "RANKED_ROWS", 50)
    monkeypatch.setattr(textkit, "CHUNK_BYTES", 3000)
    r = random.Random(3)
    words = ["Alpha", "beta", "ГАММА", "délta", "x9", "Ω", "z" * 60, "ab" * 24, "日本語" * 12, "\x00", "it's", "a_b"]
    text = lambda n: r.choice([" ", "--", "\n"]).join(r.choices(words, k=n))
    docs = [(i, text(r.choice([1, 5, 19, 20, 40, 120]))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "..."), (1003, "one"), (None, text(60)), (None, text(60)), (1004, text(30_000))] + [(7, text(25))] * 2 + [(2000, docs[5][1])] * 60
    target = [text(50), None, "", "beta délta beta"]
    rows, drawn = plain_draw(docs, target)
    extra = spark.createDataFrame([(*d, 1, "x", [2]) for d in docs], SCHEMA + ", score int, row string, place array<int>").repartition(5)
    got = resample.resample(extra, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert Counter((x["doc_id"], x["n_features"], x["weight"], x["score"]) for x in got) == rows
    assert sorted((x["rank"], x["doc_id"], x["score"]) for x in got if x["rank"] is not None) == drawn


def test_draw_from_nothing(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b"), (2, " ".join("abcdefghij" * 3))], SCHEMA)
    assert resample.resample(none, some.select("text")).collect() == []
    rows = resample.resample(some, none.select("text"), percent=100).collect()
    assert sorted((x["doc_id"], x["rank"]) for x in rows) == [(1, None), (2, 1)] and plain_draw([(x["doc_id"], x["text"]) for x in some.collect()], [])[0] == Counter((x["doc_id"], x["n_features"], x["weight"], x["score"]) for x in rows)
    with pytest.raises(ValueError):
        resample.bucket_streams(some, 70_000)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aZ9 é日-\n" + "q" * 3, max_size=200), max_size=5), st.integers(0, 120))
def test_streams(texts, n):
    texts = [*texts, "k" * n + " " + "m" * (120 - n)]
    raw = [t.encode() for t in texts]
    words, edge, stream = resample.streams_of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))), 10_000)
    for k, t in enumerate(texts):
        want = plain_features(t)
        assert words[k] == want[0] and stream[edge[k] : edge[k + 1]].tolist() == want[1]


def test_query_of_the_draw(spark):
    path = "/root/testdata/sf0.001"
    read = lambda t: spark.read.parquet(f"{path}/{t}.parquet")
    rows, drawn = plain_draw([tuple(x) for x in read("documents").select("doc_id", "text").collect()], [x[0] for x in read("benchmark").select("text").collect()])
    got = queries.op11_importance_resampling(spark, path).collect()
    assert Counter((x["doc_id"], x["n_features"], x["weight"], x["score"]) for x in got) == rows
    assert sorted((x["rank"], x["doc_id"], x["score"]) for x in got if x["rank"] is not None) == drawn


# --- toxicity


def test_risk_and_its_gradients():
    r = np.random.default_rng(0)
    side = lambda n: (r.integers(0, n, 40), r.integers(0, 6, 40), n)
    p, u, state = side(9), side(14), r.normal(size=7)
    toxic, clean, g_toxic, g_clean = toxicity.risk(state, p, u, 0.3, 0.01)
    sig = lambda x: 1 / (1 + np.exp(-x))
    out = lambda s: np.array([state[:6][s[1][s[0] == i]].sum() + state[6] for i in range(s[2])])
    assert toxic == pytest.approx(0.3 * -np.log(sig(out(p))).mean() + 0.005 * (state[:6] ** 2).sum())
    assert clean == pytest.approx(-np.log(1 - sig(out(u))).mean() + 0.3 * np.log(1 - sig(out(p))).mean())
    for k in range(7):
        step = np.zeros(7)
        step[k] = 1e-6
        up, down = toxicity.risk(state + step, p, u, 0.3, 0.01), toxicity.risk(state - step, p, u, 0.3, 0.01)
        assert g_toxic[k] == pytest.approx((up[0] - down[0]) / 2e-6, abs=1e-6) and g_clean[k] == pytest.approx((up[1] - down[1]) / 2e-6, abs=1e-6)


def test_clean_part_stays_above_zero():
    """Confirmed texts learned by heart: features that single texts of P have and U lacks."""
    texts = [np.array(sorted({i, i + 100, 900}), np.uint64) for i in range(60)] + [np.array([500 + i % 40], np.uint64) for i in range(300)]
    positive = np.arange(360) < 60
    keys, w, b = toxicity.fit(texts, positive, 0.4, min_df=1, deviations=-1.0)
    f = np.array([w[np.searchsorted(keys, t)].sum() + b for t in texts])
    clean = np.logaddexp(0, f[60:]).mean() - 0.4 * np.logaddexp(0, f[:60]).mean()
    assert clean > -0.1  # without the correction it sinks far below


def texts_with_insults(seed, n):
    r = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ten", "ro", "su", "va"]
    rows = []
    for i in range(n):
        words = ["".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(r.randint(15, 200))]
        toxic = r.random() < 0.2
        if toxic:
            for k in range(0, len(words), 12):
                words[k] = r.choice(["grubling", "grublo", "Zwerk", "zwerkish"])
        rows.append((i, " ".join(words) + "!", int(toxic)))
    return rows


def test_held_out_texts(spark):
    rows = texts_with_insults(1, 1500)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, "grubling " * 30, None), (9000, None, None), (9001, "", None), (9002, "ka " * 200_000, None), (9002, "ka " * 200_000, None)], SCHEMA + ", `member.x` string")
    # Half of the toxic texts are confirmed, the rest stay unlabelled; so do all others.
    r = random.Random(2)
    marks = [(i, t) for i, _, t in rows if not (t and r.random() < 0.5)] + [(None, 1), (12345678, 1), (3, None)]
    labels = spark.createDataFrame(marks, "doc_id bigint, toxic int")
    learned = labels.where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.train(docs.where(~toxicity.held_out(F.col("doc_id"))), learned.where("toxic = 1"), 0.2, positive_rows=200, unlabelled_rows=400, members=2)
    assert model.weights.shape[1] == 2
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got)
    by = {x["doc_id"]: x for x in got}
    out = [(by[i]["predicted"], t) for i, _, t in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p == t for p, t in out) / len(out) > 0.97
    assert by[None]["predicted"] == 1 and by[9000]["score"] == by[9001]["score"] and by[9000]["predicted"] == by[9002]["predicted"] == 0
    again = toxicity.train(docs.where(~toxicity.held_out(F.col("doc_id"))).repartition(3), learned.where("toxic = 1").repartition(2), 0.2, positive_rows=200, unlabelled_rows=400, members=2)
    assert (again.keys == model.keys).all() and np.allclose(again.weights, model.weights)


def test_toxicity_of_nothing(spark):
    none, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.score_documents(none, labels).collect() == []
    some = spark.createDataFrame([(1, "a"), (None, None)], SCHEMA)
    rows = toxicity.score_documents(some, labels).collect()
    assert [round(x["score"], 6) for x in rows] == [0.001, 0.001] and {x["predicted"] for x in rows} == {0}
    with pytest.raises(ValueError):
        toxicity.score(some.withColumn("score", F.lit(1)), toxicity.merged([], 0.1))


def test_labels_of_held_out_rows_do_not_count(spark):
    rows = texts_with_insults(4, 300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], SCHEMA)
    mark = lambda flip: spark.createDataFrame([(i, 1 - t if flip and zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, _, t in rows], "doc_id bigint, toxic int")
    a, b = ({x["doc_id"]: x["score"] for x in toxicity.score_documents(docs, mark(flip)).collect()} for flip in (False, True))
    assert a == b


# --- the audit


def plain_audit(docs, labels):
    good, toxic = ({i for i, *m in labels if i is not None and m[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    parts = defaultdict(list)
    for i, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(c for c, x in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t])) if x)
        parts[s or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        shapley = Counter()
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [x for x in rows if f in x[0] and not before & set(x[0])]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [f, sum(not (before | {f}) & set(x[0]) for x in rows), len(gone), sum(f in x[0] and bool(before & set(x[0])) for x in rows), sum(x[0] == f for x in rows), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[v[0]])
    return {k: tuple(v[1:]) for k, v in out.items()}


def test_audit_against_brute_force(spark):
    r = random.Random(9)
    words = ["one", "Two", "THREE", "#", "four|", "five", "six"] + [f"w{k}" for k in range(300)]
    text = lambda: r.choice([" ", "\t", " \n"]).join(r.choices(words[: r.choice([3, 7, 300])], k=r.choice([3, 150, 260])))
    pool = [text() for _ in range(40)] + ["", None, "\x0b \x0c", "é" * 60 + "A", "x " * 40_000]
    docs = [(r.choice([None, r.randint(1, 200), r.randint(1, 200)]), r.choice(pool), r.choice(["a", "b", "", None, "é"])) for _ in range(500)]
    docs += [(500, pool[0], "a")] * 30 + [(None, pool[1], "b")] * 30
    labels = [(r.choice([None, r.randint(1, 200)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(200)] + [(500, 1, 1)] * 2
    df = spark.createDataFrame([(*d, 1, "p", 2) for d in docs], "doc_id bigint, text string, source string, fails int, part string, before int").repartition(4)
    got = interactions.audit_documents(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert {(x["part"], x["filter_order"], x["step"]): tuple(x[c] for c in (*interactions.COUNTS, "shapley")) for x in got} == plain_audit(docs, labels)
    assert len(got) == 4 * 600


def test_audit_of_nothing_and_of_few_filters(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert interactions.audit_documents(spark.createDataFrame([], SCHEMA + ", source string"), labels).collect() == []
    rows = spark.createDataFrame([("x", 3, True, False), ("x", 1, False, True), ("y", 0, True, True)], "part string, fails int, good boolean, toxic boolean")
    got = {(x["part"], x["filter_order"], x["step"]): (x["kept"], x["removed"], x["redundant"], x["unique_fails"], x["good_lost"], x["toxic_lost"], x["shapley"]) for x in interactions.audit(rows, "AB").collect()}
    assert got["x", "AB", 1] == (0, 2, 0, 1, 1, 1, 3) and got["x", "AB", 2] == (0, 0, 1, 0, 0, 0, 1) and got["x", "BA", 1] == (1, 1, 0, 0, 1, 0, 1) and got["y", "BA", 2] == (1, 0, 0, 0, 0, 0, 0)
    for bad in ("", "AA", "ABCDEFG"):
        with pytest.raises(ValueError):
            interactions.audit(rows, bad)
