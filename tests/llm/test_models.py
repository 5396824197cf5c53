from __future__ import annotations

import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from addrloom.llm import knn, lm, media, mixing, quality, sharding

SCHEMA = "doc_id bigint, text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def sentences(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


# --- language model


def plain_model(texts):
    unigrams, bigrams = Counter(), Counter()
    for t in texts:
        words = [w.decode() for w in (t or "").encode().lower().split()]
        unigrams.update([*words, "</s>"])
        bigrams.update(zip(["<s>", *words], [*words, "</s>"]))
    ahead, after, before = Counter(), defaultdict(lambda: [0, 0, 0]), Counter()
    for (x, y), n in bigrams.items():
        ahead[x] += n
        after[x][min(n, 3) - 1] += 1
        before[y] += 1
    discount = lambda c: (0.0, *lm.discounts(*(sum(v == k for v in c.values()) for k in (1, 2, 3, 4))))
    high, low, total, types = discount(bigrams), discount(before), sum(unigrams.values()), len(unigrams)

    def p1(y):
        if not bigrams:
            return 1 / (types + 1)
        return (max(before[y] - low[min(before[y], 3)], 0) + sum(low[min(v, 3)] for v in before.values()) / (types + 1)) / len(bigrams)

    def p(x, y):
        if not ahead[x]:
            return p1(y)
        return (max(bigrams[x, y] - high[min(bigrams[x, y], 3)], 0) + sum(d * n for d, n in zip(high[1:], after[x])) * p1(y)) / ahead[x]

    base = lambda y: (unigrams[y] + 0.1) / (total + 0.1 * (types + 1))
    return unigrams, p, base, total


LM_TEXTS = ["", None, " ", "One TWO three two", "unseen words here", "alpha " * 700, sentences(1, 2000), sentences(2, 500), sentences(2, 500), "é É ß x\x1cy"]


@pytest.mark.parametrize("shard", [12_000_000, 700])
def test_scores_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(lm, "SHARD_TEXT", shard)
    monkeypatch.setattr(lm, "GATHER", 400)
    ids = list(range(40))
    texts = [LM_TEXTS[i % len(LM_TEXTS)] if i % 3 else sentences(i, 60) for i in ids]
    docs = spark.createDataFrame(list(zip(ids, texts)), SCHEMA)
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in ids}
    unigrams, p, base, total = plain_model([t for i, t in zip(ids, texts) if not out[i]])
    assert sum(p("alpha", y) for y in [*unigrams, "<unknown>"]) == pytest.approx(1)
    got = {r["doc_id"]: r for r in lm.score_documents(docs, lm.train(docs.where(~lm.held_out(F.col("doc_id"))))).collect()}
    for i, t in zip(ids, texts):
        words = [w.decode() for w in (t or "").encode().lower().split()]
        row, seq = got[i], [*words, "</s>"]
        assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (out[i], len(seq), sum(unigrams[y] > 0 for y in seq), total)
        assert row["base_score"] == pytest.approx(sum(math.log10(base(y)) for y in seq))
        assert row["score"] == pytest.approx(sum(math.log10(p(x, y)) for x, y in zip(["<s>", *words], seq)))


def test_model_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], SCHEMA)
    model = lm.train(docs.where("false"))
    rows = lm.score_documents(docs, model).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == r["base_score"] == 0 for r in rows)
    assert lm.score_documents(docs.where("false"), model).count() == 0


def test_held_out_texts_are_less_surprising_than_to_the_base(spark):
    r = random.Random(1)
    text = lambda: " ".join(f"{a} {a}s" for a in r.choices(WORDS, k=80))
    docs = spark.createDataFrame([(i, text()) for i in range(120)], SCHEMA)
    scores = lm.score_documents(docs, lm.train(docs.where(~lm.held_out(F.col("doc_id"))))).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert scores[0] > 0.7 * scores[1]


# --- quality


def rated(seed: int, n: int):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        grade = r.choice([0, 1, 2, 2, 2])
        words = [r.choice(WORDS) + r.choice("abcdef") for _ in range(r.randint(20, 200))]
        if grade == 0:
            for k in range(0, len(words), 15):
                words[k] = r.choice(["insult", "slur"]) + r.choice(["", "s", "ing"])
        if grade == 1:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), grade))
    return rows


def test_grades_on_held_out_texts(spark):
    rows = rated(1, 900)
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows] + [(5000, None, None, None), (5001, "", None, None), (5002, "word " * 50_000, None, None)], SCHEMA + ", scored string, row double")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows[:600]] + [(None, 1), (3, None), (99_999, 2)], "doc_id bigint, grade int")
    model = quality.train(docs, ratings)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in quality.grade(docs, model).collect()}
    assert set(got) == {i for i, *_ in rows} | {5000, 5001, 5002} and got[1]["scored"] == "x"
    test = rows[600:]
    assert np.mean([got[i]["keep"] == (g == 2) for i, _, g in test]) > 0.97
    means = [np.mean([got[i]["expected_grade"] for i, _, g in test if g == k]) for k in (0, 1, 2)]
    assert means == sorted(means)
    assert got[5000]["expected_grade"] == got[5001]["expected_grade"]
    with pytest.raises(ValueError):
        quality.grade(docs.withColumn("keep", F.lit(1)), model)


def test_training_is_the_same_again(spark):
    rows = rated(2, 200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], SCHEMA)
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows], "doc_id bigint, grade int")
    a, b = quality.train(docs, ratings, 100), quality.train(docs.repartition(7), ratings.repartition(3), 100)
    assert (a.keys == b.keys).all() and (a.weights == b.weights).all() and (a.thresholds == b.thresholds).all()


def test_no_ratings_and_no_texts(spark):
    docs = spark.createDataFrame([(1, "a b c")], SCHEMA)
    model = quality.train(docs, spark.createDataFrame([], "doc_id bigint, grade int"))
    assert 0 <= quality.grade(docs, model).first()["expected_grade"] <= 1
    assert quality.grade(docs.where("false"), model).count() == 0


# --- top-k


def plain_top(rows, k):
    good = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in good:
        if q % 100 == 0:
            end = lambda x: max(min(x, 2**63 - 1), -(2**63))
            best = sorted((-end(sum(a * b for a, b in zip(good[q], v))), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("plan_groups", [64, 1])
@pytest.mark.parametrize(("block", "group", "dim", "scale"), [(4096, 512, 8, 1.0), (7, 2, 3, 1.0), (16, 3, 4, 1e12)])
def test_top_k_against_brute_force(spark, monkeypatch, plan_groups, block, group, dim, scale):
    monkeypatch.setattr(knn, "PLAN_GROUPS", plan_groups)
    monkeypatch.setattr(knn, "BLOCK_ROWS", block)
    monkeypatch.setattr(knn, "GROUP_QUERIES", group)
    r = random.Random(dim)
    rows = [(i, [r.gauss(0, 1) * scale for _ in range(dim)]) for i in range(0, 1200, 5)]
    rows += [(i, [scale] * dim) for i in range(2000, 2060)]  # one vector many times
    rows += [(3000, None), (3001, [None] + [1.0] * (dim - 1)), (3100, [float("nan")] * dim), (3200, [float("inf")] + [0.0] * (dim - 1)), (3300, [1.0] * (dim + 1)), (3301, [2.0] * (dim + 1)), (3400, []), (None, [1.0] * dim)]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id bigint, embedding array<double>, block string, cell int")
    got = sorted(tuple(x) for x in knn.top_k(df, df.where("vec_id % 100 = 0"), 10).select("query_id", "rank", "vec_id", "score").collect())
    assert got == plain_top(rows, 10)


def test_top_k_sends_few_blocks_where_bounds_tell(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 20)
    r = random.Random(3)
    rows = [(i, [c * 100 + r.random(), (9 - c) * 100 + r.random()]) for c in range(10) for i in range(c * 100, c * 100 + 100)]
    pivots = {2: np.array([[c * 102400.0, (9 - c) * 102400.0] for c in range(10)])}
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    cells = knn._cells(knn.quantized(df, "vec_id", "embedding"), pivots).toPandas()
    made = cells.groupby("cell").agg(radius=("dist", "max"), norm=("norm", "max"), rows=("dist", "size")).reset_index()
    made["block"] = made["grp"] = made["cell"]
    assert len(knn._bounds(made, made, pivots[2], 11)) < 100


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    assert knn.top_k(df, df).count() == 0
    one = spark.createDataFrame([(100, [1.0])], "vec_id bigint, embedding array<double>")
    assert knn.top_k(one, one).count() == 0


# --- media


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=400), st.integers(1, 60))
def test_media_round_trip(seed, times):
    payload = (seed * times * 64)[: max(64, len(seed) * times // 64 * 64)]
    raw = media.encode_frames(payload)
    (track,) = media.parse(raw)
    assert media.payload(raw, track) == payload and track.codec == "raw " and track.kind == "vide"
    assert len(track.keys) == len(track.sizes) == -(-len(payload) // 4096) and track.seconds == pytest.approx(0.04 * len(track.sizes))


def test_text_media(spark):
    texts = ["", None, "a", "x" * 64, "é" * 5000, "long " * 60_000]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], SCHEMA + ", media int")
    for r in media.media_digest(media.text_media(docs)).collect():
        own = (texts[r["doc_id"]] or "").encode()
        padded = own + bytes(-len(own) % 64 or (0 if own else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(own), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        made = media.encode_frames(padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(made), hashlib.sha256(made).hexdigest()) and "codec=raw" in r["feature"]


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def container(**change):
    """Two chunks of an audio track with large sizes, samples of one size, 64-bit offsets, and key frames 1 and 4."""
    full = lambda kind, *parts: box(kind, bytes(4), *parts)
    samples = b"".join(bytes([65 + i]) * 10 for i in range(5))
    offset = change.get("offset", 200)
    table = box(
        b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"mp4a", bytes(28))), full(b"stts", struct.pack(">5I", 2, 4, 100, 1, 50)), full(b"stss", struct.pack(">3I", 2, 1, change.get("key", 4))),
        full(b"stsc", struct.pack(">7I", 2, 1, 2, 1, 2, 3, 1)), full(b"stsz", struct.pack(">II", 10, change.get("count", 5))), full(b"co64", struct.pack(">IQQ", 2, offset, offset + 20)),
    )
    mdia = box(b"mdia", box(b"mdhd", struct.pack(">B3x2QIQHH", 1, 0, 0, 1000, 450, 0, 0)), full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"), box(b"minf", table))
    moov = box(b"moov", box(b"trak", mdia))
    head = box(b"ftyp", b"isom") + struct.pack(">I4sQ", 1, b"free", 16) + moov
    pad = box(b"skip", bytes(600 - len(head) - 8 - 8))
    return head + pad + struct.pack(">I4s", 0, b"mdat") + samples


def test_tables():
    raw = container(offset=600)
    (track,) = media.parse(raw)
    assert (track.kind, track.codec, track.timescale, track.duration, track.seconds) == ("soun", "mp4a", 1000, 450, 0.45)
    assert media.payload(raw, track) == b"".join(bytes([65 + i]) * 10 for i in range(5))
    assert track.times.tolist() == [0, 100, 200, 300, 400] and media.ranges(track) == [(600, 10), (630, 10)]


@pytest.mark.parametrize("raw", [b"", b"abc", b"\0\0\0\x08free", container(offset=10_000), container(key=9), container(count=6), container(offset=600)[:300], struct.pack(">I4s", 4, b"moov"), box(b"moov", box(b"trak", box(b"mdia", box(b"mdhd", b"\0"))))])
def test_broken_media(raw):
    with pytest.raises(media.BrokenMedia):
        media.parse(raw)


def test_media_info(spark):
    rows = [(1, container(offset=600), "x"), (2, b"no media", "y"), (3, None, None), (4, media.encode_frames(bytes(64)), "z")]
    got = {r["id"]: r["media_info"] for r in media.media_info(spark.createDataFrame(rows, "id int, data binary, tracks string"), "data").collect()}
    assert got[1]["error"] is None and got[1]["tracks"][0]["codec"] == "mp4a" and [tuple(k) for k in got[1]["tracks"][0]["keyframes"]] == [(600, 10), (630, 10)]
    assert got[2]["tracks"] == [] and got[2]["error"] and got[3] is None and got[4]["tracks"][0]["width"] == 64
    with pytest.raises(ValueError):
        media.media_info(spark.createDataFrame([], "data binary, media_info int"), "data")


# --- mixing


def water(sizes, weights, most=3.0):
    total, left, target = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while left:
        rest, sum_w = total - sum(target), sum(weights[i] for i in left)
        over = [i for i in left if rest * weights[i] / sum_w > most * sizes[i]]
        if not over:
            for i in left:
                target[i] = rest * weights[i] / sum_w
            break
        for i in over:
            target[i] = most * sizes[i]
        left -= set(over)
    return target


@pytest.mark.parametrize(("seed", "bucket"), [(1, 20_000), (2, 5), (3, 40)])
def test_mix(spark, monkeypatch, seed, bucket):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", bucket)
    r = random.Random(seed)
    names = ["a", "B", "é", "", None, "z", "𝔸", "hot"]
    rows = [(i, None if i % 50 == 7 else " ".join(r.choices(WORDS, k=r.randint(0, 40))), "hot" if i % 3 == 0 else r.choices(names, [9, 1, 1, 5, 3, 8, 4, 1])[0]) for i in range(400)]
    rows += rows[:5]
    docs = spark.createDataFrame([(*x, 1.0, 2) for x in rows], SCHEMA + ", source string, target double, taken int")
    got = mixing.mix(docs, carry=("target",)).collect()
    again = {(x["doc_id"], x["position"], x["taken"]) for x in mixing.mix(docs.repartition(9)).collect()}
    assert {(x["doc_id"], x["position"], x["taken"]) for x in got} == again and len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(order, water([sizes[s] for s in order], [1 + k % 3 for k in range(len(order))])))
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    taken = Counter()
    for x in got:
        assert x["source_size"] == sizes[x["source"]] and x["target"] == pytest.approx(target[x["source"]])
        assert 0 <= x["taken"] <= 3 * x["size"] and (x["position"] is not None) == (x["taken"] > 0)
        taken[x["source"]] += x["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 1
    copies = mixing.training_order(mixing.mix(docs)).collect()
    assert Counter({s: sum(c["words"] for c in copies if c["source"] == s) for s in order}) == taken
    at = [c["position"] for c in copies]
    assert at == sorted(at) and min(at) >= 0 and max(at) <= 1


def test_positions_follow_the_schedule(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i % 2 else "b") for i in range(400)], SCHEMA + ", source string")
    early = [("a", 0.0, 0.5, 2.0, 0.0), ("a", 0.5, 1.0, 0.0, 0.0), ("b", 0.0, 1.0, 0.5, 0.5)]
    got = mixing.mix(docs, spark.createDataFrame(early, "source string, t0 double, t1 double, w0 double, w1 double")).collect()
    a, b = ([x["position"] for x in got if x["source"] == s and x["position"] is not None] for s in "ab")
    assert max(a) <= 0.5 and np.mean(a) == pytest.approx(1 / 6, abs=0.02) and np.mean(b) == pytest.approx(0.5, abs=0.02)


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA + ", source string")).count() == 0
    row = mixing.mix(spark.createDataFrame([(None, None, None)], SCHEMA + ", source string")).first()
    assert row["size"] == 0 and row["taken"] == 0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.text("ab \t\né", max_size=20), st.integers(0, 12)), min_size=1, max_size=10))
def test_first_words(spark, rows):
    df = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(rows)], "i int, t string, n int")
    got = [r[0] for r in df.orderBy("i").select(mixing.first_words(F.col("t"), F.col("n"))).collect()]
    for (t, n), x in zip(rows, got):
        assert t.startswith(x) and x.encode().split() == t.encode().split()[:n]


# --- sharding


@pytest.mark.parametrize("limit", [50, 400, 100_000])
def test_shards(spark, monkeypatch, limit):
    monkeypatch.setattr(sharding, "ROWS_PER_PART", 7)
    r = random.Random(limit)
    rows = [(i, r.randint(0, 20)) for i in range(600)] + [(7, 5)] * 90 + [(9, 300), (None, 11), (None, None), (11, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, n int")
    got = sharding.shard(df, ["doc_id"], F.col("n"), limit).collect()
    assert len(got) == len(rows) and sum(x["bytes"] for x in got) == sum(n or 0 for _, n in rows)
    held = defaultdict(list)
    for x in got:
        held[x["shard"]].append(x)
    for own in held.values():
        size = sum(x["bytes"] for x in own)
        assert {x["shard_bytes"] for x in own} == {size} and (size <= limit or len(own) == 1)
    whole = {s.split(".")[0]: 0 for s in held}
    for s, own in held.items():
        whole[s.split(".")[0]] += sum(x["bytes"] for x in own)
    prefixes = sorted(whole)
    assert not any(b.startswith(a) for a, b in zip(prefixes, prefixes[1:]))
    for p in prefixes:  # only oversized buckets split
        for d in range(len(p)):
            assert sum(n for q, n in whole.items() if q.startswith(p[:d])) > limit


def test_shards_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, n int")
    assert sharding.shard(df, ["doc_id"], F.col("n"), 10).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(df, ["doc_id"], F.col("n"), 0)
