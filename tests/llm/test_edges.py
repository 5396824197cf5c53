"""Null and repeated ids, ties, empty tables and clashing columns, against plain statements of the contracts."""

from __future__ import annotations

import hashlib
import math
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from addrloom.llm import knn, lm, media, packing, quality, sharding, simhash, store
from addrloom.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string"
VECTORS = "vec_id bigint, embedding array<double>"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


# --- tables in the shared folder


def test_kept_tables(spark):
    rows = [(1, "a", b"x", [1, 2], (1.5, None)), (None, None, None, None, None), (3, "é", b"", [], (0.0, True))]
    df = spark.createDataFrame(rows, "i bigint, s string, b binary, l array<bigint>, t struct<x: double, y: boolean>")
    key = lambda r: repr(r)
    assert sorted(store.keep(df.repartition(3), "t").collect(), key=key) == sorted(df.collect(), key=key)
    assert store.keep(df.where("i > 5"), "t").count() == 0 and store.keep(df.limit(0), "t").schema == df.schema


def test_a_kept_table_is_what_successful_tasks_wrote(spark, monkeypatch, tmp_path):
    """An attempt whose input ends early, and one that loses, leave complete-looking files; neither is read."""
    monkeypatch.setattr(store, "new_folder", lambda s, name: str(tmp_path / name))
    rows = spark.range(2000).repartition(4)
    broken = rows.withColumn("x", F.when(F.col("id") == 1999, F.raise_error(F.lit("late"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="late"):
        store.keep(broken, "t")
    left = list((tmp_path / "t").glob("*.parquet"))
    kept = store.keep(rows, "t")
    assert len(list((tmp_path / "t").glob("*.parquet"))) == len(left) + 4
    assert sorted(r["id"] for r in kept.collect()) == list(range(2000))
    # A loser that ends after the winner.
    for f in kept.inputFiles():
        path = f.removeprefix("file://").removeprefix("file:")
        (tmp_path / "t" / (path.rpartition("/")[2][:11] + "-late.parquet")).write_bytes(open(path, "rb").read())
    assert kept.count() == 2000 and store.keep(rows, "t").count() == 2000


def test_files_that_are_not_complete_are_not_seen(tmp_path):
    with pytest.raises(RuntimeError), store.writing(str(tmp_path / "x")) as f:
        f.write(b"half")
        raise RuntimeError
    assert not (tmp_path / "x").exists()


# --- top-k


def plain_top(rows, k):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    asked, out = {}, []
    for i, v in whole:
        if i % 100 == 0:
            asked[i] = min(asked.get(i, v), v)
    for q, y in asked.items():
        best = sorted((-sum(a * b for a, b in zip(y, v)), i) for i, v in whole if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("block", "group"), [(4096, 512), (16, 2)])
def test_top_k_with_repeated_ids(spark, monkeypatch, block, group):
    """A query repeated twenty times at its own pivot, an id with several vectors, and a common id far away."""
    monkeypatch.setattr(knn, "BLOCK_ROWS", block)
    monkeypatch.setattr(knn, "GROUP_QUERIES", group)
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(1, 900)]
    rows += [(100, [9.0, 9.0, 0.0, 0.0])] * 20 + [(200, [0.0, 0.0, c / 8, 4.0]) for c in range(15)] + [(301, [1.0, -1.0, 1.0, -1.0])] * 200
    got = knn.top_k(spark.createDataFrame(rows, VECTORS), spark.createDataFrame([x for x in rows if x[0] % 100 == 0], VECTORS), 10)
    assert sorted(tuple(x) for x in got.select("query_id", "rank", "vec_id", "score").collect()) == plain_top(rows, 10)


def test_blocks_hold_their_number(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 20)
    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) for _ in range(3)]) for i in range(1000)] + [(i, [1.0, 1.0, 1.0]) for i in range(1000, 1500)]
    df = spark.createDataFrame(rows, VECTORS)
    cells = knn._cells(knn.quantized(df, "vec_id", "embedding"), {3: np.zeros((1, 3))})
    blocks = knn._blocked(cells, 20, "block").groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("a"), F.max("dist").alias("b")).collect()
    assert sum(x["n"] for x in blocks) == len(rows) and max(x["n"] for x in blocks) <= 60
    assert np.median([x["b"] - x["a"] for x in blocks]) < 800  # rings, not the whole cell


# --- quality


def ordinal(seed: int):
    r = np.random.default_rng(seed)
    n, width = 80, 6
    grade = r.integers(0, 3, n)
    rows, cols = np.nonzero(r.random((n, width)) < 0.3 + 0.1 * grade[:, None])
    return rows, cols, grade, width


def plain_loss(state, rows, cols, grade, width, l2):
    """The likelihood written out, document by document."""
    w, first, steps = state[:width], state[width], state[width + 1 :]
    cuts = [first]
    for s in steps:
        cuts.append(cuts[-1] + math.exp(s))
    total = 0.0
    for i, g in enumerate(grade):
        s = sum(w[c] for r, c in zip(rows, cols) if r == i)
        below = lambda k: 0.0 if k < 0 else 1.0 if k >= len(cuts) else 1 / (1 + math.exp(-(cuts[k] - s)))
        total -= math.log(below(g) - below(g - 1))
    return total / len(grade) + l2 * sum(x * x for x in w) / 2 / math.sqrt(len(grade))


def test_likelihood_and_gradient_against_brute_force():
    rows, cols, grade, width = ordinal(1)
    state = np.random.default_rng(2).normal(0, 0.5, width + 2)
    value, gradient = quality.loss(state, rows, cols, grade, width, 0.01)
    assert value == pytest.approx(plain_loss(state, rows, cols, grade, width, 0.01))
    for k in range(len(state)):
        step = np.zeros(len(state))
        step[k] = 1e-6
        slope = (plain_loss(state + step, rows, cols, grade, width, 0.01) - plain_loss(state - step, rows, cols, grade, width, 0.01)) / 2e-6
        assert gradient[k] == pytest.approx(slope, abs=1e-6)


def test_fit_is_the_most_likely_model():
    rows, cols, grade, _ = ordinal(3)
    model = quality.fit(rows, cols.astype(np.uint64), grade, min_df=1, deviations=0.0, l2=0.01, rounds=1500)
    width = len(model.keys)
    index = {int(k): i for i, k in enumerate(model.keys)}
    kept = [(r, index[c]) for r, c in zip(rows.tolist(), cols.tolist()) if c in index]
    rows, cols = (np.array(x) for x in zip(*kept))
    state = np.concatenate((model.weights, model.thresholds[:1], np.log(np.diff(model.thresholds))))
    best = plain_loss(state, rows, cols, grade, width, 0.01)
    plain = np.zeros(width + 2)
    for _ in range(4000):  # gradient descent from zero
        plain = plain - 0.5 * quality.loss(plain, rows, cols, grade, width, 0.01)[1]
    assert best == pytest.approx(plain_loss(plain, rows, cols, grade, width, 0.01), abs=1e-3)


def test_conflicting_ratings_and_texts(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(["good", "bad", "word", "text", "more"], k=20)) + (" vile" if i % 3 == 0 else "")) for i in range(90)]
    graded = [(i, 0 if i % 3 == 0 else 1) for i, _ in rows]
    want = quality.train(spark.createDataFrame([(i, t) if i else (i, min(rows[0][1], "other", key=lambda x: hashlib.md5(x.encode()).hexdigest())) for i, t in rows], SCHEMA), spark.createDataFrame(graded, "doc_id bigint, grade int"))
    # Document 0 has two texts; every rating has a higher one beside it.
    docs = spark.createDataFrame([*rows, (0, "other")], SCHEMA)
    twice = spark.createDataFrame([(i, 1) for i, _ in rows] + graded, "doc_id bigint, grade int")
    for parts in (1, 5):
        got = quality.train(docs.repartition(parts), twice.repartition(parts))
        assert (got.keys == want.keys).all() and (got.weights == want.weights).all()


def test_wanted_grade(spark):
    model = quality.Model(np.zeros(0, np.uint64), np.zeros(0, np.float32), np.array([0.0, 1.0]))
    docs = spark.createDataFrame([(1, "a")], SCHEMA)
    for wanted in (0, 3, -1):
        with pytest.raises(ValueError):
            quality.grade(docs, model, wanted)
    assert quality.grade(docs, model, 1).first()["tail_probability"] == pytest.approx(0.5)


# --- language model


def test_scores_of_rows_without_or_with_a_repeated_doc_id(spark, monkeypatch):
    """Rows without a doc_id are learned from; one word stands before a third of all words and its followers lie in many shards."""
    monkeypatch.setattr(lm, "SHARD_TEXT", 12)
    rows = [(1, "the a the b the c"), (1, "the a the b the c"), (None, "the d the e"), (None, "lone words"), (2, None)]
    docs = spark.createDataFrame([(*x, "n") for x in rows], SCHEMA + ", score string")
    model = lm.train(docs.where(~lm.held_out(F.col("doc_id"))))
    assert model.shards > 1
    got = lm.score_documents(docs, model).collect()
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    assert [r["held_out"] for r in sorted(got, key=lambda r: str(r["doc_id"]))] == [held[i] for i in (1, 1, 2, None, None)]
    assert {r["train_tokens"] for r in got} == {sum(len((t or "").split()) + 1 for i, t in rows if not held[i])}
    assert len({(r["score"], r["base_score"]) for r in got if r["doc_id"] == 1}) == 1


def test_followers_of_a_frequent_word_are_spread(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TEXT", 100)
    seen = [r["shard"] for r in lm._gather(spark.createDataFrame([(" ".join(f"the w{k}" for k in range(300)),)], "text string"), 8).collect()]
    assert sorted(seen) == list(range(8))


# --- media


def test_media_of_rows_and_of_nothing(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (None, None)], SCHEMA)
    got = media.media_digest(media.text_media(docs)).collect()
    assert len(got) == 4 and len({tuple(r)[1:] for r in got if r["doc_id"] == 1}) == 1
    assert {r["n_bytes"] for r in got if r["doc_id"] is None} == {0, 1}
    assert media.media_digest(media.text_media(docs.where("false"))).count() == 0


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def fragmented() -> tuple[bytes, bytes]:
    """A track without samples of its own and two fragments: sizes and flags in the run, then usual ones; and its samples."""
    full = lambda kind, flags, *parts: box(kind, struct.pack(">I", flags), *parts)
    stbl = box(b"stbl", full(b"stsd", 0, struct.pack(">I", 1), box(b"avc1", bytes(28))), full(b"stsz", 0, bytes(8)), full(b"stco", 0, bytes(4)), full(b"stsc", 0, bytes(4)), full(b"stts", 0, bytes(4)))
    mdia = box(b"mdia", full(b"mdhd", 0, struct.pack(">IIIII", 0, 0, 1000, 0, 0)), full(b"hdlr", 0, struct.pack(">I4s12x", 0, b"vide")), box(b"minf", stbl))
    trak = box(b"trak", full(b"tkhd", 7, struct.pack(">5I", 0, 0, 5, 0, 0), bytes(60)), mdia)
    head = box(b"ftyp", b"isom") + box(b"moov", trak, box(b"mvex", full(b"trex", 0, struct.pack(">5I", 5, 1, 10, 4, 0x10000))))

    def moof(at: int, tfdt: int, sized: bool) -> bytes:
        run = struct.pack(">II", 3, at) if not sized else struct.pack(">IiI", 3, at, 0)  # count, offset, first flags
        body = b"".join(struct.pack(">II", 20 + k, 5 + k) for k in range(3)) if sized else b""
        return box(b"moof", full(b"mfhd", 0, struct.pack(">I", 1)), box(b"traf", full(b"tfhd", 0x20000, struct.pack(">I", 5)), full(b"tfdt", 0, struct.pack(">I", tfdt)), full(b"trun", 0x305 if sized else 1, run, body)))

    one, two = bytes(range(65, 83)), bytes(range(97, 109))
    a = moof(len(moof(0, 0, True)) + 8, 0, True)
    b = moof(len(moof(0, 0, False)) + 8, 63, False)
    return head + a + box(b"mdat", one) + b + box(b"mdat", two), one + two


def test_fragments():
    raw, samples = fragmented()
    (track,) = media.parse(raw)
    assert media.payload(raw, track) == samples and track.codec == "avc1" and track.seconds == pytest.approx(0.093)
    assert track.sizes.tolist() == [5, 6, 7, 4, 4, 4] and track.times.tolist() == [0, 20, 41, 63, 73, 83] and track.keys.tolist() == [0]
    for cut in (len(raw) - 1, len(raw) - 30):
        with pytest.raises(media.BrokenMedia):
            media.parse(raw[:cut])


# --- sharding


def plain_directory(rows, limit):
    """The leaves of the directory, split from the root on one bit at a time; one hash alone is not followed beyond the first depth."""
    out, todo = {}, [("", rows)]
    first = math.ceil(math.log2(max(2.0, sum(n for _, n in rows) / limit))) + sharding.EXTRA_BITS
    while todo:
        bits, own = todo.pop()
        if sum(n for _, n in own) > limit and (len({h for h, _ in own}) > 1 or len(bits) < first):
            for bit in "01":
                part = [x for x in own if x[0][len(bits)] == bit]
                if part:
                    todo.append((bits + bit, part))
        elif own:
            out[bits] = sum(n for _, n in own)
    return out


@pytest.mark.parametrize(("limit", "roll"), [(30, 8), (200, 2), (5000, 1)])
def test_shards_against_brute_force(spark, monkeypatch, limit, roll):
    monkeypatch.setattr(sharding, "ROLL", roll)
    r = random.Random(limit)
    rows = [(r.randint(0, 500), r.randint(0, 9)) for _ in range(800)]
    df = spark.createDataFrame(rows, "doc_id bigint, n int")
    hashes = [x["h"] for x in df.select(F.lpad(F.bin(F.xxhash64(F.lit(1), "doc_id")), 64, "0").alias("h")).collect()]
    want = plain_directory(list(zip(hashes, [n for _, n in rows])), limit)
    got = defaultdict(int)
    for x in sharding.shard(df, ["doc_id"], F.col("n"), limit).collect():
        got[x["shard"].partition(".")[0]] += x["bytes"]
    assert dict(got) == want


def test_shards_of_a_table_with_other_columns(spark):
    df = spark.createDataFrame([(i, i, "x", 1, 2) for i in range(50)], "doc_id bigint, n int, shard string, depth int, _hash int")
    assert sharding.shard(df, ["doc_id"], F.col("n"), 100).count() == 50
    with pytest.raises(ValueError):
        sharding.shard(df, ["shard"], F.col("n"), 100)


# --- near copies, packing


def test_prints_of_nothing_and_of_other_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, "x")], SCHEMA + ", root int, fingerprint string")
    assert simhash.near_duplicates(df).first()["component_id"] == 1
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_packing_of_nothing_and_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], SCHEMA)
    got = packing.pack_documents(docs, tokenizer_path(), 2048).collect()
    assert len(got) == 3 and len({(r["sequence_id"], r["offset"]) for r in got}) == 3 and sorted(r["length"] for r in got) == [1, 3, 3]
    assert packing.pack_documents(docs.where("false"), tokenizer_path(), 2048).count() == 0


# --- the pipeline


def test_near_dedup_keeps_unrelated_rows(spark):
    r = random.Random(7)
    a, b, c = (" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(3))
    stay = lambda rows: sorted(((x["doc_id"], x["text"]) for x in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS), "").collect()), key=str)
    assert stay([(1, a), (5, a), (5, b), (None, a), (None, b + " more words here")]) == sorted([(1, a), (5, b)], key=str)
    assert stay([(7, a), (7, b)]) == sorted([(7, a), (7, b)], key=str)
    assert stay([(7, a), (7, a), (None, c), (None, c)]) == sorted([(7, a), (None, c)], key=str)
    assert stay([(None, None), (3, ""), (2, a)]) == sorted([(3, ""), (2, a)], key=str)


def test_near_dedup_passes_other_columns(spark):
    docs = spark.createDataFrame([(1, "x y z", 4, "k", [1]), (2, "x y z", 5, "m", [2]), (3, "other", 6, None, None)], SCHEMA + ", row int, component string, node array<int>")
    got = {r["doc_id"]: tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert got == {1: (1, "x y z", 4, "k", [1]), 3: (3, "other", 6, None, None)}
