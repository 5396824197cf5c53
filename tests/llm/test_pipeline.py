from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from addrloom.llm import mixing
from addrloom.llm.queries import queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [f"{a}{b}" for a in ("on", "er", "tha", "ing", "re", "sto", "mi") for b in ("ka", "lo", "ne", "ra", "tu", "vi")]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder like the test data: clean, toxic and junk documents, copies, a shared line, and odd rows."""
    r = random.Random(4)
    text = lambda: "\n".join(" ".join(r.choices(WORDS, k=r.randint(8, 16))).capitalize() + "." for _ in range(r.randint(2, 8)))
    shared, docs, labels = "All rights are kept by the makers of this text.", [], []
    for i in range(600):
        kind = r.choice(["toxic", "junk", "clean", "clean", "clean"])
        t = text()
        if kind == "toxic":
            words = t.split(" ")
            for k in range(0, len(words), 6):
                words[k] = r.choice(["scum", "moron", "idiot"])
            t = " ".join(words)
        elif kind == "junk":
            t = " ".join(w.upper() + "!!" for w in t.split())
        elif r.random() < 0.2:
            t += "\n" + shared
        docs.append((i, t, "en", r.choice(["a", "b", "b", None]), len(t)))
        labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    clean = [i for i, q, x in labels if q and not x]
    docs += [(1000 + k, docs[clean[k]][1], "en", "a", 1) for k in range(10)]
    docs += [(2000, "", "en", "a", 0), (2001, None, None, None, None), (2002, " ".join(r.choices(WORDS, k=9000)), "en", "hot", 1)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, DOCS).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(k, text()) for k in range(5)], "item_id bigint, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), docs, {i: (q, x) for i, q, x in labels}


@pytest.fixture(scope="module")
def stages(spark, corpus, tmp_path_factory):
    folder, out = corpus[0], tmp_path_factory.mktemp("stages")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(out / str(k)))
        docs = spark.read.parquet(str(out / str(k)))
        kept.append(docs)
    return kept


def test_quality_keeps_clean_documents(corpus, stages):
    kept, (_, _, labels) = {r["doc_id"] for r in stages[0].collect()}, corpus
    clean = [i for i, (q, x) in labels.items() if q and not x]
    toxic = [i for i, (q, x) in labels.items() if x]
    junk = [i for i, (q, x) in labels.items() if not q]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean) and sum(i in kept for i in toxic) <= 0.03 * len(toxic) and sum(i in kept for i in junk) <= 0.03 * len(junk)


def test_stages_keep_the_columns(stages):
    for docs in stages[:-1]:
        assert docs.columns == COLUMNS


def test_lines(stages):
    rows = [r["text"] or "" for r in stages[1].collect()]
    assert stages[1].count() == stages[0].count()
    assert sum("All rights are kept" in t for t in rows) == 1
    assert all(r["n_chars"] == len(r["text"] or "") for r in stages[1].collect())


def test_one_of_each_group_stays(stages):
    """By the stage's contract, in brute force: five-word shingles and a similarity of 0.8 or more, linked on."""
    rows = sorted(((r["doc_id"], r["text"]) for r in stages[1].collect()), key=lambda r: r[0])
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append(frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset())
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    want = {rows[top(i)][0] for i in range(len(rows))}
    assert {r["doc_id"] for r in stages[2].collect()} == want and stages[2].count() == len(want)
    assert len(want) < len(rows)


def test_mix_takes_whole_texts_near_its_targets(stages):
    plan = {r["doc_id"]: r for r in mixing.mix(stages[2]).collect()}
    before, after = ({(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in df.collect()} for df in stages[2:4])
    assert after <= before
    copies: dict = {}
    for r in stages[3].collect():
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    of_source: dict = {}
    for i, r in plan.items():
        # Whole passes as planned, and the last, cut copy of a source whole or not at all.
        assert copies.get(i, 0) == (math.floor(r["taken"] / r["size"] + 0.5) if r["size"] else 0)
        own = of_source.setdefault(r["source"], [0, r["target"], 0])
        own[0] += copies.get(i, 0) * r["size"]
        own[2] = max(own[2], r["size"])
    assert all(abs(taken - target) <= largest / 2 + 1 for taken, target, largest in of_source.values())


def test_sequences_hold_every_copy(stages):
    rows = stages[4].collect()
    assert sum(r["start"] == 0 for r in rows) == stages[3].count()
    seats: dict = {}
    for r in rows:
        seats.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in seats.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_is_the_stages(spark, corpus, stages):
    digest = lambda df: sorted(hashlib.sha256(repr((r["doc_id"], r["piece"], r["length"], r["ids_crc32"])).encode()).hexdigest() for r in df.collect())
    assert digest(corpus_pipeline.run(spark, corpus[0])) == digest(stages[4])


def test_stages_of_nothing(spark, corpus):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus[0])
        assert docs.count() == 0
        docs = spark.createDataFrame([], DOCS)


def test_queries_run_over_whole_tables(spark, corpus):
    folder, docs, _ = corpus
    for name, query in queries().items():
        if name == "op5_voronoi_topk":
            continue
        if name == "op13_filter_interactions":
            assert query(spark, folder).where("step = 1").groupBy("filter_order").agg(F.sum(F.col("kept") + F.col("removed")).alias("n")).select("n").distinct().collect() == [(len(docs),)]
            continue
        rows = query(spark, folder)
        assert rows.select("doc_id").distinct().count() == len(docs), name
        if not name.startswith("op1_"):
            assert rows.count() == len(docs), name
    assert set(queries()) == {q for q in queries() if q.startswith("op")} and len(queries()) == 13


def test_scores_and_grades_are_finite(spark, corpus):
    rows = queries()["op3_kneser_ney_scoring"](spark, corpus[0])
    assert rows.where(F.isnan("score") | F.col("score").isNull() | (F.col("score") > 0)).isEmpty()
