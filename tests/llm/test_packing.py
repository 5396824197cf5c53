from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from addrloom.llm import packing, textkit
from addrloom.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


TEXTS = [
    "", None, " \n\t ", "a", "Hello, world! It's don't won't", "wow!! a! !b ! !!!", "x" * 5000, "word " * 3000, "Ünïcode Ⅷ ½ ﬁ é é ́x", "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "汉字 かな 한글 🙂🙃", "a.b. c, d; e: f? g!", "1234 5,678.90",
    "no break space ​ x\u0085y", "Hello, world! It's don't won't", "é, à. —, “q”.",
]


def check(rows, texts, tokenizer, capacity):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, text in enumerate(texts):
        ids = np.array(ids_of(tokenizer, text), "<u4")
        want = [(k, s, min(capacity, len(ids) - s), zlib.crc32(ids[s : s + capacity])) for k, s in enumerate(range(0, len(ids), capacity))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[i]) == want, text
    seats = {}
    for r in rows:
        seats.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in seats.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seats)


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_pieces_and_seats(spark, tokenizer, capacity):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA)
    rows = packing.pack_documents(docs, tokenizer_path(), capacity).collect()
    total = sum(len(ids_of(tokenizer, t)) for t in TEXTS)
    assert check(rows, TEXTS, tokenizer, capacity) <= 1 + -(-total // capacity)


def test_empty_table_and_other_columns(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), tokenizer_path()).count() == 0
    docs = spark.createDataFrame([(1, "a b", "x", 2)], SCHEMA + ", rank string, length int")
    assert packing.pack_documents(docs, tokenizer_path()).count() == 1


def test_repeated_rows_are_pieces_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], SCHEMA)
    rows = packing.pack_documents(docs, tokenizer_path(), 3).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 3


def test_buckets_keep_ranks_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECES_PER_BUCKET", 3)
    pieces = spark.createDataFrame([(i, 0, 0, 5 if i < 40 else 3, i) for i in range(60)], packing.PIECES)
    ranks = sorted((r["length"], r["rank"]) for r in packing.ranked(pieces, 60).collect())
    assert ranks == [(3, i) for i in range(20)] + [(5, i) for i in range(40)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20), st.integers(50, 60))
def test_plan_is_best_fit_decreasing(histogram, capacity):
    plan = packing.plan_slots(histogram, capacity)
    fill: dict[int, list] = {}
    for length, rank, bins, each, start, offset in plan.tolist():
        for b in range(bins):
            fill.setdefault(start + b, []).append((offset, each * length))
    for own in fill.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= capacity
    for length, n in histogram.items():
        ranks = sorted((r, b * e) for x, r, b, e, *_ in plan.tolist() if x == length)
        at = 0
        for r, size in ranks:
            assert r == at
            at += size
        assert at == n
    rooms: list[int] = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [i for i, r in enumerate(rooms) if r >= length]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= length
            else:
                rooms.append(capacity - length)
    assert len(fill) == len(rooms)


def test_cache_starts_afresh(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    cache = packing.WordCache(tokenizer_path())
    for text in ("one two three four five", "six seven! eight nine ten", "one! two! a! b!", "one six"):
        raw = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _ = textkit.word_bounds(raw, np.array([0, len(raw)]))
        assert cache.ids_of(raw, starts, ends)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
