from __future__ import annotations

import itertools
import random

import pyarrow as pa

import corpus_pipeline
from addrloom.llm import nearcopies

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text: str | None) -> frozenset:
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a: frozenset, b: frozenset) -> bool:
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def kept(spark, rows: list[tuple]) -> list[tuple]:
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], DOCS)
    return [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]


def groups(rows: list[tuple]) -> list[int]:
    """For each row the first row that links reach."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for _ in rows:
        for i, j in itertools.combinations(range(len(rows)), 2):
            if root[i] != root[j] and alike(sets[i], sets[j]):
                root[i] = root[j] = min(root[i], root[j])
    return root


def edited(r: random.Random, words: list[str], edits: int) -> str:
    words = list(words)
    for at in r.sample(range(len(words)), edits):
        words[at] = f"new{r.randrange(10**9)}"
    return " ".join(words)


def test_near_copies_equal_brute_force(spark):
    r, rows = random.Random(8), []
    for _ in range(30):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(3, 300))]
        rows.append(" ".join(words))
        rows += [edited(r, words, r.randint(0, max(1, len(words) // 30))) for _ in range(3)]
    passage = [f"p{k}" for k in range(60)]  # in many texts, of which some hold little else
    rows += [" ".join([*passage, *(f"q{r.randrange(10**6)}" for _ in range(r.randint(2, 40)))]) for _ in range(40)]
    rows += ["", " \n", None, "ONE  two", "one two", "one two three"]
    rows = list(enumerate(rows))
    root = groups(rows)
    got = {i for i, _ in kept(spark, rows)}
    assert got == set(root) and len(got) < len(rows)
    linked = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if root[a] == root[b] and rows[a][1] != rows[b][1]]
    assert len(linked) > 30


def test_rounds_and_remaining_pairs_agree(spark, monkeypatch):
    r = random.Random(9)
    words, rows = [f"w{k}" for k in range(120)], []
    for _ in range(60):  # a chain: far ends are not alike, each link is
        rows.append(" ".join(words))
        words[r.randrange(120)] = f"new{r.randrange(10**9)}"
    rows = list(enumerate(rows))
    want = set(groups(rows))
    for rounds, few in ((12, 0), (12, 4), (0, 4)):
        monkeypatch.setattr(nearcopies, "ROUNDS", rounds)
        monkeypatch.setattr(nearcopies, "FEW", few)
        assert {i for i, _ in kept(spark, rows)} == want


def test_rows_without_or_with_a_repeated_doc_id(spark):
    r = random.Random(10)
    text = lambda n=80: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    base, near, other, lone, twin = text(), text(), text(), text(), text()
    rows = [(None, ""), (1, " "), (None, lone), (None, other)]  # a blank text without doc_id removes no other text
    rows += [(3, base), (7, edited(r, base.split(), 1)), (7, twin)]  # of the two documents 7 one is a copy
    rows += [(None, near), (None, edited(r, near.split(), 1)), (9, text()), (9, text())]
    copy = text()
    rows += [(12, copy), (12, edited(r, copy.split(), 1)), (12, copy), (None, copy)]
    got = kept(spark, rows)
    assert sorted(t for i, t in got if i is None and t in (lone, other)) == sorted([lone, other]) and (None, "") not in got
    assert (1, " ") in got and (3, base) in got and [t for i, t in got if i == 7] == [twin]
    assert sum(i is None for i, _ in got) == 3
    assert sum(i == 9 for i, _ in got) == 2 and sum(i == 12 for i, _ in got) == 1
    assert len(got) == 9


def test_copies_of_one_text_that_are_not_alike_among_themselves(spark, monkeypatch):
    """Each copy is like the original alone; a variant of them all has more pairs than are listed, and long runs go by parts.

    Pairs whose signatures do not meet are left out of what is wanted, and few.
    """
    r = random.Random(11)
    words = [f"w{k}" for k in range(150)]
    rows = list(enumerate([edited(r, words, 3) for _ in range(60)] + [" ".join(words)] + [" ".join(f"x{r.randrange(10**6)}" for _ in range(50)) for _ in range(5)]))
    sets = [shingles(t) for _, t in rows]
    prints = [nearcopies.prints_of(own)[1:] for _, own in nearcopies.shingle_sets(pa.array([t for _, t in rows]))]
    root, pairs, missed = list(range(len(rows))), [], 0
    for i, j in itertools.combinations(range(len(rows)), 2):
        if alike(sets[i], sets[j]):
            differ = [int(x ^ y) for x, y in zip(prints[i], prints[j])]
            meets = any(((d >> s) & 0xFFFFFFFF).bit_count() <= 1 for d in differ for s in (0, 32))
            missed += not meets
            if meets:
                pairs.append((i, j))
    assert missed <= 0.05 * (missed + len(pairs))
    for _ in rows:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    want = set(root)
    assert 6 <= len(want) < 12
    for run, small in ((8192, 8), (16, 4)):
        monkeypatch.setattr(nearcopies, "RUN", run)
        monkeypatch.setattr(nearcopies, "SMALL", small)
        monkeypatch.setattr(nearcopies, "LISTED", 10)
        monkeypatch.setattr(nearcopies, "FEW", 1)
        assert {i for i, _ in kept(spark, rows)} == want


def test_rows_made_grow_no_faster_than_a_group(spark):
    """A large group whose members are in components of their own: later rounds list no more pairs than the first."""
    for size in (100, 200):
        held = spark.range(size).selectExpr("1L AS key", "id AS node", "100L AS n", "0L AS sketch", "id AS root", "CAST(0 AS BYTE) AS side")
        for k in (0, 1):
            assert nearcopies.open_pairs(held, k).count() <= (nearcopies.FEW + 1) * size


def test_settled_joins_what_brute_force_joins(spark, monkeypatch):
    r, base = random.Random(12), list(range(100))
    sets = {}
    for node in range(80):
        own = set(base[: r.choice([60, 100])])
        own -= set(r.sample(sorted(own), r.randint(0, 9)))
        sets[node] = sorted(own | {1000 + 100 * node + k for k in range(r.randint(0, 9))})
    side = {1: lambda _: 0, 2: lambda node: 1 + node % 3 // 2}
    held = [(key, node, len(own), 0, node if node % 10 else 5, side[key](node)) for key in side for node, own in sets.items() if key == 1 or node < 50]
    held = spark.createDataFrame(held, "key bigint, node bigint, n bigint, sketch bigint, root bigint, side byte")
    held = held.unionByName(held.where("key = 2").withColumn("key", held["key"] + 1))
    known = spark.createDataFrame(list(sets.items()), "node bigint, shingles array<bigint>")

    def joined(links: list[tuple], nodes: range) -> list[int]:
        label = {node: node if node % 10 else 5 for node in nodes}
        for a, b in links:
            x, y = label[a], label[b]
            label = {node: min(x, y) if v in (x, y) else v for node, v in label.items()}
        return list(label.values())

    pairs = lambda nodes, sides: [(a, b) for a, b in itertools.combinations(nodes, 2) if sides(a, b) and alike(frozenset(sets[a]), frozenset(sets[b]))]
    apart = pairs(range(50), lambda a, b: side[2](a) != side[2](b))
    for listed, shingles_of_part in ((8192, 1 << 20), (10, 1 << 20), (8192, 1000)):
        monkeypatch.setattr(nearcopies, "LISTED", listed)
        monkeypatch.setattr(nearcopies, "SHINGLES", shingles_of_part)
        for where, nodes, want in (("key = 1", range(80), pairs(range(80), lambda a, b: True)), ("key > 1", range(50), apart)):
            got = [tuple(x) for x in nearcopies.settled(held.where(where), known).collect()]
            assert set(got) <= set(want) and joined(got, nodes) == joined(want, nodes) and 2 < len(set(joined(want, nodes))) < len(nodes) - 10
            if listed == 8192 and shingles_of_part == 1 << 20:
                assert len(got) < len(nodes) <= len(want)
