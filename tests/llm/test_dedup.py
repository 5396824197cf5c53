from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from addrloom.llm import bloom, components, linededup, simhash, suffix, textkit

SCHEMA = "doc_id bigint, text string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sentences(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


# --- words and hashes


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("aB\t\n é\x0b\x1c ,", max_size=12), max_size=6))
def test_words(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    starts, ends, bounds = textkit.word_bounds(data, offsets)
    own = [[bytes(data[a:b]) for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(bounds[:-1], bounds[1:])]
    assert own == [r.split() for r in raw]
    hashes = textkit.word_hashes(data, starts, ends)
    flat = [w.lower() for ws in own for w in ws]
    assert {w: h for w, h in zip(flat, hashes)} == dict(zip(flat, hashes)) and len(set(hashes.tolist())) == len(set(flat))


# --- line dedup


def plain_lines(docs):
    keys = {i: [lower(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")] for i, t in docs}
    owners = defaultdict(set)
    for i, own in keys.items():
        for k in own:
            if len(k) >= 20:
                owners[k].add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        out[i] = "\n".join(x for x, k in zip(lines, keys[i]) if len(k) < 20 or len(owners[k]) < 3 or max(owners[k]) == i), len(lines)
    return out


LINE = "This line is shared by many documents"
LINES = [(1, f"{LINE}\nown one"), (2, f"  {LINE.upper()}\t\nown two\n{LINE}"), (3, f"x\n{LINE}\r"), (4, ""), (5, None), (6, "\n\n"), (7, f"{LINE}."), (8, "é" * 19), (9, "é" * 20), (10, "é" * 20), (11, "É" * 20), (12, "é" * 20), (13, "short\nshort"), (14, f"{LINE}\n" * 400), (15, "two of them only, long enough"), (16, "two of them only, long enough")]


def test_lines(spark):
    docs = spark.createDataFrame(LINES, SCHEMA)
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.dedup_lines(docs).collect()}
    for i, (text, n) in plain_lines(LINES).items():
        assert got[i] == (text, n, n - (len(text.split("\n")) if got[i][2] < n else 0)), i


def test_lines_clashes_nulls_repeats(spark):
    rows = [(i, f"{LINE}\n{i}", "a", i) for i in (1, 2, 3, 3)] + [(None, f"{LINE}\nnull", None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA + ", digest string, _s int")
    got = linededup.dedup_lines(docs)
    assert got.columns == ["doc_id", "text", "digest", "_s", "n_lines", "n_dropped"]
    assert sorted((str(r["doc_id"]), r["text"], r["_s"]) for r in got.collect()) == [("1", "1", 1), ("2", "2", 2), ("3", f"{LINE}\n3", 3), ("3", f"{LINE}\n3", 3), ("None", f"{LINE}\nnull", 0)]
    with pytest.raises(ValueError):
        linededup.dedup_lines(docs.withColumnRenamed("_s", "n_lines"))
    assert linededup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lines_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(bloom, "SLICE_KEYS", 5)
    test_lines(spark)


def test_bloom_holds_what_it_was_given():
    keys = np.arange(5000, dtype=np.uint64) * np.uint64(7919)
    bits = bloom.empty(len(keys))
    bloom.add(bits, keys)
    assert bloom.holds(bits, keys).all()
    assert bloom.holds(bits, keys + np.uint64(1)).mean() < 0.02


# --- SimHash


def fingerprint(text: str | None) -> int:
    w = lower(text or "").encode().split()
    grams = [b" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def classes(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components(spark):
    base = sentences(1, 300)
    texts = ["", None, " \n", "one", "one two three", "ONE two three", "one two three four", base, base, base.replace("alpha", "Alpha"), base + " tail end", " ".join(base.split()[:-1]), sentences(2, 300), sentences(3, 40_000)]
    texts += [" ".join(w if i != k else "changed" for i, w in enumerate(base.split())) for k in range(0, 300, 20)]
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)] + [(100, "")], SCHEMA)
    got = simhash.near_duplicates(docs).collect()
    prints = {100 + i: fingerprint(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    assert {r["doc_id"]: r["component_id"] for r in got} == classes(links, prints)
    assert len(got) == len(texts) + 1
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def near(seed: int, n: int) -> list[int]:
    """Fingerprints around few centres, so that many lie at the edge of the distance."""
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(4)]
    return sorted({r.choice(centres) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 7))) for _ in range(n)})


@pytest.mark.parametrize(("run", "block"), [(8192, 4096), (5, 3)])
def test_links_reach_what_all_pairs_reach(spark, monkeypatch, run, block):
    monkeypatch.setattr(simhash, "RUN", run)
    monkeypatch.setattr(simhash, "BLOCK", block)
    prints = near(5, 300)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in prints], "fingerprint bigint")
    edges = [(r["a"], r["b"]) for r in simhash.links(df).collect()]
    nodes = [signed(x) for x in prints]
    every = [(signed(a), signed(b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4]
    assert classes(edges, nodes) == classes(every, nodes)
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in edges)


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randint(100, 400), r.randint(100, 400)) for _ in range(150)] + [(500, 500 + k) for k in range(1, 40)] + [(7, 7)]
    want = classes(edges, {x for e in edges for x in e})
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and {k for k in want if k not in got} <= {a for a, b in edges if a == b}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- suffix arrays


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 4), st.lists(st.integers(1, 4), max_size=70))
def test_suffix_array_steps(k, values):
    text = np.array([min(v, k) for v in values] + [0])
    assert suffix.suffix_array(text, k + 1).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


@pytest.mark.parametrize("seed", range(8))
def test_suffix_array_buckets(seed):
    r = random.Random(seed)
    text = np.array([r.randint(1, 1 + seed % 4) for _ in range(600)] + [0])
    assert (len(text) > 40 * 6) and suffix.suffix_array(text, 6).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=1, max_size=40).map(lambda b: bytes(97 + x % 2 for x in b)), st.integers(1, 2)), min_size=1, max_size=6), st.integers(2, 6))
def test_repeated_windows(strings, length):
    texts, weights = [s for s, _ in strings], np.array([w for _, w in strings])
    sources = np.arange(len(texts)) * 1000
    where = defaultdict(set)
    for t, s, w in zip(texts, sources, weights):
        for p in range(len(t) - length + 1):
            where[t[p : p + length]].add((s + p, 0))
            if w > 1:
                where[t[p : p + length]].add((s + p, 1))
    got = suffix.repeated_windows(texts, sources, weights, length)
    assert [g.tolist() for g in got] == [[p for p in range(len(t) - length + 1) if len(where[t[p : p + length]]) > 1] for t in texts]


def test_windows_at_one_place_do_not_repeat_each_other():
    got = suffix.repeated_windows([b"abcdefgh", b"cdefghij"], np.array([0, 2]), np.array([1, 1]), 4)
    assert [g.tolist() for g in got] == [[], []]


def plain_removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for t in raw:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] += 1
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        out.append((len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), bytes(x for x, g in zip(t, gone) if not g)))
    return out


def passages(length: int) -> list[str | None]:
    shared, other = sentences(9, length // 4), sentences(10, length // 5)
    texts: list[str | None] = ["", None, "short", "a" * (length - 1), "b" * length, "c" * (length + 1), "d" * (3 * length), "é" * length, shared, shared, "x" + shared]
    texts += [f"{sentences(20 + i, 30)} {shared[i:]} {sentences(40 + i, 20)}" for i in range(12)]
    texts += [f"{other} {sentences(60, 50)} {other}", "ab" * length, sentences(70, 20 * length), sentences(70, 20 * length)[7:], sentences(80, 30)]
    return texts


@pytest.mark.parametrize(("length", "gram", "step", "group"), [(400, 16, 64, 6000), (60, 8, 16, 6000), (60, 8, 7, 2), (40, 4, 64, 3)])
def test_repeats_against_brute_force(spark, monkeypatch, length, gram, step, group):
    monkeypatch.setattr(suffix, "GROUP_STRINGS", group)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 5000)
    texts = passages(length)
    docs = spark.createDataFrame([(i, t, i, b"x") for i, t in enumerate(texts)], SCHEMA + ", digest int, row binary")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["text"])) for r in suffix.remove_repeats(docs, length, gram, step).collect()}
    want = plain_removed(texts, length)
    for i in range(len(texts)):
        assert got[i] == want[i], (i, got[i][:3], want[i][:3])


def test_repeats_of_rows_and_empty_tables(spark):
    text = sentences(1, 200)
    docs = spark.createDataFrame([(1, text), (1, text), (None, sentences(2, 200))], SCHEMA)
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in suffix.remove_repeats(docs).collect()) == [("1", len(text)), ("1", len(text)), ("None", 0)]
    assert suffix.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_digest_of_what_is_kept(spark):
    text = sentences(3, 100)
    row = suffix.remove_repeats(spark.createDataFrame([(1, text)], SCHEMA)).first()
    assert hashlib.sha256(bytes(row["text"])).hexdigest() == hashlib.sha256(text.encode()).hexdigest()
