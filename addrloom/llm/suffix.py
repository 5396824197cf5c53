"""Exact repeated-passage removal with suffix arrays built by induced sorting.

``suffix_array`` classifies suffixes, sorts the leftmost-smaller (LMS) substrings
by induction, recurses on their names, and induces the full order. The first
level, whose alphabet is bytes, induces whole buckets at a time with array
operations; the recursive levels, with large alphabets and at most half the
length, step through their suffixes. ``permuted_lcp`` computes the common
prefix of each suffix with its predecessor in text order: only irreducible
places are compared, the rest follow by subtracting one.

``repeated_spans`` finds, over all documents, the bytes that are covered by a
string of ``length`` bytes that also starts elsewhere. Documents meet in shards
by anchors: the anchor of a window of ``length`` bytes is the place inside it
whose gram has the least hash, so equal windows have equal anchors at equal
distances. An anchor's windows go by steps of that distance into cells, and the
bytes that all windows of a cell share are its core: cells whose core lies
nowhere else hold no repeat. Bloom filters spare such cells the shuffle. Equal
cell texts are one string with a weight; a string of weight 2 repeats
throughout, and the suffix array of a shard decides for each string in whose
company, by its core, another text was found, which of its windows repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, store, textkit

LENGTH, GRAM, STEP = 400, 16, 64
#: Bytes that one suffix array takes.
SHARD_BYTES = 1 << 20
#: Strings of one core that meet in one array; more are first parted into cells with longer cores, NARROWER times smaller.
GROUP_STRINGS, NARROWER = 2_000, 8


# --- suffix arrays


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (S), False where larger (L). The last is the sentinel, S."""
    n = len(text)
    step = np.sign(text[1:].astype(np.int64) - text[:-1])
    at = np.where(step != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    s = np.ones(n, bool)
    s[:-1] = np.where(nxt < n, step[np.minimum(nxt, n - 2)] > 0, False) if n > 1 else True
    return s


def _spread(sa: np.ndarray, bound: np.ndarray, found: np.ndarray, chars: np.ndarray, down: bool) -> None:
    """Put ``found`` in order into the buckets of ``chars``, forwards from or backwards to ``bound``."""
    order = np.argsort(chars, kind="stable")
    c = chars[order]
    first = np.concatenate(([True], c[1:] != c[:-1]))
    start = np.flatnonzero(first)
    within = np.arange(len(c)) - np.repeat(start, np.diff(np.append(start, len(c))))
    sa[bound[c] - 1 - within if down else bound[c] + within] = found[order]
    counts = np.diff(np.append(start, len(c)))
    bound[c[start]] += -counts if down else counts


def _induce_buckets(text: np.ndarray, s: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffix order from LMS suffixes in order, whole buckets at a time."""
    n, k = len(text), len(sizes)
    sa = np.full(n, -1, np.int64)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    tails = ends.copy()
    _spread(sa, tails, lms[::-1], text[lms[::-1]], True)
    fixed = tails.copy()
    fill = heads.copy()
    for c in range(k):
        at = heads[c]
        while at < fill[c]:
            batch, at = sa[at : fill[c]], fill[c]
            batch = batch[batch > 0] - 1
            batch = batch[~s[batch]]
            if len(batch):
                _spread(sa, fill, batch, text[batch], False)
        batch = sa[fixed[c] : ends[c]]
        batch = batch[batch > 0] - 1
        batch = batch[~s[batch]]
        if len(batch):
            _spread(sa, fill, batch, text[batch], False)
    sa[0] = n - 1
    tails = ends.copy()
    for c in range(k - 1, -1, -1):
        at = ends[c]
        while tails[c] < at:
            batch, at = sa[tails[c] : at][::-1], tails[c]
            batch = batch[batch > 0] - 1
            batch = batch[s[batch]]
            if len(batch):
                _spread(sa, tails, batch, text[batch], True)
        batch = sa[heads[c] : fill[c]][::-1]
        batch = batch[batch > 0] - 1
        batch = batch[s[batch]]
        if len(batch):
            _spread(sa, tails, batch, text[batch], True)
    return sa


def _induce_steps(text: np.ndarray, s: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same, one suffix after the other, for large alphabets.

    The list holds for each suffix the one before it in the text, and -1 both for none
    and for a place still empty; the last symbol is of the other type in either pass,
    so that index skips itself. Each pass writes ahead of where it reads.
    """
    n = len(text)
    ends = np.cumsum(sizes)
    array = np.zeros(n, np.int64)
    _spread(array, ends.copy(), lms[::-1], text[lms[::-1]], True)
    sa = (array - 1).tolist()
    bucket = np.where(s, -1, text).tolist()
    free = (ends - sizes).tolist()
    for j in sa:
        c = bucket[j]
        if c >= 0:
            k = free[c]
            sa[k] = j - 1
            free[c] = k + 1
    bucket = np.where(s, text, -1)
    bucket[-1] = -1
    bucket = bucket.tolist()
    free = ends.tolist()
    for j in reversed(sa):
        c = bucket[j]
        if c >= 0:
            k = free[c] - 1
            sa[k] = j - 1
            free[c] = k
    out = np.array(sa, np.int64) + 1
    out[0] = n - 1
    return out


def _names(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Rank of each LMS substring (by text position), given their order; equal ones share a name."""
    n = len(text)
    length = np.empty(n, np.int64)
    length[lms] = np.append(np.diff(lms), 0) + 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    same[0:1] = False  # the sentinel is alone
    left, k = np.flatnonzero(same), 0
    while len(left):
        differs = text[np.minimum(a[left] + k, n - 1)] != text[np.minimum(b[left] + k, n - 1)]
        same[left[differs]] = False
        left = left[~differs]
        k += 1
        left = left[length[a[left]] > k]
    name = np.empty(n, np.int64)
    name[order] = np.concatenate(([0], np.cumsum(~same)))
    return name[lms], int((~same).sum()) + 1


def suffix_array(text: np.ndarray, alphabet: int) -> np.ndarray:
    """Order of the suffixes of ``text``, whose last symbol is 0 and occurs once; symbols are below ``alphabet``."""
    n = len(text)
    if n <= 2:
        return np.arange(n - 1, -1, -1)
    s = _types(text)
    lms = np.flatnonzero(s & ~np.concatenate(([True], s[:-1])))
    sizes = np.bincount(text, minlength=alphabet)
    induce = _induce_buckets if alphabet * 40 < n else _induce_steps
    rough = induce(text, s, lms, sizes)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = rough[is_lms[rough]]
    names, count = _names(text, lms, order)
    if count < len(lms):
        order = lms[suffix_array(names, count)]
    return induce(text, s, order, sizes)


def permuted_lcp(text: np.ndarray, sa: np.ndarray, room: np.ndarray, cap: int) -> np.ndarray:
    """For each position, the common prefix of its suffix with the one before it in order.

    Prefixes end where ``room`` (symbols left in a string) ends, and are counted up
    to ``cap`` where a comparison starts. A place is reducible if the symbols before
    it and before its predecessor agree: its prefix is that of the place before it
    less one.
    """
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    irreducible = np.ones(n, bool)
    inner = (at > 0) & (phi > 0)
    irreducible[inner] = (text[at[inner] - 1] != text[phi[inner] - 1]) | (phi[at[inner] - 1] != phi[inner] - 1)
    irreducible[1:] |= room[:-1] == 0  # prefixes end with their string, so none carries over to the next
    todo = np.flatnonzero(irreducible & (phi >= 0))
    lcp = np.zeros(n, np.int64)
    most = np.minimum(np.minimum(room[todo], room[phi[todo]]), cap)
    wide = np.zeros(n + 8, np.uint8)
    wide[:n] = np.minimum(text, 255)
    word = np.lib.stride_tricks.as_strided(wide[: n + 1], (n + 1, 8), (1, 1))
    left, k = np.arange(len(todo)), 0
    while len(left):
        p = todo[left]
        differ = word[np.minimum(p + k, n)] != word[np.minimum(phi[p] + k, n)]
        hit = differ.any(1)
        lcp[p] = np.where(hit, k + differ.argmax(1), k + 8)
        left = left[~hit & (most[left] > k + 8)]
        k += 8
    lcp[todo] = np.minimum(lcp[todo], most)
    # Irreducible values carry on to the reducible places after them.
    last = np.maximum.accumulate(np.where(irreducible, at, 0))
    return np.maximum(lcp[last] - (at - last), 0)


def repeated_windows(strings: list[bytes], sources: np.ndarray, weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string, the offsets of windows of ``length`` bytes that repeat.

    ``sources`` names the place in the corpus at which a string starts: windows at the
    same place are one and don't repeat each other. A string of weight 2 or more
    stands for several places, so its windows repeat.
    """
    sizes = np.array([len(x) for x in strings], np.int64)
    start = np.cumsum(sizes + 1) - sizes - 1
    text = np.ones(int((sizes + 1).sum()) + 1, np.int64)
    text[-1] = 0
    which = np.repeat(np.arange(len(strings)), sizes + 1)
    body = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 2
    text[:-1] = body
    text[start + sizes] = 1
    n = len(text)
    room = np.zeros(n, np.int64)
    room[:-1] = np.repeat(start + sizes, sizes + 1) - np.arange(n - 1)
    sa = suffix_array(text, 258)
    same = permuted_lcp(text, sa, room, 1 << 40)[sa] >= length
    # Runs of suffixes in order that share a window.
    full = room[sa] >= length
    run = np.cumsum(~same)
    pos, run = sa[full], run[full]
    place = sources[which[pos]] + pos - start[which[pos]]
    several = np.zeros(int(run.max()) + 1 if len(run) else 0, bool)
    several[run[weights[which[pos]] > 1]] = True
    first = np.concatenate(([True], run[1:] != run[:-1])) if len(run) else np.zeros(0, bool)
    head = np.repeat(place[first], np.diff(np.append(np.flatnonzero(first), len(run)))) if len(run) else place
    several[run[place != head]] = True
    hit = pos[several[run]] if len(run) else pos
    hit.sort()
    edge = np.searchsorted(hit, np.append(start, n))
    return [hit[a:b] - s for a, b, s in zip(edge[:-1], edge[1:], start)]


# --- anchors


def _gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` bytes, a power of two, by doubling."""
    h, size, odd = textkit.BYTE_HASH[text], 1, np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while size < gram:
            h = h[:-size] * odd + (h[size:] ^ (h[size:] >> np.uint64(29)))
            h ^= h >> np.uint64(32)
            size *= 2
    return textkit.mix64(h)


#: Window starts that are searched at once; a place among them fits the low bits of a key.
STRETCH, PLACE_BITS = 1 << 18, np.uint64(24)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, its hash, first window, last window) of all windows of ``length`` bytes within a document.

    A window's anchor is the leftmost of its grams with the least leading 40 bits of
    the hash, which depends on the window's bytes alone.
    """
    width, low_bits = length - gram + 1, (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    end_of = np.repeat(offsets[1:], np.diff(offsets))
    found = []
    for s in range(0, len(data) - length + 1, STRETCH):
        part = data[s : s + STRETCH + length - 1]
        h = _gram_hashes(part, gram)
        key = (h & ~low_bits) | np.arange(len(h), dtype=np.uint64)
        size, low = 1, key
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        n, gap = len(key) - width + 1, width - size
        at = (np.minimum(low[:n], low[gap : gap + n]) & low_bits).astype(np.int64)
        inside = np.arange(s, s + n) + length <= end_of[s : s + n]
        edge = np.ones(n, bool)
        edge[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(edge)
        last = np.append(first[1:], n) - 1
        keep = inside[first]
        first, last = first[keep], last[keep]
        found.append((at[first] + s, h[at[first]], first + s, last + s))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none
    return tuple(np.concatenate(c) for c in zip(*found))  # type: ignore[return-value]


# --- over all documents

#: A cell of windows: hash of its core, hash of its text, first window and number of windows.
CELL = np.dtype([("core", "<i8"), ("text", "<i8"), ("lo", "<i8"), ("n", "<i4")])


def _base(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True) >> 1


def cells(raw: bytes, at: int, end: int, found: tuple[np.ndarray, ...], length: int, step: int) -> np.ndarray:
    """The cells of one document's anchors, lo counted from its start ``at``."""
    hash64, out = xxhash.xxh3_64_intdigest, []
    for p, h, s0, s1 in zip(*(x.tolist() for x in found)):
        for j in range((p - s1) // step, (p - s0) // step + 1):
            lo, hi = max(s0, p - step * (j + 1) + 1), min(s1, p - step * j)
            core = hash64(raw[p - step * j : max(0, p - step * (j + 1) + 1 + length)], h ^ j)  # empty for steps beyond the length
            out.append((core, hash64(raw[lo : hi + length], core ^ (p - lo)), lo - at, hi - lo + 1))
    table = np.zeros(len(out), CELL)
    if out:
        core, text, lo, n = zip(*out)
        table["core"], table["text"] = np.array(core, np.uint64).view(np.int64), np.array(text, np.uint64).view(np.int64)
        table["lo"], table["n"] = lo, n
    return table


def packed_cells(texts: DataFrame, length: int, gram: int, step: int) -> DataFrame:
    """(digest, cells) of each text; one that a task meets again in a batch is passed over."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            data, offsets = textkit.byte_column(batch.column(0))
            for _, _, part, at in textkit.chunks(data, offsets):
                found = anchors(part, at, length, gram)
                raw = part.tobytes()
                edge = np.searchsorted(found[2], at)
                digests, made = [], []
                for i in np.flatnonzero(np.diff(edge)).tolist():
                    digest = hashlib.md5(raw[at[i] : at[i + 1]]).digest()
                    if digest not in seen:
                        seen.add(digest)
                        digests.append(digest)
                        made.append(cells(raw, int(at[i]), int(at[i + 1]), tuple(x[edge[i] : edge[i + 1]] for x in found), length, step).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(made, pa.binary())], ["digest", "cells"])

    return texts.select("text").mapInArrow(find, "digest binary, cells binary")


OCCURRENCES = "core long, text long, digest binary, lo long, n int, place long"


def suspected(packed: DataFrame) -> DataFrame:
    """(core, text, digest, lo, n, place) of the cells whose core a filter holds twice."""

    total = packed.agg(F.sum(F.octet_length("cells")).alias("n")).first()["n"] or 0
    folder, slices = bloom.twice(packed.select("cells").mapInArrow(_core_lists, "hashes binary"), total // CELL.itemsize)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(c, CELL) for c in batch.column(1).to_pylist()]
            owner = np.repeat(np.arange(len(own)), [len(c) for c in own])
            table = np.concatenate(own) if own else np.zeros(0, CELL)
            hit = bloom.hits(np.ascontiguousarray(table["core"]).view(np.uint64), slices, folder)
            table, owner = table[hit], owner[hit]
            base = np.array([_base(d) for d in batch.column(0).to_pylist()], np.int64)
            lo = np.ascontiguousarray(table["lo"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(table["core"])), pa.array(np.ascontiguousarray(table["text"])), batch.column(0).take(pa.array(owner)), pa.array(lo), pa.array(np.ascontiguousarray(table["n"])), pa.array(base[owner] + lo)],
                ["core", "text", "digest", "lo", "n", "place"],
            )

    return packed.mapInArrow(pick, OCCURRENCES)


def _core_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [np.frombuffer(c, CELL)["core"] for c in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(own).tobytes() if own else b""], pa.binary())], ["hashes"])


def _spans(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that windows at the sorted ``offsets`` cover."""
    if not len(offsets):
        return offsets, offsets
    first = np.concatenate(([True], offsets[1:] > offsets[:-1] + length))
    return offsets[first], np.append(offsets[:-1][first[1:]], offsets[-1]) + length


STRINGS = "core long, text long, place long, weight int, bytes binary, kinds long"


def _strings(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The texts of (digest, cells: core, text, lo, n, weight), cut from ``texts`` (digest, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            data, offsets = textkit.byte_column(batch.column("text"))
            lists, out = batch.column("cells"), []
            for i, d in enumerate(batch.column("digest").to_pylist()):
                if d == before:
                    continue
                before = d
                raw, base = data[offsets[i] : offsets[i + 1]].tobytes(), _base(d)
                for x in lists[i].as_py():
                    out.append((x["core"], x["text"], base + x["lo"], x["weight"], raw[x["lo"] : x["lo"] + x["n"] + length - 1], x["kinds"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()))], ["core", "text", "place", "weight", "bytes", "kinds"])

    return texts.join(wanted, "digest").select("digest", F.col("body").alias("text"), "cells").mapInArrow(cut, STRINGS)


SPANS = "core long, text long, a long, b long"


def _shard_spans(strings: DataFrame, total: int, length: int) -> DataFrame:
    """Repeated spans of each string by suffix arrays: a shard's cores go into arrays of ``SHARD_BYTES`` each, or of one core."""
    shards = max(1, -(-total // SHARD_BYTES))

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["core", "text"]).sort_values("core", kind="stable")
        core, raw, text, place, weight = (rows[k].to_numpy() for k in ("core", "bytes", "text", "place", "weight"))
        ends = np.append(np.flatnonzero(core[1:] != core[:-1]) + 1, len(core))
        size = np.cumsum([len(x) for x in raw])
        out, a = [], 0
        while a < len(core):
            # Whole cores up to the bytes of an array, one core at least.
            b = int(ends[max(np.searchsorted(ends, a, "right"), np.searchsorted(size[ends - 1], (size[a - 1] if a else 0) + SHARD_BYTES, "right") - 1)])
            for c, t, offsets in zip(core[a:b].tolist(), text[a:b].tolist(), repeated_windows(list(raw[a:b]), place[a:b], weight[a:b], length)):
                out += [(c, t, x, y) for x, y in zip(*_spans(offsets, length))]
            a = b
        textkit.release()
        return pd.DataFrame(out, columns=["core", "text", "a", "b"]).astype("int64")

    return strings.withColumn("shard", F.pmod(F.xxhash64("core"), F.lit(shards))).groupBy("shard").applyInPandas(solve, SPANS)


NARROW = "core long, text long, place long, weight int, bytes binary, n int, outer_core long, outer_text long, at long"


def _narrower(strings: DataFrame, length: int, gram: int, step: int) -> DataFrame:
    """The strings' own cells at a smaller ``step``, and the string and the offset that each comes from."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.byte_column(batch.column("bytes"))
            found, raw = anchors(data, offsets, length, gram), data.tobytes()
            edge = np.searchsorted(found[2], offsets)
            made = [cells(raw, a, b, tuple(x[i:j] for x in found), length, step) for a, b, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), edge[:-1], edge[1:])]
            owner = np.repeat(np.arange(len(made)), [len(m) for m in made])
            table = np.concatenate(made) if made else np.zeros(0, CELL)
            own = {k: batch.column(k).take(pa.array(owner)) for k in ("core", "text", "place", "weight")}
            begin = offsets[owner] + table["lo"]
            cut = pa.array([raw[a : a + n + length - 1] for a, n in zip(begin.tolist(), table["n"].tolist())], pa.binary())
            plain = lambda k: pa.array(np.ascontiguousarray(table[k]))
            yield pa.RecordBatch.from_arrays([plain("core"), plain("text"), pa.array(own["place"].to_numpy(zero_copy_only=False) + table["lo"]), own["weight"], cut, plain("n"), own["core"], own["text"], plain("lo")], ["core", "text", "place", "weight", "bytes", "n", "outer_core", "outer_text", "at"])

    return strings.select("core", "text", "place", "weight", "bytes").mapInArrow(part, NARROW)


def _decide(strings: DataFrame, length: int, gram: int, step: int) -> DataFrame:
    """Repeated spans of (core, text, place, weight, bytes, kinds); cores with more than ``GROUP_STRINGS`` go by narrower cells.

    At a step of one window a cell is its core, so no core has two strings there and
    the recursion ends.
    """
    few = F.col("kinds") <= GROUP_STRINGS
    seen = strings.agg(F.sum(F.when(few, F.octet_length("bytes"))).alias("b"), F.max("kinds").alias("k")).first()
    spans = _shard_spans(strings.where(few), seen["b"] or 0, length)
    if (seen["k"] or 0) <= GROUP_STRINGS:
        return spans
    step = max(1, step // NARROWER)
    parted = store.keep(_narrower(strings.where(~few).dropDuplicates(["core", "text"]), length, gram, step), "narrower")
    met = parted.groupBy("core", "text").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.max("n").alias("n"), F.max("weight").alias("w"))
    met = met.select("core", "text", F.col("first").alias("place"), "n", F.when((F.col("first") < F.col("last")) | (F.col("w") > 1), 2).otherwise(1).alias("weight"))
    kinds = met.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), (F.min("weight") > 1).alias("plain"))
    met = store.keep(met.join(kinds, "core").where("kinds > 1 OR weight > 1"), "narrower-met")
    inner = met.where("weight > 1").select("core", "text", F.lit(0).cast("long").alias("a"), (F.col("n") + F.lit(length - 1)).cast("long").alias("b"))
    mixed = met.where("kinds > 1 AND NOT plain").select("core", "text", "place", "weight", "kinds")
    if not mixed.isEmpty():
        bodies = parted.select("core", "text", "place", "bytes").join(mixed, ["core", "text", "place"]).dropDuplicates(["core", "text"])
        inner = inner.unionByName(_decide(store.keep(bodies.select("core", "text", "place", "weight", "bytes", "kinds"), "bytes"), length, gram, step))
    of = parted.select("core", "text", "outer_core", "outer_text", "at").join(inner, ["core", "text"])
    return spans.unionByName(of.select(F.col("outer_core").alias("core"), F.col("outer_text").alias("text"), (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b")))


def _near(texts: DataFrame, digests: DataFrame) -> DataFrame:
    """``texts`` less almost all whose digest is not in ``digests``: a Bloom filter spares the others the shuffle."""
    folder, slices = bloom.once(digests, "digest")
    return texts.where(bloom.only(F.col("digest"), folder, slices))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, step: int = STEP, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(digest) of the texts that occur twice or more, and (digest, spans: a, b) of texts that occur once and hold repeats.

    A text is known by its MD5. A text of ``length`` bytes or more that occurs twice
    repeats throughout, so it has no spans listed.
    """
    text = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))
    texts = docs.select(text.alias("text")).where(F.octet_length("text") >= length)
    copies = docs.select(F.unhex(F.md5(text.cast("binary"))).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = store.keep(copies.select("digest"), "copies")
    occ = store.keep(suspected(store.keep(packed_cells(texts, length, gram, step), "cells")), "suspected")
    strings = occ.groupBy("core", "text").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.max("n").alias("n"))
    kinds = strings.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.min(F.col("first") < F.col("last")).alias("plain"))
    strings = store.keep(strings.join(kinds, "core").where("kinds > 1 OR first < last").withColumn("weight", F.when(F.col("first") < F.col("last"), 2).otherwise(1)), "strings")
    # A string that lies at several places repeats throughout; arrays are for cores where some string does not.
    mixed = strings.where("kinds > 1 AND NOT plain")
    first = mixed.select("core", "text", "weight", "kinds", F.col("first").alias("place"))
    chosen = store.keep(occ.join(first, ["core", "text", "place"]).dropDuplicates(["core", "text"]).select("digest", "core", "text", "lo", "n", "weight", "kinds"), "chosen")
    hashed = docs.select(text.alias("body")).where(F.octet_length("body") >= length).withColumn("digest", F.unhex(F.md5(F.col("body").cast("binary"))))
    wanted = chosen.groupBy("digest").agg(F.collect_list(F.struct("core", "text", "lo", "n", "weight", "kinds")).alias("cells"))
    spans = _decide(store.keep(_strings(_near(hashed, chosen), wanted, length), "bytes"), length, gram, step)
    alone = strings.where("weight > 1").select("core", "text", F.lit(0).cast("long").alias("a"), (F.col("n") + F.lit(length - 1)).cast("long").alias("b"))
    spans = spans.unionByName(alone)
    of_text = occ.join(spans, ["core", "text"]).select("digest", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b"))
    found = of_text.join(copies, "digest", "left_anti").groupBy("digest").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))
    return copies, found


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, step: int = STEP, column: str = "text") -> DataFrame:
    """``docs`` with ``column`` as bytes less every repeated string of ``length`` bytes, and n_bytes, n_removed, n_spans.

    Each byte goes that is covered by a string of ``length`` bytes that also starts
    anywhere else in the table, the same document included; strings never cross
    documents, and are judged on the input. Removal can cut a character, so the
    result is binary. Null texts are empty; repeated rows are documents of their
    own and so remove each other. A very long text is one string of cells like any
    other; an empty table gives no rows; other columns pass through, but n_bytes,
    n_removed and n_spans may not be there yet.
    """
    if clash := {"n_bytes", "n_removed", "n_spans"} & set(docs.columns):
        raise ValueError(f"{sorted(clash)} are columns already")
    copies, found = repeated_spans(docs, length, gram, step, column)
    found = store.keep(found, "spans")
    raw = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")).cast("binary")
    # The row goes along as one value, so that its other columns may have any names.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), raw.alias("_raw")).withColumn("digest", F.unhex(F.md5("_raw")))
    folder, slices = bloom.once(found.select("digest"), "digest")
    twice, many = bloom.once(copies, "digest")
    rows = rows.withColumn("_maybe", bloom.only(F.col("digest"), folder, slices) | ((F.octet_length("_raw") >= length) & bloom.only(F.col("digest"), twice, many)))

    def apply(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for raws, lists in batches:
            kept, removed, count = [], [], []
            for own, spans in zip(raws, lists):
                own, parts, at, n = own.as_py(), [], 0, 0
                end = -1
                for x in spans.as_py() or ():
                    a, b = x["a"], min(x["b"], len(own))
                    if a > end:
                        n += 1
                        parts.append(own[at:a])
                    end = at = max(end, b)
                parts.append(own[at:])
                kept.append(b"".join(parts))
                removed.append(len(own) - len(kept[-1]))
                count.append(n)
            yield pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array(removed, pa.int64()), pa.array(count, pa.int64())], ["kept", "n_removed", "n_spans"])

    names = docs.columns
    cut = F.arrow_udf(apply, "kept binary, n_removed long, n_spans long")(F.col("_raw"), F.col("spans"))
    size = F.octet_length("_raw").cast("long")
    out = lambda df, kept, removed, spans: df.select(*[kept.alias(c) if c == column else F.col("row").getField(c).alias(c) for c in names], size.alias("n_bytes"), removed.alias("n_removed"), spans.alias("n_spans"))
    zero = F.lit(0).cast("long")
    clean = out(rows.where("NOT _maybe"), F.col("_raw"), zero, zero)
    again = copies.select("digest", F.lit(True).alias("_again"))
    rest = rows.where("_maybe").join(again, "digest", "left").join(found, "digest", "left")
    gone = rest.where(F.col("_again") & (F.octet_length("_raw") >= length))
    gone = out(gone, F.lit(b""), size, F.lit(1).cast("long"))
    part = rest.where(~(F.coalesce("_again", F.lit(False)) & (F.octet_length("_raw") >= length))).withColumn("_c", cut)
    return clean.unionByName(gone).unionByName(out(part, F.col("_c.kept"), F.col("_c.n_removed"), F.col("_c.n_spans")))
