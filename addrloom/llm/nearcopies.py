"""SimHash near copies by the similarity of their five-word shingles: deletion-variant signatures of several fingerprints.

A text is the set of its five-word shingles, lower-cased. At a similarity of 0.8
plain 64-bit fingerprints differ in some ten bits, which no segment survives.
So each shingle votes with a weight drawn from its hash, u ** -2 for a uniform
u: a few shingles decide a fingerprint, and two sets that share those differ in
few bits or none. ``PRINTS`` such fingerprints are cut into two segments each. Texts
with an equal segment are compared first; then each distinct segment is indexed
under its one-wildcard variants, so segments that differ in one bit meet in an
equality join, and their texts are compared as far as they are in different
components. A segment that thousands share is so indexed once. Keys have 31 free bits, so chance meetings
stay few over many texts. At a similarity of 0.81, 99 of 100 pairs meet or more (in
500 made pairs); README says more.

Texts that meet are verified: first by size and by the bits of an unweighted
fingerprint, which rule out what is far off, then over whole sets. Where so many
meet that their pairs would outgrow them, all are compared with the most central
one first. What is then in different components is compared in full where its sets
are brought together, and only the links that join components leave the task: no
pairs are listed, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom, store, textkit
from . import components as cc

SHINGLE, SEED = 5, 42
#: Weighted fingerprints of a text, and the bits and first bits of their segments.
PRINTS, WIDTH, STARTS = 4, 32, (0, 32)
#: Differing bits of the unweighted fingerprints beyond which no pair is verified; at 0.8 they differ in 10, by 3 more or less.
FAR = 20
#: Texts of a variant whose pairs are listed at once, and those whose pairs a task counts.
SMALL, RUN = 8, 8192
#: Pairs to each text that a round may list; rounds of central texts before the others are compared in full.
FEW, ROUNDS = 4, 1
#: Texts and shingles of a variant that are one part, of which a task compares two in full.
LISTED, SHINGLES = 8192, 1 << 20
#: Nodes to a file.
SLICE = 1_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending hashes of its distinct shingles); all words of a shorter text are one shingle, no words are none."""
    data, offsets = textkit.byte_column(column)
    for row, end, raw, at in textkit.chunks(data, offsets):
        starts, ends, first = textkit.word_bounds(raw, at)
        words = textkit.word_hashes(raw, starts, ends, lower=False)

        def joined(words: np.ndarray, width: int) -> np.ndarray:
            n = max(0, len(words) - width + 1)
            out = np.full(n, width, np.uint64)
            with np.errstate(over="ignore"):
                for k in range(width):
                    out = out * _STEP + words[k : n + k]
            return textkit.mix64(out)

        whole = joined(words, width)
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            if b - a >= width:
                yield row + i, np.unique(whole[a : b - width + 1])
            else:
                yield row + i, joined(words[a:b], max(1, b - a))


def identity(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A digest of doc_id and text, null ones included: rows that share it are equal in both."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit(" "), F.coalesce(F.col(text).cast("string"), F.lit("")))))


def _lists(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _node(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), SEED)


def prints_of(own: np.ndarray) -> np.ndarray:
    """The unweighted fingerprint of a set of hashes, then the weighted ones."""
    if not len(own):
        return np.zeros(PRINTS + 1, np.uint64)
    with np.errstate(over="ignore"):
        salts = np.arange(1, PRINTS + 2, dtype=np.uint64) * _STEP
        bits = textkit.mix64((own[None, :] ^ salts[:, None]).ravel())
        u = ((textkit.mix64(bits + _STEP) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
    weight = 1 / (u * u)
    weight[: len(own)] = 1
    # A vote is added to the byte value that holds its bits: eight sums a shingle in place of 64.
    cell = bits.view(np.uint8).reshape(-1, 8).astype(np.int64) + (np.arange(8) << 8)[None, :] + np.repeat(np.arange(PRINTS + 1) << 11, len(own))[:, None]
    votes = np.bincount(cell.ravel(), np.repeat(weight, 8), (PRINTS + 1) << 11).reshape(PRINTS + 1, 8, 256) @ _BYTE_BITS
    total = weight.reshape(PRINTS + 1, -1).sum(1)
    return np.packbits((votes * 2 > total[:, None, None]).reshape(PRINTS + 1, 64), axis=1, bitorder="little").view(np.uint64).ravel()


def nodes_of(docs: DataFrame) -> DataFrame:
    """(row, doc_id, node, n, sketch, prints) of every row: its identity, its set's digest and size, and the fingerprints."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, made, known = [], [], [], {}
            for _, own in shingle_sets(batch.column(2)):
                node = _node(own)
                if node not in known:
                    known[node] = prints_of(own)
                nodes.append(node)
                sizes.append(len(own))
                made.append(known[node])
            prints = np.array(made, np.uint64).reshape(-1, PRINTS + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(np.ascontiguousarray(prints[:, 0]).view(np.int64)), _lists(list(prints[:, 1:]))], ["row", "doc_id", "node", "n", "sketch", "prints"])

    read = docs.select(identity().alias("row"), F.col("doc_id").cast("long"), F.lower(F.col("text").cast("string")).alias("text"))
    return read.mapInArrow(compute, "row binary, doc_id long, node long, n long, sketch long, prints array<long>")


def segments(nodes: DataFrame) -> DataFrame:
    """(seg, node): the segments of each fingerprint in (node, prints); the last byte of ``seg`` names fingerprint and segment."""
    each = nodes.select("node", F.posexplode("prints").alias("_r", "_p"))
    made = []
    for i, start in enumerate(STARTS):
        value = F.shiftrightunsigned("_p", start).bitwiseAND(F.lit((1 << WIDTH) - 1))
        made.append(F.shiftleft(value, 8).bitwiseOR(F.col("_r").cast("long") * len(STARTS) + i))
    return each.select(F.explode(F.array(*made)).alias("seg"), "node")


def variants(segs: DataFrame) -> DataFrame:
    """(key, low, high): the one-wildcard variants that two of the distinct ``seg`` have in common, those with the wildcard bit unset and set.

    A variant has one bit free, so no more than two segments have it, whatever the
    number of texts under them.
    """
    value, name = F.shiftright("seg", 8), F.col("seg").bitwiseAND(F.lit(255))
    made = []
    for k in range(WIDTH):
        kept = value.bitwiseAND(F.lit(((1 << WIDTH) - 1) & ~(1 << k)))
        key = F.shiftleft(kept, 14).bitwiseOR(name).bitwiseOR(F.lit(k << 8))
        made.append(F.struct(key.alias("key"), (F.shiftright(value, k).bitwiseAND(F.lit(1)) + 1).cast("byte").alias("side")))
    # A named number of parts, since small rows that grow 32-fold here should not be gathered into few.
    parts = int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = segs.select(F.explode(F.array(*made)).alias("v")).select("v.*").repartition(parts, "key").groupBy("key").agg(F.bit_or("side").alias("sides")).where("sides = 3")
    low = F.shiftleft(F.shiftright("key", 14), 8).bitwiseOR(F.col("key").bitwiseAND(F.lit(255)))
    free = F.expr("shiftleft(1L, cast(shiftright(key, 8) & 63 AS int) + 8)")
    return both.select("key", low.alias("low"), low.bitwiseOR(free).alias("high"))


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, list[np.ndarray], bool]]:
    """(keys, other columns, whether it is a part of a run above ``most`` rows) of whole runs of one key, many at a time; parts of a long run come in order."""
    held, over = None, None
    for batch in batches:
        got = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if over is not None:
            n = int(np.searchsorted(got[0] != over, True)) if (got[0] != over).any() else len(got[0])
            if n:
                yield got[0][:n], [c[:n] for c in got[1:]], True
                got = [c[n:] for c in got]
        if not len(got[0]):
            continue
        over = None
        held = got if held is None else [np.concatenate(c) for c in zip(held, got)]
        edge = int(np.flatnonzero(np.concatenate(([True], held[0][1:] != held[0][:-1])))[-1])
        if len(held[0]) - edge > most:
            over = held[0][-1]
        if edge and (edge >= 1 << 15 or over is not None):
            yield held[0][:edge], [c[:edge] for c in held[1:]], False
            held = [c[edge:] for c in held]
        if over is not None:
            yield held[0], held[1:], True
            held = None
    if held is not None and len(held[0]):
        yield held[0], held[1:], False


FOUND = "pair boolean, a long, b long, side byte"


def _batch(pair: bool, a: np.ndarray, b: np.ndarray, side: np.ndarray | None = None) -> pa.RecordBatch:
    if pair and len(a):
        a, b = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0).T
    side = np.zeros(len(a), np.int8) if side is None else side
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), pair)), pa.array(np.ascontiguousarray(a).astype(np.int64)), pa.array(np.ascontiguousarray(b).astype(np.int64)), pa.array(side.astype(np.int8))], ["pair", "a", "b", "side"])


def _within(keys: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs of one key, for keys with up to ``most`` rows."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    length = np.diff(np.append(first, len(keys)))
    few = np.repeat(length <= most, length)
    for d in range(1, most):
        at = np.flatnonzero(few[: max(0, len(keys) - d)])
        at = at[keys[at] == keys[at + d]]
        if not len(at):
            return
        yield at, at + d


def meetings(sets: DataFrame) -> DataFrame:
    """What meets in an equal segment: pairs of nodes (pair, a, b, 0) where few do, else (not pair, key, node, 0) of each; keys may name several segments of the same members."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = segments(sets).select(F.col("seg").alias("key"), "node").repartition(parts, "key").sortWithinPartitions("key")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for key, (node,), long in _runs(batches, RUN):
            if long:
                yield _batch(False, key, node)
                continue
            pairs = list(_within(key, SMALL))
            if pairs:
                yield _batch(True, *(node[np.concatenate(x)] for x in zip(*pairs)))
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            length = np.diff(np.append(first, len(key)))
            sets_of, nodes_of_sets = [], []
            for at in np.flatnonzero(length > SMALL).tolist():
                # Segments with the same members are one.
                own = np.sort(node[first[at] : first[at] + length[at]])
                digest = xxhash.xxh64_intdigest(own.tobytes(), SEED)
                if digest not in known:
                    known.add(digest)
                    sets_of.append(np.full(len(own), digest, np.uint64).view(np.int64))
                    nodes_of_sets.append(own)
            if sets_of:
                yield _batch(False, np.concatenate(sets_of), np.concatenate(nodes_of_sets))

    with store.short_rows(sets.sparkSession):
        return store.keep(keys.mapInArrow(meet, FOUND), "meetings")


def crossings(sets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(not pair, key, node, side) of what meets under a variant of segments that differ, after ``meetings`` was followed.

    Equal segments have been compared, so a node appears only if the other segment
    holds a node of another component than its own, and is compared with those of
    the other ``side`` alone: 1 has the wildcard bit unset, 2 set.
    """
    rooted = sets.withColumn("root", F.col("node")) if roots is None else sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = store.keep(rooted.select("node", "root", "prints"), "rooted")
    held = segments(rooted).join(rooted.select("node", "root"), "node")
    span = store.keep(held.groupBy("seg").agg(F.min("root").alias("x"), F.max("root").alias("y")), "spans")
    side = lambda s: span.select(F.col("seg").alias(s), F.col("x").alias(f"x_{s}"), F.col("y").alias(f"y_{s}"))
    apart = variants(span.select("seg")).join(side("low"), "low").join(side("high"), "high").where(F.least("x_low", "x_high") < F.greatest("y_low", "y_high"))
    apart = store.keep(apart, "apart")
    across = lambda s, o, k: apart.select("key", F.col(s).alias("seg"), F.col(f"x_{o}").alias("x"), F.col(f"y_{o}").alias("y"), F.lit(k).cast("byte").alias("side"))
    found = across("low", "high", 1).unionByName(across("high", "low", 2)).join(held, "seg").where("x <> root OR y <> root")
    return store.keep(found.select(F.lit(False).alias("pair"), F.col("key").alias("a"), F.col("node").alias("b"), "side"), "crossings")


def _near(n: np.ndarray, m: np.ndarray, f: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether sizes and unweighted fingerprints leave a similarity of 0.8 possible."""
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (np.bitwise_count(f ^ g) <= FAR)


def _other(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Whether two sides are to be compared: those of an equal segment, 0, or of two that differ."""
    return (s != t) | (s == 0)


def _centre(sketch: np.ndarray, root: np.ndarray, k: int) -> int:
    """The place of a member outside the largest component whose fingerprint is near to what most of those have: the ``k``-th nearest.

    Copies of one text differ less from it than from each other, so a star around it links them.
    """
    _, inverse, size = np.unique(root, return_inverse=True, return_counts=True)
    at = np.flatnonzero(inverse != size.argmax()) if size.max() > 1 else np.arange(len(root))
    own = sketch[at]
    most = np.packbits(np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0) * 2 > len(own), bitorder="little").view(np.uint64)[0]
    return int(at[np.argsort(np.bitwise_count(own ^ most), kind="stable")[min(k, len(at) - 1)]])


def open_pairs(held: DataFrame, k: int) -> DataFrame:
    """Of (key, node, n, sketch, root, side): pairs in different components that may be alike, and the members of variants that still have others.

    A variant with few such pairs has them all listed; of one with many, those of its
    centre, so that the pairs are at most ``FEW`` times the members.
    """
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = held.select("key", F.xxhash64(F.lit(k), "node").alias("h"), "node", "n", "sketch", "root", "side").repartition(parts, "key").sortWithinPartitions("key", "h")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None
        for key, (_, node, n, sketch, root, side), long in _runs(batches, RUN):
            sketch = np.ascontiguousarray(sketch).view(np.uint64)
            if long:
                if lead is None or lead[0] != key[0]:
                    c = _centre(sketch, root, k)
                    lead = (key[0], node[c], n[c], sketch[c], root[c], side[c])
                hit = (root != lead[4]) & _other(side, lead[5]) & _near(n, lead[2], sketch, lead[3])
                yield _batch(True, np.full(int(hit.sum()), lead[1]), node[hit])
                yield _batch(False, key, node, side)
                continue
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            a, b, again = [], [], []
            for s, e in zip(first.tolist(), np.append(first[1:], len(key)).tolist()):
                if (root[s:e] == root[s]).all():
                    continue
                left, right, count = [], [], 0
                for i in range(s, e - 1):
                    hit = i + 1 + np.flatnonzero((root[i + 1 : e] != root[i]) & _other(side[i + 1 : e], side[i]) & _near(n[i + 1 : e], n[i], sketch[i + 1 : e], sketch[i]))
                    count += len(hit)
                    if count > FEW * (e - s):
                        c = s + _centre(sketch[s:e], root[s:e], k)
                        hit = s + np.flatnonzero((root[s:e] != root[c]) & _other(side[s:e], side[c]) & _near(n[s:e], n[c], sketch[s:e], sketch[c]))
                        left, right = [np.full(len(hit), node[c])], [node[hit]]
                        again.append((s, e))
                        break
                    left.append(np.full(len(hit), node[i]))
                    right.append(node[hit])
                a += left
                b += right
            if a:
                yield _batch(True, np.concatenate(a), np.concatenate(b))
            if again:
                at = np.concatenate([np.arange(s, e) for s, e in again])
                yield _batch(False, key[at], node[at], side[at])

    with store.short_rows(held.sparkSession):
        return store.keep(ordered.mapInArrow(find, FOUND), "open")


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes in ``wanted``, which lie in sorted files: texts stay where they are."""
    wanted = store.keep(wanted, "wanted")
    if not (n := wanted.count()):
        return wanted.sparkSession.createDataFrame([], "node long, shingles array<long>")
    slices, folder = max(1, -(-n // SLICE)), store.new_folder(wanted.sparkSession, "nodes")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for batch in batches]
        own = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        at = (own >> np.uint64(1)) % np.uint64(slices)
        for k in np.unique(at).tolist():
            store.put(f"{folder}/{k}", own[at == k].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([len(own)], pa.int64())], ["n"])

    wanted.select("node").repartition(slices, F.pmod(F.shiftrightunsigned("node", 1), F.lit(slices))).mapInArrow(write, "n long").agg(F.sum("n")).first()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for _, own in shingle_sets(batch.column(0)):
                node = np.uint64(_node(own))
                raw = store.mapped(f"{folder}/{(int(node) >> 1) % slices}")
                if raw is None:
                    continue
                known = raw.view(np.uint64)
                at = int(np.searchsorted(known, node))
                if at < len(known) and known[at] == node:
                    nodes.append(node)
                    sets.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), _lists(sets)], ["node", "shingles"])

    texts = docs.select(F.lower(F.col("text").cast("string")).alias("text"))
    return store.keep(texts.mapInArrow(compute, "node long, shingles array<long>").dropDuplicates(["node"]), "sets")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets have a similarity of 0.8 or more."""
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"_{x}")) for x in "ab")
    # Later rounds ask for few sets: only those move, and where they are many the join reuses this one's partitions.
    b = b.join(pairs.select("b").distinct(), "b", "left_semi")
    both = F.size(F.array_intersect("_a", "_b"))
    return store.keep(pairs.join(a, "a").join(b, "b").where(5 * both >= 4 * (F.size("_a") + F.size("_b") - both)).select("a", "b"), "alike")


def joining(group: pa.Table) -> pa.Table:
    """(a, b) of a group of (part, node, n, sketch, root, side, shingles), low and high the same throughout, that are alike: one of each two components that such pairs join.

    Of two parts only members of different ones are compared. Each member is compared
    at once with all later ones that are not in its component by then.
    """
    get = lambda c: group.column(c).to_numpy()
    part, node, n, root, side, sketch = (*map(get, ("part", "node", "n", "root", "side")), np.ascontiguousarray(get("sketch")).view(np.uint64))
    values = group.column("shingles").combine_chunks().flatten().to_numpy()
    start = np.concatenate(([0], np.cumsum(n)))
    values = np.unique(values, return_inverse=True)[1]
    label, seen = np.unique(root, return_inverse=True)[1], np.zeros(int(values.max(initial=-1)) + 1, bool)
    one = group.column("low")[0].as_py() == group.column("high")[0].as_py()
    a, b = [], []
    for i in range(len(node) - 1):
        later = slice(i + 1, None)
        at = (label[later] != label[i]) & _other(side[later], side[i]) & _near(n[later], n[i], sketch[later], sketch[i])
        at = i + 1 + np.flatnonzero(at if one else at & (part[later] != part[i]))
        if not len(at):
            continue
        own, ends = values[start[i] : start[i + 1]], np.cumsum(n[at])
        seen[own] = True
        places = np.repeat(start[at] - (ends - n[at]), n[at]) + np.arange(ends[-1])
        both = np.add.reduceat(seen[values[places]], ends - n[at], dtype=np.int64)
        seen[own] = False
        at = at[5 * both >= 4 * (n[i] + n[at] - both)]
        found, first = np.unique(label[at], return_index=True)
        a.append(np.full(len(found), node[i]))
        b.append(node[at[first]])
        label[np.isin(label, found)] = label[i]
    ends = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)]
    return pa.table({"a": pa.array(np.minimum(*ends)), "b": pa.array(np.maximum(*ends))})


def settled(held: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) that are alike and join components, over all pairs of each key in ``held`` (as ``open_pairs`` has it).

    A key with many texts or shingles is cut into parts, and each two of its parts are
    a group of their own; a group's links are fewer than its members.
    """
    size = held.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / LISTED), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("parts"))
    dealt = held.join(size, "key").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    dealt = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("part", "_with").alias("low"), F.greatest("part", "_with").alias("high"), "part", "node", "n", "sketch", "root", "side")
    return store.keep(dealt.join(sets, "node").groupBy("key", "low", "high").applyInArrow(joining, "a long, b long").distinct(), "settled")


#: What ``links`` knows: (node, root), (node, shingles) fetched so far, and the (a, b) that are alike; None where there are none.
State = tuple[DataFrame | None, DataFrame | None, DataFrame | None]


def links(met: DataFrame, known: DataFrame, docs: DataFrame, state: State = (None, None, None)) -> State:
    """The state after the pairs of ``met`` are followed: components that a similarity of 0.8 or more makes; lone nodes do not appear.

    ``known`` holds (node, n, sketch) of every node, ``met`` what ``meetings`` or ``crossings`` found.
    After ``ROUNDS`` of central texts the variants that are still open are compared in full.
    """
    of = lambda x: known.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"f_{x}"))
    near = (5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b")) & (F.bit_count(F.col("f_a").bitwiseXOR(F.col("f_b"))) <= FAR)
    pairs = met.where("pair").select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b").where(near).select("a", "b")
    member = lambda df: df.where("NOT pair").select(F.col("a").alias("key"), F.col("b").alias("node"), "side")
    members = store.keep(member(met).distinct(), "members")
    roots, sets, found = state

    def fetch(asked: DataFrame) -> None:
        nonlocal sets
        if sets is not None:
            asked = asked.join(sets.select("node"), "node", "left_anti")
        fetched = whole_sets(docs, asked)
        sets = fetched if sets is None else sets.unionByName(fetched)

    def follow(new: DataFrame) -> None:
        nonlocal roots, found
        found = new if found is None else found.unionByName(new)
        if not new.isEmpty():
            roots = store.keep(cc.components(found).distinct(), "roots")

    for k in range(ROUNDS + 1):
        left = not members.isEmpty()
        if left:
            held = members.join(known, "node")
            held = held.withColumn("root", F.col("node")) if roots is None else held.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
            if k:  # variants whose members are all in one component are done
                held = held.join(held.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key"), "key")
            if k < ROUNDS:
                opened = open_pairs(held, k)
                more = opened.where("pair").select("a", "b")
                pairs = more if pairs is None else pairs.unionByName(more)
                members = member(opened)
            else:
                held = store.keep(held.select("key", "node", "n", "sketch", "root", "side"), "held")
        if pairs is not None:
            pairs = store.keep(pairs.distinct(), "pairs")
            if not pairs.isEmpty():
                asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
                if left and not k:  # and of what later rounds may ask for, so that texts are read once
                    asked = asked.unionByName(members.select("node")).distinct()
                fetch(asked)
                follow(_alike(pairs, sets))
            pairs = None
        if not left:
            break
        if k == ROUNDS and not held.isEmpty():
            fetch(held.select("node").distinct())
            follow(settled(held, sets))
    return roots, sets, found


def near_copies(docs: DataFrame) -> DataFrame:
    """(row, doc_id, component) of every row: its identity and the group of texts that similarities of 0.8 or more link.

    Texts without words, null ones included, are one group; a text of fewer than five
    words is one shingle. Case and spacing do not count. A null or repeated doc_id is
    no matter, since rows go by ``identity``; an empty table gives no rows. A pair that
    meets is decided exactly but for 64-bit hashes of shingles and of sets.
    """
    rows = store.keep(nodes_of(docs), "nodes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = rows.repartition(parts, "node").groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("prints").alias("prints"))
    known = store.keep(sets, "known")
    sets, known = known.select("node", "prints"), known.select("node", "n", "sketch")
    state = links(meetings(sets), known, docs)
    roots, _, _ = links(crossings(sets, state[0]), known, docs, state)
    if roots is None:
        return rows.select("row", "doc_id", F.col("node").alias("component"))
    return store.keep(rows.select("row", "doc_id", "node").join(roots, "node", "left").select("row", "doc_id", F.coalesce("root", "node").alias("component")), "copies")


def first_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` less all but one row of each group: the one with the least doc_id stays.

    Any doc_id comes before none, and among equal ones a digest of the text decides.
    Rows that are equal in doc_id and text are copies of each other too. Other
    columns pass through. Texts that lose no row to a group stay where they are: a
    Bloom filter tells them from the few whose row is looked up.
    """
    rows = near_copies(docs)
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("s")).select(F.col("s.row").alias("row"), F.lit(True).alias("first"))
    counts = rows.groupBy("row").agg(F.count(F.lit(1)).alias("n")).join(first, "row", "left").where("first IS NULL OR n > 1")
    touched = store.keep(counts.select("row", F.coalesce("first", F.lit(False)).alias("stays")), "touched")
    if touched.isEmpty():
        return docs
    folder, slices = bloom.once(touched, "row")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), identity().alias("_row")).withColumn("_maybe", bloom.only(F.col("_row"), folder, slices))
    looked = marked.where("_maybe").join(touched.withColumnRenamed("row", "_row"), "_row", "left").where("coalesce(stays, true)")
    again = looked.where("stays").dropDuplicates(["_row"])
    out = marked.where("NOT _maybe").select("_doc").unionByName(looked.where("stays IS NULL").select("_doc")).unionByName(again.select("_doc"))
    return out.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
