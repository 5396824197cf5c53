"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ in
at most four bits have a segment that differs in at most one, so for some
position of some segment the two are equal once that bit is a wildcard. Each
fingerprint is indexed under its 64 one-wildcard segment variants; fingerprints
that meet under a variant are verified over all bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components as cc
from . import store, textkit

SHINGLE, SEED, BITS = 4, 42, 4
#: First bit and width of the segments, from the low end.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one variant that a task compares directly, and to a block of the others.
RUN = 8192
BLOCK = 4096


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint long) of every whole text; a text without words has the fingerprint 0."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            data, offsets = textkit.byte_column(batch.column(1))
            textkit.release(len(data))
            raw = data.tobytes().lower()
            out = np.zeros(len(batch), np.uint64)
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                text = b" ".join(raw[a:b].split())
                if not text:
                    continue
                blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                votes, total = np.zeros(64, np.int64), 0
                last = max(1, len(blanks) + 2 - shingle)
                for s in range(0, last, 1 << 16):
                    e = min(last, s + (1 << 16))
                    starts = ([0] if s == 0 else []) + (blanks[max(s - 1, 0) : e - 1] + 1).tolist()
                    ends = blanks[s + shingle - 1 : e + shingle - 1].tolist()
                    ends += [len(text)] * (len(starts) - len(ends))
                    h = np.array([digest(text[x:y], SEED) for x, y in zip(starts, ends)], np.uint64)
                    votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                    total += len(h)
                out[i] = np.packbits(votes * 2 > total, bitorder="little").view(np.uint64)[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(compute, "doc_id long, fingerprint long")


def variants(prints: DataFrame) -> DataFrame:
    """(variant, fingerprint): the 64 one-wildcard segment variants of each fingerprint.

    A variant holds its wildcard's position in the low six bits (which names the
    segment too) and the segment's other bits above.
    """
    f = F.col("fingerprint")
    made = []
    for start, width in SEGMENTS:
        segment = F.shiftrightunsigned(f, start).bitwiseAND(F.lit((1 << width) - 1))
        for k in range(width):
            kept = segment.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << k)))
            made.append(F.shiftleft(kept, 6).bitwiseOR(F.lit(start + k)))
    return prints.select(F.explode(F.array(*made)).alias("variant"), "fingerprint")


def _close(f: np.ndarray, g: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(f ^ g) <= bits


def _tie(f: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked among ``f``: breadth first from each unreached one, so a group gives one link for each further member."""
    left, frm, to = np.arange(len(f)), [], []
    while len(left):
        root, left = left[0], left[1:]
        edge = np.array([root])
        while len(edge) and len(left):
            reached = np.zeros(len(left), bool)
            for x in edge:
                hit = _close(f[left], f[x], bits) & ~reached
                reached |= hit
                frm.append(np.full(int(hit.sum()), x))
                to.append(left[hit])
            edge, left = left[reached], left[~reached]
    return (np.concatenate(frm), np.concatenate(to)) if frm else (left, left)


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b) links between distinct fingerprints whose components are those of all links.

    Fingerprints lie sorted by variant, and each run of one variant is verified
    where it lies; of a group only a spanning set of links leaves the task. Runs
    above ``RUN`` are reported instead and compared block against block.
    """
    if not 0 <= bits <= 5:
        raise ValueError("three segments with one wildcard find up to 5 differing bits")
    made = variants(prints)
    ordered = made.repartition("variant").sortWithinPartitions("variant", "fingerprint")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

        def compare(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            length = np.diff(np.append(first, len(keys)))
            frm, to = [], []
            for d in range(1, 8):  # runs of up to 8, all at once
                at = np.flatnonzero(np.repeat((length > d) & (length <= 8), length))
                at = at[at + d < len(keys)]
                at = at[keys[at] == keys[at + d]]
                at = at[_close(values[at], values[at + d], bits)]
                frm.append(values[at])
                to.append(values[at + d])
            for i in np.flatnonzero(length > 8):
                own = values[first[i] : first[i] + length[i]]
                x, y = _tie(own, bits)
                frm.append(own[x])
                to.append(own[y])
            a, b = (np.concatenate(z).view(np.int64) for z in (frm, to))
            both = np.unique(np.stack((a, b), 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.zeros(len(both), bool))], ["a", "b", "over"])

        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            v = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if over is not None:
                k, v = k[k != over], v[k != over]
                if not len(k):
                    continue
                over = None
            keys, values = np.concatenate((keys, k)), np.concatenate((values, v))
            if not len(keys):
                continue
            edge = int(np.searchsorted(keys, keys[-1]))
            if len(keys) - edge > RUN:
                over = keys[-1]
                yield pa.RecordBatch.from_arrays([pa.array([over]), pa.array([0], pa.int64()), pa.array([True])], ["a", "b", "over"])
                keys, values, edge = keys[:edge], values[:edge], edge
            if edge >= 1 << 15 or over is not None:
                if edge:
                    yield compare(keys[:edge], values[:edge])
                keys, values = keys[edge:], values[edge:]
        if len(keys):
            yield compare(keys, values)

    with store.short_rows(prints.sparkSession):
        found = store.cut(ordered.mapInArrow(verify, "a long, b long, over boolean"))
    out = found.where("NOT over").select("a", "b")
    large = found.where("over").select(F.col("a").alias("variant"))
    return out if large.isEmpty() else out.unionByName(_large_links(made, large, bits))


def _large_links(made: DataFrame, large: DataFrame, bits: int) -> DataFrame:
    """Links under the variants in ``large``: their fingerprints in blocks, each pair of blocks verified in one task."""
    rows = store.cut(made.join(large, "variant", "left_semi"))
    sizes = rows.groupBy("variant").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    dealt = rows.join(sizes, "variant").withColumn("block", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")))
    packed = store.cut(dealt.groupBy("variant", "block").agg(F.sort_array(F.collect_list("fingerprint")).alias("f")))
    right = packed.select("variant", F.col("block").alias("other"), F.col("f").alias("g"))
    pairs = packed.join(right, "variant").where("block <= other").repartition(F.col("variant"), F.col("block"), F.col("other"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, g in zip(batch.column("f"), batch.column("g")):
                own = np.unique(np.concatenate((f.values.to_numpy(), g.values.to_numpy()))).view(np.uint64)
                x, y = _tie(own, bits)
                yield pa.RecordBatch.from_arrays([pa.array(own[x].view(np.int64)), pa.array(own[y].view(np.int64))], ["a", "b"])

    return pairs.select("f", "g").mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint hex, component_id, component_rows) of every row.

    component_id is the least doc_id among the documents that links reach from
    this one, itself included (null only if all of those are null). Null, empty
    and blank texts have the fingerprint 0 and link like any other; exact copies
    and repeated rows share a fingerprint, so they are one node of the graph. Only
    doc_id and text are read, so other columns may have any names; an empty table
    gives no rows.
    """
    prints = store.cut(fingerprints(docs, shingle))
    nodes = store.cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = cc.components(links(nodes.select("fingerprint"), bits))
    rooted = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select("fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least", "n")
    # Written first, so that the join below has an exchange on either side and a large component can be split.
    least = store.cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_rows")))
    classes = rooted.select("fingerprint", "root").join(least, "root").drop("root")
    return prints.join(classes, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id", "component_rows")
