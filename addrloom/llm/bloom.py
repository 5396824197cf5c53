"""Bloom filters in slices of the hash space, as files in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, textkit

#: Bits for each key of a slice, probes for each key, keys that a slice is made for, and the most slices (a worker maps one file for each).
BITS_PER_KEY, PROBES, SLICE_KEYS, MAX_SLICES = 12, 5, 1_000_000, 16_384


def slices_for(keys: int) -> int:
    return min(MAX_SLICES, max(1, -(-keys // SLICE_KEYS)))


def empty(keys: int) -> np.ndarray:
    """The bytes of a filter for ``keys`` keys; its bits are a power of two."""
    return np.zeros((1 << max(10, int(np.ceil(np.log2(max(1, keys) * BITS_PER_KEY))))) // 8, np.uint8)


def _bits(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    mixed = textkit.mix64(hashes)
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(PROBES):
            yield (mixed + np.uint64(k) * step) & np.uint64(size - 1)


def holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    hit = np.ones(len(hashes), bool)
    for at in _bits(hashes, len(bits) * 8):
        hit &= (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0
    return hit


def add(bits: np.ndarray, hashes: np.ndarray) -> None:
    for at in _bits(hashes, len(bits) * 8):
        np.bitwise_or.at(bits, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))


def slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def hits(hashes: np.ndarray, slices: int, folder: str) -> np.ndarray:
    """Whether each hash may be in the filters of ``folder``; slices without a key have no file."""
    where, hit = slice_of(hashes, slices), np.zeros(len(hashes), bool)
    order = np.argsort(where, kind="stable")
    present, first = np.unique(where[order], return_index=True)
    for s, own in zip(present, np.split(order, first[1:])):
        if (bits := store.mapped(f"{folder}/{s}")) is not None:
            hit[own] = holds(bits, hashes[own])
    return hit


def only(column: Column, folder: str, slices: int) -> Column:
    """Whether the filters of ``folder`` may hold the first eight bytes of a binary ``column`` of 16 bytes."""

    def test(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for digest in batches:
            h = np.frombuffer(textkit.byte_column(digest)[0].tobytes(), "<u8")[::2]
            yield pa.array(hits(h, slices, folder))

    return F.arrow_udf(test, "boolean")(column)


def once(digests: DataFrame, column: str) -> tuple[str, int]:
    """Filters over the first eight bytes of a binary column: their folder and the number of slices.

    The rows are read twice, so they had better come from a table.
    """
    spark = digests.sparkSession
    digests = digests.select(F.col(column).alias("d"))
    slices = slices_for(digests.count())
    folder = store.new_folder(spark, "bloom")

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hashes = np.frombuffer(b"".join(rows["k"]), "<u8")
        bits = empty(len(hashes))
        add(bits, hashes)
        store.put(f"{folder}/{int(key[0])}", bits.tobytes())
        return pd.DataFrame({"slice": [key[0]]})

    # The slice is taken from the high half of the little-endian number: its bytes 8 to 5.
    high = F.conv(F.hex(F.concat(*[F.substring("d", i, 1) for i in (8, 7, 6, 5)])), 16, 10).cast("long")
    rows = digests.select(F.substring("d", 1, 8).alias("k"), F.shiftright(high * slices, 32).alias("slice"))
    rows.groupBy("slice").applyInPandas(build, "slice long").write.format("noop").mode("overwrite").save()
    return folder, slices


def twice(lists: DataFrame, keys: int) -> tuple[str, int]:
    """Filters over the hashes that occur at least twice in the packed lists (hashes binary) of about ``keys`` in all."""
    folder = store.new_folder(lists.sparkSession, "twice")
    slices = slices_for(keys)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                h, times = np.unique(np.frombuffer(raw, "<u8"), return_counts=True)
                where = slice_of(h, slices)
                edge = np.searchsorted(where, np.arange(slices + 1))
                for s in np.flatnonzero(np.diff(edge)).tolist():
                    a, b = edge[s], edge[s + 1]
                    yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([h[a:b].tobytes()], pa.binary()), pa.array([h[a:b][times[a:b] > 1].tobytes()], pa.binary())], ["slice", "once", "twice"])

    merge_twice(lists.mapInArrow(deal, "slice long, once binary, twice binary"), folder)
    return folder, slices


def merge_twice(dealt: DataFrame, folder: str) -> None:
    """Write the twice-seen filter of each slice of (slice, once, twice) to ``folder``/<slice>.

    ``once`` holds the distinct hashes of a part of the data, ``twice`` those that are
    repeated within it. A hash that the once-seen filter held already, or that a part
    has twice, goes to the twice-seen filter.
    """

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held, again = (empty(sum(map(len, rows["once"])) // 8) for _ in range(2))
        for a, b in zip(rows["once"], rows["twice"]):
            a = np.frombuffer(a, np.uint64)
            add(again, a[holds(held, a)])
            add(held, a)
            add(again, np.frombuffer(b, np.uint64))
        store.put(f"{folder}/{int(key[0])}", again.tobytes())
        return pd.DataFrame({"slice": [key[0]], "bytes": [len(again)]})

    dealt.groupBy("slice").applyInPandas(merge, "slice long, bytes long").write.format("noop").mode("overwrite").save()
