"""Byte-level text kernels shared by the operators: Arrow access, words, hashes.

A word is a run of bytes other than 0x20 and 0x09-0x0D. All kernels work on one
chunk of documents at a time, whose size in bytes is bounded (a single longer
document makes a chunk of its own), so memory does not follow the batch size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: All ASCII but letters and digits: what parts words where marks are no part of them.
MARKS = np.arange(256) < 128
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 on an array of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER_BYTE = BYTE_HASH[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


_PASSED = [0]
_RELEASE_BYTES = 24 << 20
try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    _TRIM = None


def release(passed: int = _RELEASE_BYTES) -> None:
    """Give freed memory back once enough bytes have passed: two workers and a JVM share an executor's memory."""
    _PASSED[0] += passed
    if _PASSED[0] >= _RELEASE_BYTES:
        _PASSED[0] = 0
        pa.default_memory_pool().release_unused()
        if _TRIM is not None:
            _TRIM(0)


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of documents of about ``limit`` bytes."""
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        release(int(offsets[end] - offsets[row]))
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of bytes that are no ``gap``), and for each document the index of its first word (one more at the end)."""
    n = len(data)
    solid = ~gap[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1])) & ~edge[:-1]
    after = np.concatenate((solid[1:], [False])) & ~edge[1:]
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, with A-Z lower-cased unless told otherwise."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    within = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        terms = (_LOWER_BYTE if lower else BYTE_HASH)[data[within + np.repeat(starts, lengths)]] * _powers(int(lengths.max()))[within]
        return mix64(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i; empty ranges give 0."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]
