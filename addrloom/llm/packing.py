"""Best-fit packing of tokenized documents into sequences of a fixed length.

The plan is made over counts: pieces of one length are alike, so best-fit
decreasing runs over the length histogram (at most ``capacity`` entries) and
moves whole ranges of sequences at a time. Each piece then takes the planned
slot of its rank within its length: tasks find it by binary search in the plan,
which is broadcast within the bound below.

Plan size. A range of sequences with equal room is taken whole or split, and one
length splits at most two ranges and opens at most two, so there are under
5 * capacity ranges; a sequence of ``capacity`` ids holds fewer than
sqrt(2 * capacity) different lengths, so a range is met by fewer than that many
segments. For 2,048 this bounds the plan by 656,000 segments (31 MB); plans met
in practice have a few thousand.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store, textkit

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
CACHE_WORDS = 1_300_000
JOIN_WORDS = 256
PIECES_PER_BUCKET = 20_000


class WordCache:
    """Token ids of words, in flat arrays found by a 64-bit hash; starts afresh beyond ``CACHE_WORDS`` words."""

    def __init__(self, tokenizer_path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        (self.mark,) = self.tokenizer.encode("!", add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.keys, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.count, self.ids, self.used = np.zeros(0, np.int64), np.zeros(1 << 20, np.uint32), 0

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids.

        Words go to the tokenizer many at a time, with an exclamation mark between them:
        a token of its own, which no word without that mark has. Words with it go alone.
        """
        plain = np.array(["!" not in w for w in words], bool)
        joined, alone = [w for w in words if "!" not in w], [w for w in words if "!" in w]
        count = np.zeros(len(words), np.int64)
        groups = [" ! ".join(joined[i : i + JOIN_WORDS]) + " !" for i in range(0, len(joined), JOIN_WORDS)]
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)]
        ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        mark = ids == self.mark
        edge = np.flatnonzero(mark) - np.arange(len(joined))
        count[plain] = np.diff(edge, prepend=0)
        ids = ids[~mark]
        if not alone:
            return count, ids
        single = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
        count[~plain] = [len(x) for x in single]
        rest, own = iter(np.split(ids, edge[:-1]) if joined else ()), iter(single)
        return count, np.concatenate([next(rest) if p else next(own) for p in plain])

    def ids_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each word has."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.keys) > CACHE_WORDS:
            self.clear()
        # The tokenizer lower-cases all but its special tokens, which begin with <|.
        lower = data.tobytes().find(b"<|") < 0
        wanted, sample, which = np.unique(textkit.word_hashes(data, starts, ends, lower), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, wanted)
        new = np.ones(len(wanted), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != wanted[inside]
        if new.any():
            raw = data.tobytes()
            begin, end = starts[sample[new]].tolist(), ends[sample[new]].tolist()
            count, flat = self._encode([raw[a:b].decode() for a, b in zip(begin, end)])
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
            self.ids[self.used : self.used + len(flat)] = flat
            first = self.used + np.cumsum(count) - count
            self.keys, self.first, self.count = np.insert(self.keys, at[new], wanted[new]), np.insert(self.first, at[new], first), np.insert(self.count, at[new], count)
            self.used += len(flat)
            at = np.searchsorted(self.keys, wanted)
        count, first = self.count[at][which], self.first[at][which]
        ahead = np.cumsum(count) - count
        return self.ids[np.arange(int(count.sum())) + np.repeat(first - ahead, count)], count


_LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP[list(b".,;:!?")] = True


def part_stops(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with a last stop after an ASCII letter in two: the tokenizer parts them there too, so fewer words are new."""
    last = _STOP[data[ends - 1]] & (ends - starts > 1) & _LETTER[data[np.maximum(ends - 2, 0)]]
    at = np.flatnonzero(last) + 1
    cuts = ends[last] - 1
    ahead = np.concatenate(([0], np.cumsum(last)))
    return np.insert(starts, at, cuts), np.insert(np.where(last, ends - 1, ends), at, ends[last]), bounds + ahead[bounds]


_CACHES: dict[str, WordCache] = {}


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, text: str = "text") -> DataFrame:
    """Token ids of every whole text, id 0 at the end, cut at ``capacity`` only where longer.

    One row per piece, with the checksum of its ids. White space never reaches a
    token of this tokenizer, so words are tokenized once and kept. A null or
    empty text has the single id 0.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _CACHES:  # it outlives the task with its worker
            _CACHES[tokenizer_path] = WordCache(tokenizer_path)
        cache = _CACHES[tokenizer_path]
        for batch in batches:
            data, offsets = textkit.byte_column(batch.column(1))
            for row, end, part, at in textkit.chunks(data, offsets, textkit.CHUNK_BYTES // 2):
                starts, ends, bounds = part_stops(part, *textkit.word_bounds(part, at))
                ids, count = cache.ids_of(part, starts, ends)
                edge = np.concatenate(([0], np.cumsum(count)))[bounds]
                doc, piece, start, length, crc = [], [], [], [], []
                for i in range(end - row):
                    own = np.append(ids[edge[i] : edge[i + 1]], np.uint32(0)).astype("<u4")
                    for k, s in enumerate(range(0, len(own), capacity)):
                        doc.append(row + i)
                        piece.append(k)
                        start.append(s)
                        length.append(min(capacity, len(own) - s))
                        crc.append(zlib.crc32(own[s : s + capacity]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string")).mapInArrow(cut, PIECES)


def plan_slots(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over counts.

    Returns segments (length, first rank, sequences, pieces in each sequence,
    first sequence, offset in each): the pieces of that length with ranks from
    ``first rank`` fill the sequences one after the other.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    segments: list[tuple[int, int, int, int, int, int]] = []
    opened = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def place(start: int, bins: int, free: int, each: int) -> None:
            nonlocal left, rank
            segments.append((length, rank, bins, each, start, capacity - free))
            rank += bins * each
            left -= bins * each
            if free - each * length:
                room.setdefault(free - each * length, []).append((start, bins))

        for free in sorted(r for r in room if r >= length):
            ranges = room.pop(free)
            while ranges and left:
                start, bins = ranges.pop()
                each = free // length
                full = min(bins, left // each)
                if full:
                    place(start, full, free, each)
                if full < bins and left:
                    place(start + full, 1, free, left)
                    full += 1
                if full < bins:
                    ranges.append((start + full, bins - full))
            if ranges:
                room.setdefault(free, []).extend(ranges)
            if not left:
                break
        each = capacity // length
        if full := left // each:
            place(opened, full, capacity, each)
            opened += full
        if left:
            place(opened, 1, capacity, left)
            opened += 1
    return np.array(segments, np.int64).reshape(-1, 6)


def ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """``pieces`` with ``rank``, their place from 0 among those of their length.

    A length may hold a third of all pieces, so it is dealt to buckets by a hash
    of the piece; a bucket's ranks start after the counts of those before it.
    """
    buckets = max(1, -(-rows // PIECES_PER_BUCKET))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return dealt.withColumn("within", F.row_number().over(within) - 1).join(offsets, ["length", "bucket"]).select(*pieces.columns, (F.col("ahead") + F.col("within")).alias("rank"))


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (each with a ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Pieces of a sequence lie one after the other from 0 without a gap. Repeated
    rows are packed as separate pieces; an empty table gives an empty result.
    """
    pieces = store.cut(pieces)
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 1 <= n <= capacity for n in histogram):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    plan = plan_slots(histogram, capacity)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan = pieces.sparkSession.sparkContext.broadcast(plan[order])
    ready = ranked(pieces, sum(histogram.values()))
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    names = pieces.columns

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        span = int(max(histogram.values(), default=0)) + 1
        keys = p[:, 0] * span + p[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            s = p[np.searchsorted(keys, length * span + rank, "right") - 1]
            k = rank - s[:, 1]
            each = np.maximum(s[:, 3], 1)
            out = [batch.column(c) for c in names] + [pa.array(s[:, 4] + k // each), pa.array(s[:, 5] + k % each * length)]
            yield pa.RecordBatch.from_arrays(out, [*names, "sequence_id", "offset"])

    return ready.mapInArrow(seat, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """Every document's pieces with their slots: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A null text is empty, and an empty one is a piece of the closing id alone; a very
    long text is cut into pieces of ``capacity`` ids. Repeated rows and rows without a
    doc_id are documents of their own. Only doc_id and text are read, so other columns
    may have any names. An empty table gives no rows.
    """
    return pack(tokenized_pieces(docs, tokenizer_path, capacity), capacity)
