"""Importance resampling towards a target distribution, by an external sort and count of hashed n-grams.

Each document becomes a stream of packed 16-bit buckets, one for each of its
words and pairs of neighbouring words, and the streams are written once with the
documents' offsets. The first pass over them sorts runs of buckets and run-length
encodes them into counts, which Spark adds up; the same counts of the target
texts give each bucket a whole-number gain. The second pass gathers the gains of a
stream and sums them over each document's stretch of it. The draw is the Gumbel
top-k trick: a fixed Gumbel value of the doc_id is added to the weight, and the
highest scores are drawn, which is sampling without replacement in proportion to
exp(weight / 1000).

Words are runs of letters and digits of ASCII and of all characters beyond it,
with A-Z lower-cased. A bucket is the CRC-32 of the n-gram's bytes modulo the
number of buckets; the CRC of a pair is put together from those of its words.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store, textkit

BUCKETS = 10_000
#: Words of more bytes go through zlib one by one, and so do pairs that end with one.
LONG = 48
#: Buckets to a sorted run, 8 MB of them.
RUN = 4 << 20
#: Rows to a partition of the order of the draw.
RANKED_ROWS = 1 << 20


def _step(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[crc & np.uint32(255)] ^ (crc >> np.uint32(8))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The CRC-32 of a byte, and for each number of zero bytes what they do to each byte of a CRC."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    shift = np.empty((LONG + 1, 4, 256), np.uint32)
    for j in range(4):
        shift[0, j] = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
    for n in range(1, LONG + 1):
        shift[n] = _step(shift[n - 1], table)
    return table, shift


_TABLE, _SHIFT = _tables()


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word of ``data``."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    at, size = starts[order], lengths[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for k in range(min(int(size[0]), LONG) if len(size) else 0):
        m = int(np.searchsorted(-size, -k, "left"))
        crc[:m] = _step(crc[:m] ^ data[at[:m] + k], _TABLE)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-size, -LONG, "left"))):
        crc[i] = zlib.crc32(data[at[i] : at[i] + size[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def pair_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, crc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The CRC-32 of the words ``first`` and the ones after them, with a blank between."""
    spaced = _step((crc[first] ^ np.uint32(0xFFFFFFFF)) ^ np.uint32(32), _TABLE) ^ np.uint32(0xFFFFFFFF)
    size = ends[first + 1] - starts[first + 1]
    n = np.minimum(size, LONG)
    out = crc[first + 1].copy()
    for j in range(4):
        out ^= _SHIFT[n, j, (spaced >> np.uint32(8 * j)) & np.uint32(255)]
    for i in np.flatnonzero(size > LONG):
        a = first[i] + 1
        out[i] = zlib.crc32(data[starts[a] : ends[a]], int(spaced[i]))
    return out


def streams_of(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each document, offsets of the documents in the stream, packed buckets) of a chunk."""
    data = textkit._LOWER[data]
    starts, ends, bounds = textkit.word_bounds(data, offsets, textkit.MARKS)
    words = np.diff(bounds)
    pairs = np.maximum(words - 1, 0)
    edge = np.concatenate(([0], np.cumsum(words + pairs)))
    crc = word_crcs(data, starts, ends)
    last = np.zeros(len(starts), bool)
    last[bounds[1:][words > 0] - 1] = True
    first = np.flatnonzero(~last)
    doc = np.repeat(np.arange(len(words)), words)
    within = np.arange(len(starts)) - bounds[doc]
    stream = np.empty(int(edge[-1]), np.uint16)
    stream[edge[doc] + within] = crc % np.uint32(buckets)
    stream[edge[doc[first]] + words[doc[first]] + within[first]] = pair_crcs(data, starts, ends, crc, first) % np.uint32(buckets)
    return words, edge, stream


def bucket_streams(docs: DataFrame, buckets: int = BUCKETS, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(ids, words, offsets, stream): a row for each run of documents of about 1 MB of text; a longer document has one of its own."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket must fit 16 bits")
    kind = docs.schema[id_column].dataType

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.byte_column(batch.column(0))
            ids = batch.column(1)
            for row, end, part, at in textkit.chunks(data, offsets):
                words, edge, stream = streams_of(part, at, buckets)
                own = pa.array([0, end - row], pa.int32())
                arrays = [pa.ListArray.from_arrays(own, ids.slice(row, end - row)), pa.ListArray.from_arrays(own, pa.array(words, pa.int64())), pa.array([edge.astype("<i8").tobytes()], pa.binary()), pa.array([stream.astype("<u2").tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["ids", "words", "offsets", "stream"])

    rows = docs.select(F.col(f"`{column}`").cast("string").alias("text"), F.col(f"`{id_column}`").alias("id"))
    return rows.mapInArrow(write, f"ids array<{kind.simpleString()}>, words array<bigint>, offsets binary, stream binary")


def bucket_counts(streams: DataFrame) -> DataFrame:
    """(bucket, n) of all streams: sorted runs, run-length encoded in the tasks and added up by Spark."""

    def encode(held: list[np.ndarray]) -> pa.RecordBatch:
        run = np.sort(np.concatenate(held), kind="stable")
        new = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(run[new].astype(np.int32)), pa.array(np.diff(np.append(new, len(run))))], ["bucket", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, offsets = textkit.byte_column(batch.column(0))
            values = np.frombuffer(data.tobytes(), "<u2")
            for start in range(0, len(values), RUN):
                held.append(values[start : start + RUN])
                size += len(held[-1])
                if size >= RUN:
                    yield encode(held)
                    held, size = [], 0
            textkit.release(len(data))
        if size:
            yield encode(held)

    runs = streams.select("stream").mapInArrow(count, "bucket int, n bigint")
    return runs.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the logarithm of (target share / source share), each count raised by one."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def _dense(counts: DataFrame, buckets: int) -> np.ndarray:
    """Counts as an array; at most one row for each bucket reaches the driver."""
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():
        out[row["bucket"]] = row["n"]
    return out


def weights(streams: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean of the gains over each document's features."""
    # At most 65,536 whole numbers.
    shared = streams.sparkSession.sparkContext.broadcast(gains)
    kind = streams.schema["ids"].dataType.elementType.simpleString()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                edge = np.frombuffer(batch.column(2)[i].as_buffer(), "<i8")
                stream = np.frombuffer(batch.column(3)[i].as_buffer(), "<u2")
                size = np.diff(edge)
                full = np.flatnonzero(size)
                total = np.zeros(len(size), np.int64)
                if len(full):
                    total[full] = np.add.reduceat(shared.value[stream], edge[full])
                weight = total // np.maximum(size, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(size), pa.array(weight)], ["id", "n_words", "n_features", "weight"])
                textkit.release(len(stream))

    return streams.select("ids", "words", "offsets", "stream").mapInArrow(gather, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(doc_id: Column, seed: int) -> Column:
    """A Gumbel value in whole thousandths, drawn from a digest of the seed and the id (none: an empty one)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of ``docs``: ``rank`` is its place in the draw, null if it isn't drawn.

    ``target`` is a table with texts in ``column``. Of the documents with at least
    ``least_words`` words, the floored ``percent`` with the highest scores are drawn,
    ties to the smaller id. A null text is empty and has no features and weight 0;
    rows without an id come after those with one of their score; repeated rows are
    documents of their own, drawn in any order among themselves. A very long text
    is one row of the stream table, two bytes a feature. An empty ``docs`` gives no
    rows, an empty ``target`` gains by rarity alone. Only the id and the text are
    read, so other columns may have any names.
    """
    spark = docs.sparkSession
    streams = store.table(bucket_streams(docs, buckets, id_column, column), "streams")
    wanted = bucket_streams(target.select(F.lit(None).cast("long").alias("_id"), F.col(f"`{column}`")), buckets, "_id", column)
    gains = bucket_gains(_dense(bucket_counts(streams), buckets), _dense(bucket_counts(wanted), buckets))
    # Written with a number for each row, so the order below is the same whenever a task runs again.
    scored = weights(streams, gains).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)).withColumn("row", F.monotonically_increasing_id())
    scored = store.table(scored.withColumn("open", F.col("n_words") >= least_words), "scores")
    # A range of the whole order to each partition; the row's number splits even rows that are all alike.
    order = [F.col("open").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row")]
    parts = store.spread(scored, scored.count(), RANKED_ROWS)
    placed = store.table(scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "places")
    # The number holds the partition above bit 33. One row for each partition reaches the driver.
    part = F.shiftright("place", 33)
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)), F.count_if("open")).collect())
    drawn = sum(s[2] for s in sizes) * percent // 100
    ahead, before = [], 0
    for k, n, _ in sizes:
        ahead.append((k, before))
        before += n
    ahead = F.broadcast(spark.createDataFrame(ahead, "part bigint, ahead bigint"))
    rank = F.col("ahead") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    out = placed.withColumn("part", part).join(ahead, "part")
    return out.select(F.col("id").alias(id_column), "n_features", "weight", "score", F.when(F.col("open") & (rank <= drawn), rank).alias("rank"))
