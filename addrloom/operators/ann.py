"""Approximate search by cosine: inverted lists of product-quantised residuals, ranked again exactly.

The model is a set of centroids and, for each part of the dimensions, 256 codewords of
what is left of a vector once its centroid is taken off. It is fitted on a bounded
sample; every vector is indexed. The index is a table of blocks, each with the ids and
codes of up to BLOCK vectors of one list, so a search is an equi-join of blocks of
queries with blocks of the lists that they probe, and no list is gathered. Candidates
by the approximate score are few for each query, and their true cosines decide.

Vectors that are null, of another length than the first of the sample, of length zero,
or with null or non-finite components take no part. Rows that repeat are rows of their
own; equal cosines (to nine places) go to the smaller id. Without vectors there are no
results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrloom.operators import vectors
from addrloom.operators.stages import cut

#: Vectors that the model is fitted on at most, the first by a hash of their id.
SAMPLE = 65_536
#: Codewords of each part; a code is a byte.
CODES = 256
#: Vectors and queries of a block, so that an Arrow batch of pairs of blocks stays small.
BLOCK, ASKED = 1024, 32
ROUNDS = 12
#: Queries whose best a task holds at once: some 16 MB at eighty candidates each.
HELD = 8192


@dataclass(frozen=True)
class Model:
    """Centroids (lists, dimensions) and codewords (parts, codes, dimensions of a part)."""

    centroids: np.ndarray
    words: np.ndarray


def usable(vector: Column, size: int | None = None) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(finite & (F.size(vector) == size) if size is not None else finite, F.lit(False))


def _rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length, each scaled to length 1."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    a = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    a = a / np.abs(a).max(1, keepdims=True)
    return (a / np.linalg.norm(a, axis=1, keepdims=True)).astype(np.float32)


def _nearest(a: np.ndarray, centres: np.ndarray, n: int = 1) -> np.ndarray:
    """The ``n`` nearest centres of each row, the nearest first."""
    d = (centres**2).sum(1) - 2 * a @ centres.T
    if n == 1:
        return d.argmin(1)[:, None]
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def _means(a: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from ``k`` of the rows; a centre without rows takes one of those farthest from theirs."""
    centres = a[rng.choice(len(a), min(k, len(a)), replace=False)].copy()
    for _ in range(ROUNDS):
        at = np.concatenate([_nearest(a[i : i + 8192], centres)[:, 0] for i in range(0, len(a), 8192)])
        n = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres, np.float64)
        np.add.at(sums, at, a)
        full = n > 0
        centres[full] = (sums[full] / n[full, None]).astype(a.dtype)
        if empty := int((~full).sum()):
            centres[~full] = a[np.argsort(-((a - centres[at]) ** 2).sum(1), kind="stable")[:empty]]
    return centres


def fit(rows: DataFrame, lists: int, parts: int, seed: int = 7) -> Model | None:
    """The model of (vec_id, embedding) rows; None if none takes part. The sample is at most SAMPLE vectors in the driver's memory."""
    drawn = rows.where(usable(F.col("embedding"))).orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column(0).combine_chunks()
    if not len(drawn):
        return None
    size = len(drawn[0])
    a = _rows(drawn.filter(pa.array([len(v) == size for v in drawn])))
    parts = max(p for p in range(1, min(parts, size) + 1) if size % p == 0)
    rng = np.random.default_rng(seed)
    centroids = _means(a, lists, rng)
    left = (a - centroids[_nearest(a, centroids)[:, 0]]).reshape(len(a), parts, -1)
    words = [_means(np.ascontiguousarray(left[:, p]), CODES, rng) for p in range(parts)]
    return Model(centroids, np.stack(words))


def _gathered(df: DataFrame, key: str, each: int) -> DataFrame:
    """Blocks of up to ``each`` rows (key, id, payload binary) of one key: (key, n, ids, payloads). A key of any size is spread over partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, payloads = None, [], []
        block = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([b"".join(payloads)])], [key, "n", "ids", "payloads"])
        for batch in batches:
            for k, i, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if ids and (k != at or len(ids) == each):
                    yield block()
                    ids, payloads = [], []
                at = k
                ids.append(i)
                payloads.append(p)
        if ids:
            yield block()

    dealt = df.repartitionByRange(key, "id").sortWithinPartitions(key, "id")
    return dealt.mapInArrow(run, f"{key} int, n int, ids binary, payloads binary")


def index(rows: DataFrame, model: Model) -> DataFrame:
    """(list, n, ids, payloads) blocks of all (vec_id, embedding) rows that take part; write it as a table to search it often.

    Rows are sorted by list, so a scan for some lists skips row groups by their statistics.
    """
    size, parts = model.centroids.shape[1], len(model.words)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a = _rows(batch.column(1))
            at = _nearest(a, model.centroids)[:, 0]
            left = (a - model.centroids[at]).reshape(len(a), parts, -1)
            codes = np.stack([_nearest(left[:, p], model.words[p])[:, 0] for p in range(parts)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in codes])], ["list", "id", "payload"])

    coded = rows.where(usable(F.col("embedding"), size)).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(code, "list int, id long, payload binary")
    return _gathered(coded, "list", BLOCK)


def search(asked: DataFrame, rows: DataFrame, blocks: DataFrame, model: Model, k: int, probes: int, again: int) -> DataFrame:
    """(query_id, rank, vec_id, cosine): for (query_id, embedding) rows, ids of their own, the ``k`` best of the ``again`` best by the index.

    ``probes`` lists are read for each query. A query's own id is no candidate. ``rows``
    are the (vec_id, embedding) rows that were indexed; of them the candidates alone are
    read again, by a join on their ids.
    """
    size, parts = model.centroids.shape[1], len(model.words)
    probes = min(probes, len(model.centroids))

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a = _rows(batch.column(1))
            to = _nearest(a, model.centroids, probes)
            packed = [v.tobytes() for v in a]
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), probes)
            yield pa.RecordBatch.from_arrays([pa.array(to.ravel().astype(np.int32)), pa.array(ids), pa.array([p for p in packed for _ in range(probes)])], ["list", "id", "payload"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The best of each query over the pairs of blocks that a task has met, so that a pair does not put out its own.
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> pa.RecordBatch:
            n = [len(v) for v, _ in best.values()]
            ids, near = (np.concatenate([x[i] for x in best.values()]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(list(best), n)), pa.array(ids), pa.array(near)], ["query_id", "vec_id", "near"])

        for batch in batches:
            for at, qi, qs, di, ds in zip(*[c.to_pylist() for c in batch.columns]):
                q, c = np.frombuffer(qs, np.float32).reshape(-1, size), np.frombuffer(ds, np.uint8).reshape(-1, parts)
                qi, di = np.frombuffer(qi, "<i8"), np.frombuffer(di, "<i8")
                near = (q @ model.centroids[at])[:, None] + np.zeros((1, len(c)), np.float32)
                split = q.reshape(len(q), parts, -1)
                for p in range(parts):
                    near += (split[:, p] @ model.words[p].T)[:, c[:, p]]
                near[qi[:, None] == di[None]] = -np.inf
                for i, row in zip(qi.tolist(), near):
                    ids, values = best.get(i, (di[:0], row[:0]))
                    ids, values = np.concatenate([ids, di[row > -np.inf]]), np.concatenate([values, row[row > -np.inf]])
                    if len(ids) > again:
                        order = np.argpartition(-values, again - 1)[:again]
                        ids, values = ids[order], values[order]
                    best[i] = ids, values
                if len(best) > HELD:
                    yield out()
                    best.clear()
        if best:
            yield out()

    own = asked.where(usable(F.col("embedding"), size)).select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>"))
    sent = _gathered(own.mapInArrow(aim, "list int, id long, payload binary"), "list", ASKED).select("list", F.col("ids").alias("qids"), F.col("payloads").alias("queries"))
    near = sent.join(blocks.drop("n"), "list").select("list", "qids", "queries", "ids", "payloads").mapInArrow(score, "query_id long, vec_id long, near float")
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
    few = cut(near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= again).select("query_id", "vec_id"))
    true = few.join(own.withColumnRenamed("embedding", "_q"), "query_id").join(rows.select("vec_id", "embedding"), "vec_id").withColumn("c", vectors.cosine(F.col("_q"), F.col("embedding")))
    last = Window.partitionBy("query_id").orderBy(F.desc(F.round("c", 9)), "vec_id")
    return true.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.round("c", 4).alias("cosine"))
