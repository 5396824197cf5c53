"""Quality classifier: ordinal cumulative-link regression over hashed text features.

Ratings are ordered grades 0 to G. One weight per feature is shared by all
grades, and ordered thresholds cut the score: P(grade <= k) = sigmoid(threshold_k
- score). The model gives the expected grade and the probability of each tail
P(grade >= k), which selection uses.

Features are the distinct words of the whole text, the distinct beginnings of
its words, and the bands that some shares fall in (capitals, marks, digits,
repeated words, ...), each hashed to 64 bits. The model keeps features found in
at least ``min_df`` of the sampled texts, as a sorted hash array.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit

PREFIX_BYTES = (4, 5)
SHARES = ("capitals", "marks", "digits", "repeats", "long words", "marks in a row", "words on a line", "top word")
BANDS = np.array([0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.14, 0.18, 0.23, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.97])
SAMPLE_ROWS = 7_000

_CAPITAL, _DIGIT, _MARK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[65:91] = True
_DIGIT[48:58] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _count(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return textkit.sums(mask.astype(np.int64), offsets)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature hash) pairs of a chunk, sorted and distinct."""
    n = len(offsets) - 1
    starts, ends, bounds = textkit.word_bounds(data, offsets)
    words = textkit.word_hashes(data, starts, ends)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    order = np.lexsort((words, doc))
    d, w = doc[order], words[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    repeats = np.diff(np.append(first, len(w)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, d[first], repeats)
    found = [(d[first], w[first])]
    begin, end = starts[order][first], ends[order][first]
    for k in PREFIX_BYTES:
        long = end - begin > k
        found.append((d[first][long], textkit.mix64(textkit.word_hashes(data, begin[long], begin[long] + k) + np.uint64(k))))
    size, total = np.maximum(np.diff(offsets), 1), np.maximum(np.diff(bounds), 1)
    mark = _MARK[data]
    pair = np.zeros(len(data), bool)
    pair[1:] = mark[1:] & mark[:-1]
    lines = _count(data == 10, offsets) + 1
    shares = (
        _count(_CAPITAL[data], offsets) / size, _count(mark, offsets) / size, _count(_DIGIT[data], offsets) / size,
        1 - np.bincount(d[first], minlength=n) / total, textkit.sums((ends - starts > 16).astype(np.int64), bounds) / total,
        _count(pair, offsets) / total, np.minimum(1, total / lines / 200), top / total,
    )
    for k, share in enumerate(shares):
        band = np.searchsorted(BANDS, share)
        found.append((np.arange(n), textkit.mix64((np.uint64(1 << 40) + np.uint64(k << 8)) + band.astype(np.uint64))))
    doc, key = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return doc[keep], key[keep]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, n: int, doc: np.ndarray, key: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(n)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.bincount(doc[hit], self.weights[at[hit]], n)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... in columns."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])


def loss(state: np.ndarray, rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, width: int, l2: float) -> tuple[float, np.ndarray]:
    """The mean negative log-likelihood with its penalty, and the gradient, at (weights, first threshold, logarithms of the steps)."""
    n, top = len(grade), len(state) - width
    w, theta = state[:width], state[width:]
    cuts = np.concatenate((theta[:1], theta[:1] + np.cumsum(np.exp(theta[1:]))))
    s = np.bincount(rows, w[cols], n)
    upper = np.concatenate((_sigmoid(cuts[None, :] - s[:, None]), np.ones((n, 1))), 1)
    lower = np.concatenate((np.zeros((n, 1)), upper[:, :-1]), 1)
    at = np.arange(n)
    up, low = upper[at, grade], lower[at, grade]
    p = np.maximum(up - low, 1e-12)
    dup, dlow = up * (1 - up) / p, low * (1 - low) / p
    gs = (dup - dlow) / n  # of the negative log-likelihood by the score
    gcut = np.zeros((n, top + 1))
    gcut[at, grade] -= dup / n
    part = np.zeros((n, top + 2))
    part[at, grade] += dlow / n
    gc = (gcut[:, :top] + part[:, 1 : top + 1]).sum(0)
    gw = np.bincount(cols, gs[rows], width) + l2 * w / np.sqrt(max(n, 1))
    gt = np.empty_like(theta)
    gt[0] = gc.sum()
    for k in range(1, len(theta)):
        gt[k] = np.exp(theta[k]) * gc[k:].sum()
    return float(-np.log(p).mean() + l2 * (w @ w) / 2 / np.sqrt(max(n, 1))), np.concatenate((gw, gt))


def fit(doc: np.ndarray, key: np.ndarray, grade: np.ndarray, min_df: int = 3, deviations: float = 4.0, l2: float = 2e-3, rounds: int = 400) -> Model:
    """Maximum likelihood with an L2 penalty, by Adam over the whole sample.

    A feature is kept if it is in at least ``min_df`` texts and its count in some grade
    lies more than ``deviations`` standard deviations from that grade's share.

    The thresholds are a first one and the logarithms of the steps, which keeps
    them in order. No rows, or rows of one grade alone, give a model that ignores
    the text.
    """
    n, top = len(grade), int(grade.max()) if len(grade) else 1
    top = max(top, 1)
    known, column, df = np.unique(key, return_inverse=True, return_counts=True)
    kept = np.zeros(len(known), bool)
    for k in range(top + 1):
        own = grade == k
        p = own.mean() if n else 0.0
        kept |= np.abs(np.bincount(column, own[doc].astype(float), len(known)) - df * p) > deviations * np.sqrt(df * p * (1 - p) + 1e-9)
    kept &= df >= min_df
    index = np.cumsum(kept) - 1
    rows, cols = doc[kept[column]], index[column[kept[column]]]
    keys, width = known[kept], int(kept.sum())
    w = np.zeros(width)
    shares = np.array([((grade < k).sum() + 0.5) / (n + 1) for k in range(1, top + 1)])
    logit = np.log(shares / (1 - shares))
    theta = np.concatenate((logit[:1], np.log(np.maximum(np.diff(logit), 0.05))))
    state = np.concatenate((w, theta))
    m, v = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, rounds + 1 if n else 1):
        _, g = loss(state, rows, cols, grade, width, l2)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = 0.03 * min(1.0, 4 * (1 - step / (rounds + 1)))
        state = state - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    w, theta = state[:width], state[width:]
    return Model(keys, w.astype(np.float32), np.concatenate((theta[:1], theta[:1] + np.cumsum(np.exp(theta[1:])))))


def grade_of_labels() -> Column:
    """Toxic texts have grade 0, low quality 1, the rest 2."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull() & F.col("toxic").isNotNull(), 2)


def train(docs: DataFrame, ratings: DataFrame, sample_rows: int = SAMPLE_ROWS, min_df: int = 3) -> Model:
    """A model from (doc_id, grade) ratings of ``docs``.

    ``sample_rows`` bounds the rated documents that it learns from: those whose
    hash of doc_id comes first, the same on every run. Only their feature hashes
    reach the driver. Ratings without a grade or a document are passed over. Of
    several ratings of a doc_id the lowest grade holds, and of several texts the one
    whose digest comes first. Empty tables give a model that ignores the text.
    """
    chosen = ratings.select("doc_id", F.col("grade").cast("int").alias("grade")).where("doc_id IS NOT NULL AND grade >= 0").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(sample_rows)
    # sample_rows bounds the broadcast side: 16 bytes a row.
    rated = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rated = rated.groupBy("doc_id", "grade").agg(F.min(F.struct(F.md5(F.col("text").cast("binary")).alias("digest"), "text")).alias("s")).select("doc_id", "grade", "s.text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.byte_column(batch.column(0))
            for row, end, part, at in textkit.chunks(data, offsets):
                doc, key = features(part, at)
                edge = np.searchsorted(doc, np.arange(end - row + 1))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(row, end - row), batch.column(2).slice(row, end - row), pa.array([key[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())], ["doc_id", "grade", "keys"])

    got = rated.select("text", "doc_id", "grade").mapInArrow(extract, "doc_id long, grade int, keys binary").toArrow()
    got = got.take(np.argsort(got.column("doc_id").to_numpy(), kind="stable"))
    data, offsets = textkit.byte_column(got.column("keys"))
    grades = got.column("grade").to_numpy().astype(np.int64)
    del got
    return fit(np.repeat(np.arange(len(grades)), np.diff(offsets) // 8), data.view(np.uint64), grades, min_df)


def grade(docs: DataFrame, model: Model, wanted: int | None = None, least: float = 0.4) -> DataFrame:
    """``docs`` with expected_grade, tail_probability (of grade ``wanted``, the highest if None, or more) and keep.

    ``keep`` holds where the tail probability is at least ``least``. Null texts
    count as empty; other columns, under any names but these three, pass through.
    Every row is graded, repeated ones alike; an empty table gives none.
    """
    if wanted is not None and not 1 <= wanted <= len(model.thresholds):
        raise ValueError(f"wanted must lie between 1 and {len(model.thresholds)}")
    if clash := {"expected_grade", "tail_probability", "keep"} & set(docs.columns):
        raise ValueError(f"{sorted(clash)} are columns already")
    # The model has at most sample_rows * (distinct features a text) / min_df entries of 12 bytes.
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = (wanted or len(model.thresholds)) - 1

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for column in batches:
            data, offsets = textkit.byte_column(column)
            out = [np.zeros((0, len(m.thresholds)))]
            for row, end, part, edge in textkit.chunks(data, offsets):
                out.append(m.tails(m.scores(end - row, *features(part, edge))))
            tails = np.concatenate(out)
            yield pa.StructArray.from_arrays([pa.array(tails.sum(1)), pa.array(tails[:, at])], ["expected_grade", "tail_probability"])

    scored = F.arrow_udf(score, "expected_grade double, tail_probability double")(F.col("text").cast("string"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = docs.select(row.alias("row"), scored.alias("scored"))
    out = out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], "scored.*")
    return out.withColumn("keep", F.col("tail_probability") >= F.lit(least))
