"""Toxicity by non-negative positive-unlabelled learning.

Only some toxic texts are confirmed, and a text that nobody marked may be toxic
too. So nothing is taken for clean: linear classifiers are trained in numpy from
confirmed texts P and unlabelled texts U. With the share of toxic texts (the
class prior), the risk over clean texts is what U holds beyond that share of P,

    risk = prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]),

and where the second part falls below zero, which a flexible model reaches by
learning P by heart, a step goes up it instead of down the risk.

Features are the distinct words of the whole text (runs of letters and digits),
the distinct beginnings of its words, and which of these make up a noticeable
share of its words, each hashed to 64 bits. Several classifiers share P and have
a sample of U each; they are trained in a Spark task each, and their mean is the
score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit

#: Bounds of the texts that a classifier learns from: confirmed ones, which all share, and unlabelled ones of its own.
POSITIVE_ROWS, UNLABELLED_ROWS, MEMBERS = 4_000, 5_000, 3
PREFIX_BYTES = (4, 5, 6)
#: A feature that is at least this share of a text's words counts once more.
SHARES = (0.004, 0.012)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature hash) pairs of a chunk, sorted and distinct."""
    starts, ends, bounds = textkit.word_bounds(data, offsets, textkit.MARKS)
    total = np.diff(bounds)
    doc = np.repeat(np.arange(len(total)), total)
    docs, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for k in (0, *PREFIX_BYTES):
        own = ends - starts > k
        begin = starts[own]
        hashes = textkit.word_hashes(data, begin, np.minimum(ends[own], begin + k) if k else ends[own])
        hashes = textkit.mix64(hashes + np.uint64(k))
        d = doc[own]
        order = np.lexsort((hashes, d))
        d, h = d[order], hashes[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        first = np.flatnonzero(new)
        share = np.diff(np.append(first, len(h))) / total[d[first]]
        docs.append(d[first])
        keys.append(h[first])
        for j, least in enumerate(SHARES, 1):
            many = share >= least
            docs.append(d[first][many])
            keys.append(textkit.mix64(h[first][many] ^ np.uint64(j << 56)))
    doc, key = np.concatenate(docs), np.concatenate(keys)
    order = np.lexsort((key, doc))
    return doc[order], key[order]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def risk(state: np.ndarray, p: tuple[np.ndarray, np.ndarray, int], u: tuple[np.ndarray, np.ndarray, int], prior: float, l2: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(toxic part, clean part, their gradients) at (weights, bias); P and U are (rows, columns, number of texts).

    The loss is logistic. The penalty on the weights is in the toxic part.
    """
    w, b = state[:-1], state[-1]
    value, grads = [], []
    for rows, cols, n in (p, u):
        f = np.bincount(rows, w[cols], n) + b
        value.append(f)
        grads.append(lambda g, rows=rows, cols=cols, n=n: np.append(np.bincount(cols, g[rows], len(w)), g.sum()) / max(n, 1))
    up, down = (lambda f: np.logaddexp(0, -f), lambda f: np.logaddexp(0, f))
    mean = lambda x: float(x.mean()) if len(x) else 0.0
    toxic = prior * mean(up(value[0])) + l2 / 2 * float(w @ w)
    clean = mean(down(value[1])) - prior * mean(down(value[0]))
    g_toxic = prior * grads[0](-_sigmoid(-value[0])) + np.append(l2 * w, 0)
    g_clean = grads[1](_sigmoid(value[1])) - prior * grads[0](_sigmoid(value[0]))
    return toxic, clean, g_toxic, g_clean


@dataclass
class Model:
    """Weights of the features that any classifier kept (a column each), and the biases."""

    keys: np.ndarray
    weights: np.ndarray
    biases: np.ndarray
    prior: float

    def scores(self, n: int, doc: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The mean over classifiers of the probability that a text is toxic."""
        f = np.tile(self.biases, (n, 1))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            for m in range(len(self.biases)):
                f[:, m] += np.bincount(doc[hit], self.weights[at[hit], m], n)
        return _sigmoid(f).mean(1)


def fit(texts: list[np.ndarray], positive: np.ndarray, prior: float, min_df: int = 3, deviations: float = 4.0, l2: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) of one classifier by Adam over all its texts, each a sorted array of features.

    A feature is kept if at least ``min_df`` confirmed texts or as many unlabelled ones
    have it and its shares of the two differ by more than ``deviations`` standard
    deviations. Without confirmed or unlabelled texts the bias alone tells the prior.
    """
    flat = np.concatenate([np.zeros(0, np.uint64), *texts])
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    n = np.array([positive.sum(), (~positive).sum()])
    log_odds = float(np.log(prior / (1 - prior)))
    if not n.all():
        return np.zeros(0, np.uint64), np.zeros(0), log_odds
    known, column = np.unique(flat, return_inverse=True)
    mine = positive[doc]
    df = np.array([np.bincount(column[side], minlength=len(known)) for side in (mine, ~mine)])
    pooled = df.sum(0) / n.sum()
    apart = np.abs(df[0] / n[0] - df[1] / n[1]) > deviations * np.sqrt(pooled * (1 - pooled) * (1 / n).sum() + 1e-12)
    kept = apart & (df.max(0) >= min_df)
    index, hold = np.cumsum(kept) - 1, kept[column]
    place = np.cumsum(positive) - 1, np.cumsum(~positive) - 1
    side = lambda own, at, k: (at[doc[hold & own]], index[column[hold & own]], int(n[k]))
    p, u = side(mine, place[0], 0), side(~mine, place[1], 1)
    state = np.append(np.zeros(int(kept.sum())), log_odds)
    m, v = np.zeros_like(state), np.zeros_like(state)
    for step in range(1, rounds + 1):
        _, clean, g_toxic, g_clean = risk(state, p, u, prior, l2)
        g = g_toxic + g_clean if clean >= 0 else -g_clean
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = 0.05 * min(1.0, 4 * (1 - step / (rounds + 1)))
        state = state - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return known[kept], state[:-1], float(state[-1])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learned from; those without a doc_id are held out as well, as no label names them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, confirmed: DataFrame, prior: float, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS, members: int = MEMBERS) -> Model:
    """A model from the doc_ids in ``confirmed`` and the unlabelled texts of ``docs``.

    ``prior`` is the share of toxic texts among all. Every classifier learns from at
    most ``positive_rows`` confirmed texts and ``unlabelled_rows`` others, the first by
    a hash of doc_id and so the same on every run; texts that are confirmed may be among
    the others, as the method has it. Of several texts of a doc_id the one whose digest
    comes first holds. Rows without a doc_id are not learned from. The features of a
    classifier's texts, some 10 bytes for a byte of text, are in one task: its memory is
    bounded by these numbers and the length of the texts.
    """
    first = lambda df, n: df.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64(F.lit(12), "doc_id"), "doc_id").limit(n)
    others = first(docs, unlabelled_rows * members).select("doc_id", F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(members)).cast("int").alias("member"), F.lit(False).alias("positive"))
    own = first(confirmed, positive_rows).select("doc_id", F.explode(F.array(*map(F.lit, range(members)))).alias("member"), F.lit(True).alias("positive"))
    chosen = own.unionByName(others).groupBy("doc_id").agg(F.collect_list(F.struct("member", "positive")).alias("places"))
    # At most positive_rows + unlabelled_rows * members rows of a few dozen bytes.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min(F.struct(F.md5(F.col("text").cast("binary")).alias("digest"), "text")).alias("s"), F.first("places").alias("places"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.byte_column(batch.column(0))
            for row, end, part, at in textkit.chunks(data, offsets):
                doc, key = features(part, at)
                edge = np.searchsorted(doc, np.arange(end - row + 1))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(row, end - row), batch.column(2).slice(row, end - row), pa.array([key[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())], ["doc_id", "places", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.select("s.text", "doc_id", "places").mapInArrow(extract, f"doc_id {kind}, places array<struct<member: int, positive: boolean>>, keys binary")
    rows = rows.select("doc_id", F.explode("places").alias("place"), "keys").select("doc_id", "place.*", "keys")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["positive", "doc_id"], kind="stable")
        keys, weights, bias = fit([np.frombuffer(k, np.uint64) for k in group["keys"]], group["positive"].to_numpy(bool), prior)
        return pd.DataFrame({"member": [int(group["member"].iloc[0])], "keys": [keys.tobytes()], "weights": [weights.astype("<f8").tobytes()], "bias": [bias]})

    got = rows.groupBy("member").applyInPandas(one, "member int, keys binary, weights binary, bias double").collect()
    return merged([(np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["weights"], "<f8"), r["bias"]) for r in sorted(got, key=lambda r: r["member"])], prior)


def merged(parts: list[tuple[np.ndarray, np.ndarray, float]], prior: float) -> Model:
    """One table of weights for all classifiers; none at all give the prior for every text."""
    parts = parts or [(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))]
    keys = np.unique(np.concatenate([k for k, _, _ in parts]))
    weights = np.zeros((len(keys), len(parts)), np.float32)
    for m, (k, w, _) in enumerate(parts):
        weights[np.searchsorted(keys, k), m] = w
    return Model(keys, weights, np.array([b for _, _, b in parts]), prior)


def class_prior(labels: DataFrame) -> float:
    """The share of toxic rows among all that ``labels`` marks either way, within 0.001 and 0.5; 0.001 if it marks none."""
    row = labels.agg(F.count_if(F.col("toxic") == 1).alias("toxic"), F.count("toxic").alias("n")).first()
    return min(max(row["toxic"] / max(row["n"], 1), 0.001), 0.5)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``, the probability that the text is toxic, and ``predicted``, 1 from 0.5.

    Null texts count as empty; a very long one is a chunk of its own. Other columns,
    under any names but these two, pass through; repeated rows are alike, and an empty
    table gives none.
    """
    if clash := {"score", "predicted"} & set(docs.columns):
        raise ValueError(f"{sorted(clash)} are columns already")
    # At most 12 bytes and 4 for each classifier a feature; features come from the bounded texts of ``train``.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            data, offsets = textkit.byte_column(column)
            out = [np.zeros(0)]
            for row, end, part, edge in textkit.chunks(data, offsets):
                out.append(shared.value.scores(end - row, *features(part, edge)))
            yield pa.array(np.concatenate(out))

    scored = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.arrow_udf(run, "double")(F.col("text").cast("string")).alias("score"))
    return scored.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learned from the labels of those that are not held out."""
    learned = labels.where(~held_out(F.col("doc_id")))
    model = train(docs.where(~held_out(F.col("doc_id"))), learned.where("toxic = 1"), class_prior(learned))
    return score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
