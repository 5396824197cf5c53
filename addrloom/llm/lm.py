"""Interpolated modified Kneser-Ney bigram model, counted in Spark and mapped into memory by its workers.

Counting: tasks gather the bigrams of a few million tokens and send them to shards
of the bigram's hash, so that the followers of a very frequent word are spread
over all shards. A shard adds them up, writes its bigrams as a sorted hash array
with counts to the shared folder, and sends on what words need, as far as it has
it: the number of distinct contexts before a word, and of a context the total and
its followers seen once, twice, and more often. Shards of the words' hashes add
those up and write them as sorted arrays too. Nothing but a few totals reaches
the driver. Words and bigrams are known by 64-bit hashes: among 10^9 distinct words
the odds of one collision are 1 in 37.

Scoring: workers map the arrays and look each text's tokens up, sorted, so that
a lookup runs through an array from front to back. The model is any size; what
one task reads of it is what its texts ask for.

p(y | x) = max(c(xy) - D(c(xy)), 0) / c(x) + gamma(x) * p(y), where
p(y) = max(N(y) - D'(N(y)), 0) / B + gamma * 1 / (V + 1) from the number N(y) of
distinct contexts before y, B of distinct bigrams and V of distinct tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom, store, textkit

#: Hashes of the marks at a text's start and end.
START, END = np.uint64(0x5A17C0DE0001), np.uint64(0x5A17C0DE0002)
#: Tokens that a task gathers before it sends, bytes of text to a shard of bigrams, and bigram shards to one of words.
GATHER, SHARD_TEXT, WORD_SHARES = 2_500_000, 12_000_000, 6
SCORE_CHUNK = 3 << 20


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return textkit.mix64(x * np.uint64(0x9E3779B97F4A7C15) + y)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return bloom.slice_of(textkit.mix64(h), shards)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, token) hashes of all tokens, an end after each text, and the bounds of each text's tokens."""
    starts, ends, bounds = textkit.word_bounds(data, offsets)
    words = textkit.word_hashes(data, starts, ends)
    n = len(offsets) - 1
    y = np.insert(words, bounds[1:], END)
    x = np.insert(words, bounds[:-1], START)
    return x, y, bounds + np.arange(n + 1)


def _pack(values: np.ndarray) -> bytes:
    return values.astype("<u8").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u8")


def _small(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts in a byte each, and those from 255 on as (place, count)."""
    big = np.flatnonzero(counts >= 255)
    return np.minimum(counts, 255).astype(np.uint8).tobytes(), np.stack((big, counts[big].astype(np.int64)), 1).astype("<i8").tobytes()


def _counts(small: bytes | np.ndarray, big: bytes | np.ndarray) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    place = np.frombuffer(big, "<i8").reshape(-1, 2)
    out[place[:, 0]] = place[:, 1]
    return out


PACKED = "shard int, xs binary, followers binary, ys binary, small binary, big binary"


def _packed(x: np.ndarray, y: np.ndarray, shards: int) -> Iterator[tuple]:
    """The bigrams' counts by shard: contexts, followers of each, the followers, their counts."""
    key = _pair(x, y)
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    x, y = x[first], y[first]
    where = bloom.slice_of(key[first], shards)
    order = np.lexsort((x, where))
    x, y, count, where = x[order], y[order], count[order], where[order]
    edge = np.searchsorted(where, np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edge)).tolist():
        a, b = edge[s], edge[s + 1]
        begin = np.flatnonzero(np.concatenate(([True], x[a + 1 : b] != x[a : b - 1])))
        small, big = _small(count[a:b])
        yield s, _pack(x[a:b][begin]), np.diff(np.append(begin, b - a)).astype("<u4").tobytes(), _pack(y[a:b]), small, big


def _gather(texts: DataFrame, shards: int) -> DataFrame:
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int32(), *[pa.binary()] * 5)
        names = ["shard", "xs", "followers", "ys", "small", "big"]
        xs, ys, held = [], [], 0

        def send() -> Iterator[pa.RecordBatch]:
            for row in _packed(np.concatenate(xs), np.concatenate(ys), shards):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for batch in batches:
            data, offsets = textkit.byte_column(batch.column(0))
            for _, _, part, at in textkit.chunks(data, offsets):
                x, y, _ = tokens(part, at)
                xs.append(x)
                ys.append(y)
                held += len(x)
                if held >= GATHER:
                    yield from send()
                    xs, ys, held = [], [], 0
        if held:
            yield from send()

    return texts.mapInArrow(gather, PACKED)


WORDS = "wshard int, kind int, words binary, numbers binary"


def _merge_bigrams(packed: DataFrame, shards: int, word_shards: int, folder: str) -> DataFrame:
    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([np.repeat(_unpack(a), np.frombuffer(b, "<u4")) for a, b in zip(rows["xs"], rows["followers"])])
        y = np.concatenate([_unpack(a) for a in rows["ys"]])
        c = np.concatenate([_counts(a, b) for a, b in zip(rows["small"], rows["big"])])
        pair, first, inverse = np.unique(_pair(x, y), return_index=True, return_inverse=True)
        count = np.bincount(inverse, c, len(pair)).astype(np.int64)
        x, y = x[first], y[first]
        small, big = _small(count)
        store.put(f"{folder}/bigrams-{int(key[0])}", b"".join((np.array([len(pair), len(big) // 16], "<i8").tobytes(), pair.astype("<u8").tobytes(), big, small)))
        out = []

        def send(kind: int, words: np.ndarray, numbers: np.ndarray) -> None:
            where = _shard(words, word_shards)
            order = np.argsort(where, kind="stable")
            edge = np.searchsorted(where[order], np.arange(word_shards + 1))
            for s in np.flatnonzero(np.diff(edge)).tolist():
                own = order[edge[s] : edge[s + 1]]
                out.append((s, kind, _pack(words[own]), b"".join(_small(numbers[own].ravel()))))

        after, times = np.unique(y, return_counts=True)
        send(0, after, times)
        context, inverse = np.unique(x, return_inverse=True)
        table = [np.bincount(inverse, w, len(context)) for w in (count, count == 1, count == 2, count >= 3)]
        send(1, context, np.stack(table, 1).astype(np.int64))
        out.append((-1, 2, b"", np.array([(count == k).sum() for k in (1, 2, 3, 4)] + [len(count)], "<i8").tobytes()))
        return pd.DataFrame(out, columns=["wshard", "kind", "words", "numbers"])

    return packed.groupBy("shard").applyInPandas(merge, WORDS)


WORD = np.dtype([("word", "<u8"), ("count", "<i8"), ("n1", "<i8"), ("n2", "<i8"), ("n3", "<i8"), ("contexts", "<i8")])
TOTALS = ("b1", "b2", "b3", "b4", "bigrams", "w1", "w2", "w3", "w4", "w_more", "types", "words", "texts")


def _merge_words(sent: DataFrame, folder: str) -> DataFrame:
    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = dict.fromkeys(TOTALS, 0)
        if key[0] < 0:
            total = sum(np.frombuffer(b, "<i8") for b in rows["numbers"])
            out |= dict(zip(TOTALS[:5], total.tolist()))
            return pd.DataFrame([out]).astype("int64")
        before, ctx = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
        y = np.concatenate([_unpack(b) for b in before["words"]] or [np.zeros(0, np.uint64)])
        n = np.concatenate([_counts(b[: len(w) // 8], b[len(w) // 8 :]) for w, b in zip(before["words"], before["numbers"])] or [np.zeros(0, np.int64)])
        x = np.concatenate([_unpack(b) for b in ctx["words"]] or [np.zeros(0, np.uint64)])
        t = np.concatenate([_counts(b[: len(w) // 2], b[len(w) // 2 :]).reshape(-1, 4) for w, b in zip(ctx["words"], ctx["numbers"])] or [np.zeros((0, 4), np.int64)])
        word = np.unique(np.concatenate((x, y)))
        made = np.zeros(len(word), WORD)
        made["word"] = word
        made["contexts"] = np.bincount(np.searchsorted(word, y), n, len(word))
        at = np.searchsorted(word, x)
        for i, f in enumerate(("count", "n1", "n2", "n3")):
            # In whole numbers: each shard of bigrams sent its part.
            np.add.at(made[f], at, t[:, i].astype(made[f].dtype))
        store.put(f"{folder}/words-{int(key[0])}", made.tobytes())
        real = (word != START) & (word != END)
        seen = made["contexts"][word != START]
        out |= {f"w{k}": int((seen == k).sum()) for k in (1, 2, 3, 4)}
        out |= {"w_more": int((seen >= 5).sum()), "types": int(real.sum()), "words": int(made["count"][real].sum()), "texts": int(made["count"][word == START].sum())}
        return pd.DataFrame([out]).astype("int64")

    return sent.groupBy("wshard").applyInPandas(merge, ", ".join(f"{t} long" for t in TOTALS))


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """For counts of 1, 2 and 3 or more, from how many there are of 1 to 4; half a count where that can't be told."""
    if not n1 or not n2 or not n3:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))  # type: ignore[return-value]


@dataclass
class Model:
    folder: str
    shards: int
    word_shards: int
    totals: dict[str, int]

    @property
    def train_tokens(self) -> int:
        return self.totals["words"] + self.totals["texts"]

    @property
    def types(self) -> int:
        return self.totals["types"] + (self.totals["texts"] > 0)

    def words_of(self, words: np.ndarray) -> np.ndarray:
        """Entries of sorted, distinct words; zeros where they are unknown."""
        out = np.zeros(len(words), WORD)
        where = _shard(words, self.word_shards)
        for s in np.unique(where).tolist():
            if (raw := store.mapped(f"{self.folder}/words-{s}")) is None or not len(raw):
                continue
            table, own = raw.view(WORD), np.flatnonzero(where == s)
            at = np.minimum(np.searchsorted(table["word"], words[own]), len(table) - 1)
            hit = table["word"][at] == words[own]
            out[own[hit]] = table[at[hit]]
        return out

    def counts_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Counts of bigrams."""
        key = _pair(x, y)
        where = bloom.slice_of(key, self.shards)
        order = np.lexsort((key, where))
        edge = np.searchsorted(where[order], np.arange(self.shards + 1))
        out = np.zeros(len(x), np.int64)
        for s in np.flatnonzero(np.diff(edge)).tolist():
            if (raw := store.mapped(f"{self.folder}/bigrams-{s}")) is None:
                continue
            n, m = raw[:16].view("<i8").tolist()
            keys, big, small = raw[16 : 16 + 8 * n].view("<u8"), raw[16 + 8 * n : 16 + 8 * n + 16 * m].view("<i8").reshape(-1, 2), raw[16 + 8 * n + 16 * m :]
            own = order[edge[s] : edge[s + 1]]
            at = np.minimum(np.searchsorted(keys, key[own]), n - 1)
            hit = keys[at] == key[own]
            count = small[at].astype(np.int64)
            if m:
                large = np.flatnonzero(count == 255)
                count[large] = big[np.searchsorted(big[:, 0], at[large]), 1]
            out[own[hit]] = count[hit]
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, base score, score) of each text."""
        t, total, types = self.totals, self.train_tokens, self.types
        x, y, bounds = tokens(data, offsets)
        distinct, inverse = np.unique(np.concatenate((x, y)), return_inverse=True)
        entry = self.words_of(distinct)
        entry["count"][distinct == END] = t["texts"]
        ix, iy = inverse[: len(x)], inverse[len(x) :]
        seen = entry["count"].astype(np.float64)
        base = np.log10((seen + 0.1) / (total + 0.1 * (types + 1)))
        low = (0.0, *discounts(t["w1"], t["w2"], t["w3"], t["w4"]))
        b, before = max(t["bigrams"], 1), entry["contexts"].astype(np.float64)
        w_more = t["w3"] + t["w4"] + t["w_more"]
        rest = (low[1] * t["w1"] + low[2] * t["w2"] + low[3] * w_more) / b if t["bigrams"] else 1.0
        p1 = np.maximum(before - np.take(low, np.minimum(before, 3).astype(int)), 0) / b + rest / (types + 1)
        high = (0.0, *discounts(t["b1"], t["b2"], t["b3"], t["b4"]))
        ahead = np.where(distinct == START, t["texts"], np.where(distinct == END, 0, seen))
        gamma = np.where(ahead > 0, (high[1] * entry["n1"] + high[2] * entry["n2"] + high[3] * entry["n3"]) / np.maximum(ahead, 1), 1.0)
        count = self.counts_of(x, y)
        p = np.maximum(count - np.take(high, np.minimum(count, 3)), 0) / np.maximum(ahead[ix], 1) + gamma[ix] * p1[iy]
        first = bounds[:-1]
        add = lambda v: np.add.reduceat(v, first) if len(first) else v[:0]
        return np.diff(bounds), add((seen[iy] > 0).astype(np.int64)), add(base[iy]), add(np.log10(p))


def held_out(doc_id: Column) -> Column:
    """Texts that the model doesn't learn from; those without a doc_id are learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def train(texts: DataFrame, column: str = "text") -> Model:
    """The model of every text in ``column``; null counts as empty."""
    spark = texts.sparkSession
    texts = texts.select(F.col(column).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // SHARD_TEXT))
    word_shards = max(1, -(-shards // WORD_SHARES))
    folder = store.new_folder(spark, "bigrams")
    sums = _merge_words(_merge_bigrams(_gather(texts, shards), shards, word_shards, folder), folder)
    row = sums.agg(*[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TOTALS]).first()
    return Model(folder, shards, word_shards, row.asDict())


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Scores of every whole text, held out or not, one row for each row of ``docs``.

    A null text is empty and has the end alone; a very long one is scored in one
    piece, whose arrays are some 200 bytes a word. Repeated rows are scored alike, and rows
    without a doc_id keep their null. Only doc_id and text are read, so other columns
    may have any names. No rows give none; a model of no text knows no token, and
    every probability is then 1 / (V + 1) = 1.
    """
    total = model.train_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.byte_column(batch.column(2))
            for row, end, part, at in textkit.chunks(data, offsets, SCORE_CHUNK):
                n, known, base, score = model.score(part, at)
                own = [batch.column(k).slice(row, end - row) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n), pa.array(known), pa.array(np.full(len(n), total)), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, SCORES)


def perplexity(scores: DataFrame) -> Column:
    """Of a row of ``score_documents``."""
    return F.pow(F.lit(10.0), -scores["score"] / scores["n_tokens"])
