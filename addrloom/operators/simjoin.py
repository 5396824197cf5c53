"""Similarity joins over trigram sets that don't read the postings of common trigrams.

Trigrams are put in one order, the rarest of the indexed names first. Two sets
with a similarity of at least t share a trigram among the first n - ceil(t * n) + 1
of either (the prefix), so only those are looked up, and the common ones at the
end never are. What meets must also be of sizes that can reach t, and must have
enough trigrams left behind the place where it meets. A pair meets at each
trigram it shares and is kept at the first one alone, so that no pairs are
grouped: its similarity is taken there, from the sets that both sides carry.

Both sides also carry 64 bits, one set for each trigram, whose differing bits tell
most pairs apart that cannot have enough in common.

A join with a threshold (``alike``) leaves out trigrams that the other side lacks, and
looks up no more of a set than the sizes on the other side ask for, so a template that
all names share is never looked up. Few trigrams of digits serve many names, though, so
within the group of a trigram two sets must meet at a second one that they share.

A join for the k best names has no high threshold to begin with. It looks up as
many trigrams as names of similarity ``PROBES[0]`` need; the k-th best found is a
bound that the k-th best of all can't be below, and only texts whose bound is
below look further trigrams up, as far as the next probe or the bound asks for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrloom.functions import text
from addrloom.operators import blocks
from addrloom.operators.stages import cut

#: The similarities whose prefixes are looked up in turn before the last bound holds.
PROBES = (0.9, 0.7)
#: Trigrams up to which their frequencies are broadcast, some 30 MB; more are joined.
SMALL = 1_000_000
#: Similarities are compared as 4-byte floats, bounds before that a little lower.
SLACK = 1 - 1e-6


def frequencies(names: DataFrame, column: str) -> DataFrame:
    """(g, id): a number for each trigram of ``column``, smaller for rarer ones; to be broadcast if there are few."""
    counts = names.select(F.explode(text.trigrams(F.col(column))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    # A sort by ranges, whose partitions number their rows in turn.
    freq = cut(counts.orderBy("df", "g").select("g", F.monotonically_increasing_id().alias("id")))
    return F.broadcast(freq) if freq.count() <= SMALL else freq


def by_rarity(rows: DataFrame, key: list[str], column: str, freq: DataFrame) -> DataFrame:
    """(key, x, m, bits) of each row with trigrams: the numbers of those that ``freq`` knows, rarest first, how many there are in all, and a bit for each number."""
    spread = rows.select(*key, F.explode(text.trigrams(F.col(column))).alias("g")).join(freq, "g", "left")
    return spread.groupBy(*key).agg(F.sort_array(F.collect_list("id")).alias("x"), F.count(F.lit(1)).cast("int").alias("m"), F.coalesce(F.bit_or(F.expr("shiftleft(1L, cast(id % 64 AS INT))")), F.lit(0).cast("bigint")).alias("bits"))


def postings(rows: DataFrame, key: list[str], column: str, freq: DataFrame) -> DataFrame:
    """(key, y, n, also, j, g): a row for each trigram of each row, with its place in the order (from 0) and the whole set."""
    return by_rarity(rows, key, column, freq).select(*key, F.col("x").alias("y"), F.col("m").alias("n"), F.col("bits").alias("also"), F.posexplode("x").alias("j", "g"))


def set_sizes(index: DataFrame) -> list[int]:
    """The sizes of the sets in ``postings``; there are no more than the longest name has trigrams."""
    return sorted(r["n"] for r in index.select("n").distinct().collect())


def prefix(size: Column, t: Column) -> Column:
    """How many trigrams of a set of ``size`` hold one that it shares with any set of similarity ``t`` or more."""
    return size - F.ceil(size * t * SLACK) + 1


def meet(asked: DataFrame, index: DataFrame, block: list[str], t: Column, start: Column, stop: Column, where: Column | None = None, sizes: list[int] | None = None) -> DataFrame:
    """``asked`` (with ``x`` and ``m`` of ``by_rarity``) with what it meets in ``index`` at similarity above or at ``t``.

    A pair is there once, if its first common trigram has a place from ``start`` to
    before ``stop``; ``sim`` is a 4-byte float. ``block`` columns are equal on both
    sides. Trigrams that the index lacks have the first places and meet nothing. With
    the ``sizes`` that sets of the index have, only those are looked up that can be
    similar enough.
    """
    m, n = F.col("m"), F.col("n")
    unknown = m - F.size("x")
    low, high = F.greatest(start - unknown, F.lit(0)).cast("int"), (F.least(stop, m) - unknown).cast("int")
    looked = asked.where(high > low).select("*", F.posexplode(F.slice("x", low + 1, high - low)).alias("i", "g")).withColumn("i", F.col("i") + low + unknown)
    if sizes is not None:
        # At place i at most m - i trigrams can be shared, which bounds the other set's size from above.
        most = (m - F.col("i")) * ((1 + t) / t) / SLACK - m
        fit = F.filter(F.array(*map(F.lit, sizes)), lambda z: (z >= m * t * SLACK) & (z <= most))
        looked = looked.withColumn("n", F.explode(fit))
    met = looked.join(index, [*block, "g"] + (["n"] if sizes is not None else []))
    shared = t / (1 + t) * (m + n) * SLACK
    apart = F.bit_count(F.col("bits").bitwiseXOR(F.col("also"))) + unknown
    enough = (F.least(m, n) >= t * F.greatest(m, n) * SLACK) & (m + n - apart >= 2 * shared) & (1 + F.least(m - 1 - F.col("i"), n - 1 - F.col("j")) >= shared) & (F.col("j") < prefix(n, t))
    met = met.where(enough if where is None else enough & where)
    met = met.withColumn("_shared", F.array_intersect("x", "y")).where(F.element_at("_shared", 1) == F.col("g"))
    return met.withColumn("sim", text.overlap(F.size("_shared"), m, n)).drop("_shared", "y", "n", "also", "j", "g", "i")


def _ranked(df: DataFrame, codes: np.ndarray, every: bool) -> DataFrame:
    """Texts with the numbers ``x`` of their trigrams, rarest first, and how many trigrams there are in all (``m``) and in ``x`` (``k``).

    ``codes`` has the most frequent trigrams of both sides, rarest first; others are
    on one side only if these are ``every`` one, and else come first, by their codes.
    """
    order = np.argsort(codes)
    known = codes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, row, m = blocks.postings(pa.chunked_array([batch["t"]]))
            at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
            hit = known[at] == code if len(known) else np.zeros(len(code), bool)
            number = np.where(hit, order[at] if len(known) else 0, code - 2**62 - 2**62)
            if every:
                number, row = number[hit], row[hit]
            number = number[np.lexsort((number, row))]
            k = np.bincount(row, minlength=len(m))
            x = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(k)], pa.int32()), pa.array(number, pa.int64()))
            rest = [c for c in batch.schema.names if c != "t"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in rest), x, pa.array(m, pa.int32()), pa.array(k, pa.int32())], [*rest, "x", "m", "k"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "t")
    return df.mapInArrow(run, f"{kept}, x array<bigint>, m int, k int")


def _least_shared(m: np.ndarray, n: np.ndarray, t: float) -> np.ndarray:
    return np.maximum(np.ceil(t / (1 + t) * (m + n) * SLACK), 1).astype(np.int64)


def _looked_up(df: DataFrame, own: list[tuple[int, int]], other: list[tuple[int, int]], t: float) -> DataFrame:
    """A row for each trigram ``g`` that a text is looked up by, with its place ``i`` and the fewest trigrams (``o``) that it must share with any set of the other side."""
    z, kz = (np.array([s[i] for s in other], np.int64) for i in (0, 1))
    least = []
    for m, k in own:
        o = _least_shared(m, z, t)
        o = o[(o <= k) & (o <= kz)] if len(z) else o
        if len(o):
            least.append((m, k, int(o.min())))
    sizes = df.sparkSession.createDataFrame(least, "m int, k int, o int")
    return df.join(F.broadcast(sizes), ["m", "k"]).select("*", F.posexplode(F.slice("x", 1, F.col("k") - F.col("o") + 1)).alias("i", "g"))


def _tails(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Each row's numbers as (number, row), the rows' first ones, sizes ``m`` and ``k``, and (second number, row) pairs to meet by; a row that may share one alone has the largest number as well."""
    number, row, k = blocks.postings(table["x"])
    start = np.r_[0, np.cumsum(k)[:-1]]
    m, i, o = (table[c].to_numpy().astype(np.int64) for c in ("m", "i", "o"))
    size = np.clip(k - i - 1 - o + 2, 0, k - i - 1)
    at = blocks.spread(start + i + 1, size) if len(size) else np.zeros(0, np.int64)
    alone = np.flatnonzero(o == 1)
    return number, row, start, m, k, np.r_[number[at], np.full(len(alone), LAST)], np.r_[row[at], alone]


#: Stands for no second trigram.
LAST = 2**63 - 1


def _meet(mine: pa.Table, others: pa.Table, key: list[str], t: float) -> pa.Table:
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    if len(mine) and len(others):
        g = mine["g"][0].as_py()
        a, a_row, a_start, m, ka, a_sig, a_of = _tails(mine)
        b, b_row, _, n, kb, b_sig, b_of = _tails(others)
        sketch = lambda x, row, size: np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (x % 64).astype(np.uint64)), np.r_[0, np.cumsum(size)[:-1]])
        bits, also = sketch(a, a_row, ka), sketch(b, b_row, kb)
        tokens = np.unique(b)
        has = np.sort(b_row * len(tokens) + np.searchsorted(tokens, b))
        order = np.argsort(b_sig, kind="stable")
        b_sig, b_of = b_sig[order], b_of[order]
        low, high = np.searchsorted(b_sig, a_sig, "left"), np.searchsorted(b_sig, a_sig, "right")
        ends, s = np.cumsum(high - low), 0
        while s < len(a_sig):
            e = max(int(np.searchsorted(ends, (ends[s - 1] if s else 0) + blocks.SLICE, "right")), s + 1)
            size = high[s:e] - low[s:e]
            q, d, h = np.repeat(a_of[s:e], size), b_of[blocks.spread(low[s:e], size)], np.repeat(a_sig[s:e], size)
            least = _least_shared(m[q], n[d], t)
            keep = (ka[q] + kb[d] - np.bitwise_count(bits[q] ^ also[d]).astype(np.int64) >= 2 * least) & ((least == 1) == (h == LAST))
            q, d, h, least = q[keep], d[keep], h[keep], least[keep]
            width = max(blocks.SLICE // max(int(ka.max()), 1), 1)
            for p in range(0, len(q), width):
                qs, ds, hs = q[p : p + width], d[p : p + width], h[p : p + width]
                x = a[blocks.spread(a_start[qs], ka[qs])]
                at = np.minimum(np.searchsorted(tokens, x), len(tokens) - 1)
                pair = np.repeat(np.arange(len(qs)), ka[qs])
                want = ds[pair] * len(tokens) + at
                hit = (tokens[at] == x) & (has[np.minimum(np.searchsorted(has, want), len(has) - 1)] == want)
                c = np.bincount(pair[hit], minlength=len(qs))
                # The pair is taken at the first two trigrams that it shares.
                first = np.bincount(pair[hit & (x < np.where(hs == LAST, g, hs)[pair])], minlength=len(qs)) == (hs != LAST)
                good = first & (c >= least[p : p + width])
                qs, ds, c = qs[good], ds[good], c[good]
                found.append((qs, ds, (c / (m[qs] + n[ds] - c)).astype(np.float32)))
            s = e
    q, d, sim = map(np.concatenate, zip(*found))
    return mine.select(key).take(pa.array(q)).append_column("_right", others["_right"].take(pa.array(d))).append_column("sim", pa.array(sim, pa.float32()))


def alike(left: DataFrame, right: DataFrame, block: list[str], threshold: float) -> DataFrame:
    """(block, _left, _right, sim float) of all pairs of texts of (block, _left) and (block, _right) with a similarity of about ``threshold`` or more, which lies above 0.

    Texts go to the groups of the few trigrams that they are looked up by; groups are
    parted by ``blocks.dealt``, so a task holds no more whatever their size.
    """
    tasks = max(4 * left.sparkSession.sparkContext.defaultParallelism, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = lambda df, c: df.select(*block, c).where(reduce(Column.__and__, [F.col(x).isNotNull() for x in (*block, c)])).repartition(tasks, *block, c).dropDuplicates().withColumn("t", text.trigram_codes(F.col(c)))
    left, right = texts(left, "_left"), texts(right, "_right")
    # An outer explode, as filters on its input would take the trigrams once more before the rows are dealt out.
    of = lambda df, n: df.select(F.explode_outer("t").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias(n))
    both = cut(of(left, "a").join(of(right, "b"), "g"))
    codes = np.array([r["g"] for r in both.orderBy(F.desc(F.col("a") + F.col("b")), "g").limit(SMALL).collect()][::-1], np.int64)
    every = both.count() <= SMALL
    left, right = cut(_ranked(left, codes, every)), cut(_ranked(right, codes, every))
    sizes = [[(r["m"], r["k"]) for r in df.select("m", "k").distinct().collect()] for df in (left, right)]
    asked, index = _looked_up(left, sizes[0], sizes[1], threshold), _looked_up(right, sizes[1], sizes[0], threshold)
    asked, index, groups = blocks.dealt(asked, index, [*block, "g"], ["_left"], ["_right"])
    key = [*block, "_left"]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.select(*key).schema) + ", _right string, sim float"
    return asked.groupBy(*groups).cogroup(index.groupBy(*groups)).applyInArrow(lambda a, b: _meet(a, b, key, threshold), out)


def threshold_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, column: str, threshold: float, block: list[str] | None = None, score: Column | None = None) -> DataFrame:
    """(left_key, right_key, sim) of all pairs with a similarity of ``threshold`` or more, which lies above 0.

    Both sides have ``column``, whose texts are compared once however many rows
    have them, and the ``block`` columns, in which pairs must agree. A null text
    and one without letters or digits is like nothing; rows without a value in a
    block column meet nothing. Keys are passed on as they are, repeated or null.
    ``score``, of ``sim``, stands in its place; it is taken once for each two texts, of
    which many rows may have either.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and not above 1")
    block = block or []
    pairs = alike(left.select(*block, F.col(column).alias("_left")), right.select(*block, F.col(column).alias("_right")), block, threshold).where(F.col("sim") >= F.lit(threshold).cast("float"))
    pairs = pairs.select(*block, "_left", "_right", (F.col("sim") if score is None else score).alias("sim"))
    # Rows of one text go as lists to the join and are spread at the end, where all pairs come out; a list has no more than 2 ** 18.
    part = F.shiftright(F.monotonically_increasing_id(), 18)
    side = lambda df, key, name: df.select(*block, F.col(column).alias(name), F.struct(F.col(key).alias("key")).alias("_k"), part.alias("_part")).groupBy(*block, name, "_part").agg(F.collect_list("_k").alias(f"{name}_keys")).drop("_part")
    found = pairs.join(side(left, left_key, "_left"), [*block, "_left"]).join(side(right, right_key, "_right"), [*block, "_right"])
    found = found.repartition(max(left.sparkSession.sparkContext.defaultParallelism, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *block, "_left", "_right").select("sim", "_right_keys", F.explode("_left_keys").alias("_l"))
    return found.select("sim", "_l", F.explode("_right_keys").alias("_r")).select(F.col("_l.key").alias(left_key), F.col("_r.key").alias(right_key), "sim")


def top_k(asked: DataFrame, index: DataFrame, key: list[str], block: list[str], k: int, where: Column | None = None, sizes: list[int] | None = None, probes: tuple[float, ...] = PROBES) -> DataFrame:
    """``key``, the index's own columns and ``sim``: for each row of ``asked`` all names at least as similar as its k-th best, above its ``least``.

    ``asked`` has ``key`` (unique), ``least``, ``x``, ``m`` and ``bits``, and is read for each probe
    and once more. Names as similar as the k-th best are all there, so whoever ranks
    them may settle ties.
    """
    m, own = F.col("m"), [c for c in index.columns if c not in (*block, "y", "n", "also", "j", "g")]
    order = Window.partitionBy(*key).orderBy(F.desc("sim"))
    rows, found = asked.withColumn("_t", F.col("least")).withColumn("_from", F.lit(0).cast("bigint")), None
    for probe in (*probes, None):
        t = F.col("_t")
        stop = prefix(m, t) if probe is None else F.least(prefix(m, F.lit(probe)), prefix(m, t))
        met = meet(rows.where(stop > F.col("_from")), index, block, t, F.col("_from"), stop, where, sizes if probe is None else None)
        met = met.where(F.col("sim") > F.col("least")).select(*key, *own, "sim")
        found = met if found is None else found.unionByName(met)
        if probe is not None:
            found = found.withColumn("_r", F.rank().over(order)).where(F.col("_r") <= k).drop("_r")
            bound = found.groupBy(*key).agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).cast("double").alias("_b"))
            rows = rows.withColumn("_from", F.greatest(stop, "_from")).join(bound, key, "left").withColumn("_t", F.greatest("least", F.coalesce("_b", F.lit(0.0)))).drop("_b")
    return found.withColumn("_r", F.rank().over(order)).where(F.col("_r") <= k).drop("_r")
