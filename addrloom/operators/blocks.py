"""The best names of many texts below a parent by trigram similarity, where about all of them share a few trigrams.

Postings then join nearly all texts with nearly all names. Here texts and names are
dealt to blocks of their parent, and a task counts the shared trigrams of all pairs
of two blocks in numpy: frequent trigrams by a product of 0 and 1 matrices, the
others by their postings. No pair leaves a task that is not among its text's best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from addrloom.functions import text
from addrloom.operators.stages import cut

#: Texts or names of a block (about, as they are dealt by hash), pairs whose counts are held at once, trigrams or postings that are added at once.
GROUP, AT_ONCE, SLICE = 16_384, 1 << 22, 1 << 20
#: A trigram's postings are added one by one if so many times their number make no more than all pairs.
RARE = 64
#: Parents up to which their numbers of blocks are broadcast.
MANY = 1_000_000
#: A day after all others.
LAST_DAY = 2**31 - 1


def postings(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, row) of each element of a column of lists, and each list's length."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size), size


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``start`` on, ``size`` of them, one after the other."""
    return np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def _among(codes: np.ndarray, rows: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(vocabulary, codes), len(vocabulary) - 1)
    known = vocabulary[at] == codes
    return at[known], rows[known]


def shared_counts(q_tok: np.ndarray, q_row: np.ndarray, n_q: int, n_tok: np.ndarray, n_row: np.ndarray, n_n: int, v: int) -> np.ndarray:
    """How many of ``v`` tokens each of ``n_q`` rows shares with each of ``n_n``, as 4-byte floats; ``n_tok`` is sorted."""
    out = np.zeros((n_q, n_n), np.float32)
    of_q, of_n = np.bincount(q_tok, minlength=v), np.bincount(n_tok, minlength=v)
    start = np.r_[0, np.cumsum(of_n)]
    dense = np.flatnonzero(of_q * of_n * RARE > n_q * n_n)
    place = np.full(v, -1)
    width = max(SLICE // max(n_q, n_n), 1)
    for s in range(0, len(dense), width):
        part = dense[s : s + width]
        place[:] = -1
        place[part] = np.arange(len(part))
        a, b = np.zeros((n_q, len(part)), np.float32), np.zeros((len(part), n_n), np.float32)
        mine, theirs = place[q_tok] >= 0, place[n_tok] >= 0
        a[q_row[mine], place[q_tok[mine]]] = 1
        b[place[n_tok[theirs]], n_row[theirs]] = 1
        out += a @ b
    place[:] = -1
    place[dense] = 0
    rare = (place[q_tok] < 0) & (of_n[q_tok] > 0)
    tok, row = q_tok[rare], q_row[rare]
    ends, flat, s = np.cumsum(of_n[tok]), out.reshape(-1), 0
    while s < len(tok):
        e = max(int(np.searchsorted(ends, (ends[s - 1] if s else 0) + SLICE, "right")), s + 1)
        size = of_n[tok[s:e]]
        np.add.at(flat, np.repeat(row[s:e] * n_n, size) + n_row[spread(start[tok[s:e]], size)], np.float32(1))
        s = e
    return out


def _best(mine: pa.Table, others: pa.Table, key: list[str], top: int) -> pa.Table:
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    if len(mine) and len(others):
        others = others.sort_by("unit_id")
        ids, (n_code, n_row, n) = others["unit_id"].to_numpy(), postings(others["t"])
        q_code, q_row, m = postings(mine["t"])
        day, first, last = mine["_day"].to_numpy(), others["_first"].to_numpy(), others["_last"].to_numpy()
        vocabulary = np.intersect1d(q_code, n_code)
        if len(vocabulary):
            n_tok, n_row = _among(n_code, n_row, vocabulary)
            order = np.argsort(n_tok, kind="stable")
            n_tok, n_row = n_tok[order], n_row[order]
            q_tok, q_row = _among(q_code, q_row, vocabulary)
            open_always = first.max() <= day.min() and last.min() >= day.max()
            # Up to this size a quotient of 4-byte floats is that of doubles, rounded.
            kind = np.float32 if m.max() + n.max() < 4096 else np.float64
            rows = max(AT_ONCE // len(ids), 1)
            for s in range(0, len(mine), rows):
                e = min(s + rows, len(mine))
                a, b = np.searchsorted(q_row, (s, e))
                c = shared_counts(q_tok[a:b], q_row[a:b] - s, e - s, n_tok, n_row, len(ids), len(vocabulary)).astype(kind, copy=False)
                sim = (c / np.maximum((m[s:e, None] + n[None]).astype(kind) - c, 1)).astype(np.float32, copy=False)
                if not open_always:
                    sim[(first[None] > day[s:e, None]) | (last[None] < day[s:e, None])] = 0
                at = np.arange(e - s)
                for _ in range(min(top, len(ids))):
                    # The first of equal ones, which has the smallest id.
                    j = sim.argmax(1)
                    best = sim[at, j]
                    hit = best > 0
                    if not hit.any():
                        break
                    found.append((at[hit] + s, ids[j[hit]], best[hit]))
                    sim[at, j] = 0
    row, ids, sim = map(np.concatenate, zip(*found))
    return mine.select(key).take(pa.array(row)).append_column("unit_id", pa.array(ids)).append_column("sim", pa.array(sim))


def dealt(left: DataFrame, right: DataFrame, block: list[str], left_by: list[str], right_by: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides, dealt by the hash of some columns to groups of a block in which all pairs of two groups meet, and what to group them by."""
    of = lambda df, n: df.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias(n))
    count = cut(of(left, "_nq").join(of(right, "_nr"), block))
    if count.count() <= MANY:
        count = F.broadcast(count)
    groups = [*block, "_gq", "_gr"]
    # As many tasks on either side, whatever the tables' sizes: it is the pairs that take time.
    tasks = max(4 * left.sparkSession.sparkContext.defaultParallelism, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def deal(df: DataFrame, by: list[str], own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
        rows = df.join(count, block).select(*df.columns, F.pmod(F.xxhash64(*by), F.col(own[1])).cast("int").alias(own[0]), F.explode(F.sequence(F.lit(0), F.col(other[1]) - 1)).alias(other[0]))
        return rows.repartition(tasks, *groups)

    return deal(left, left_by, ("_gq", "_nq"), ("_gr", "_nr")), deal(right, right_by, ("_gr", "_nr"), ("_gq", "_nq")), groups


def best_names(asked: DataFrame, names: DataFrame, block: list[str], top: int) -> DataFrame:
    """(block, variant, as_of, unit_id, sim float): for distinct (block, variant, as_of) rows the ``top`` best (block, unit_id, ascii_name, valid_from, valid_to) rows valid on the day and of each pair of blocks, by similarity above 0, then by the smaller id.

    Whoever ranks them over all blocks has the best of all. The ids are unique below a parent.
    """
    key = [*block, "variant", "as_of"]
    asked = asked.where(F.col("variant").isNotNull() & F.col("as_of").isNotNull()).select(*key, F.unix_date("as_of").alias("_day"))
    names = names.where(F.col("valid_from").isNotNull()).select(*block, "unit_id", "ascii_name", F.unix_date("valid_from").alias("_first"), F.coalesce(F.unix_date("valid_to"), F.lit(LAST_DAY)).alias("_last"))
    left, right, groups = dealt(asked, names, block, ["variant", "as_of"], ["unit_id"])
    # Trigrams are taken behind the shuffle.
    left, right = left.withColumn("t", text.trigram_codes(F.col("variant"))), right.select("*", text.trigram_codes(F.col("ascii_name")).alias("t")).drop("ascii_name")
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.select(*key).schema) + ", unit_id bigint, sim float"
    return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(lambda a, b: _best(a, b, key, top), out)
