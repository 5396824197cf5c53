"""Exact top-k search by inner product as a Voronoi kNN join.

Pivots part queries and data into Voronoi cells. Cells are cut into rings by the
distance to the pivot, and a ring of many rows into blocks of bounded size. A
block's summary (its pivot, least and largest distance, largest norm, and the ids
that it counts for) bounds the scores between a query group and a data block from
below and above. The k-th best lower bound of a group over the summaries gives its
threshold; a block is sent to a group only if its upper bound reaches that
threshold. Each pair of group and block is solved locally, and the best k of a
query's blocks are merged.

Each id counts in one block only, however often it is repeated: a query can leave
out its own id and still have k other ids in the blocks that set its threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store

K, SCALE = 10, 1024
#: Pivots for n rows are sqrt(n) / 8, up to MAX_PIVOTS; rows of a block, queries of a group, groups of a planning task.
MAX_PIVOTS, BLOCK_ROWS, GROUP_QUERIES, PLAN_GROUPS = 512, 4096, 512, 64
#: Steps of distance that a cell's rows are counted by to cut it into rings.
STEPS = 64
LONG = (1 << 63) - 1


def quantized(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(vec_id, v array<long>, dim) of the vectors that take part.

    Each component x becomes floor(1024 * x), x as double. Vectors that are null or
    hold null or non-finite components, or leave the range of longs, take no part,
    nor do rows without an id.
    """
    x = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    ok = F.forall(F.col("x"), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float(LONG // SCALE)))
    return rows.where(ok).select("vec_id", F.transform("x", lambda e: F.floor(e * SCALE).cast("long")).alias("v"), F.size("x").alias("dim"))


def _matrix(column: pa.Array | pd.Series, dim: int) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.stack(column.to_numpy()).astype(np.int64) if len(column) and dim else np.zeros((len(column), dim), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows; as Python integers where they could pass 64 bits."""
    top = (float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))) * max(1, a.shape[1])
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 2**62:
        return a @ b.T
    wide = a.astype(object) @ b.astype(object).T
    return np.minimum(np.maximum(wide, -LONG - 1), LONG).astype(np.int64)


def _pivots(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Pivots of each dimension: the rows whose hash comes first, their number bounded by MAX_PIVOTS."""
    count = int(min(MAX_PIVOTS, max(1, n**0.5 / 8)))
    got = rows.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(count).select("dim", "v").collect()
    found: dict[int, list] = {}
    for r in got:
        found.setdefault(r["dim"], []).append(r["v"])
    return {d: np.unique(np.array(v, np.float64).reshape(-1, d), axis=0) for d, v in found.items()}


CELLS = "vec_id long, v array<long>, dim int, cell int, dist double, norm double"


def _cells(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with the nearest pivot, the distance to it and the norm."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                x = _matrix(part.column(1), d).astype(np.float64)
                p = shared.value.get(d)
                p = np.zeros((1, d)) if p is None else p
                square = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)[None, :]
                cell = square.argmin(1)
                dist = np.sqrt(((x - p[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(dist), pa.array(np.sqrt((x * x).sum(1)))], ["vec_id", "v", "dim", "cell", "dist", "norm"])

    return rows.select("vec_id", "v", "dim").mapInArrow(assign, CELLS)


def _blocked(cells: DataFrame, each: int, name: str) -> DataFrame:
    """Cells cut into blocks of about ``each`` rows: rings of distance from the pivot, and where a step of distance alone holds more, by a hash of the row.

    Rows are counted by cell and step, and only those counts are summed up in order.
    """
    edges = cells.groupBy("dim", "cell").agg(F.max("dist").alias("_most"))
    stepped = cells.join(edges, ["dim", "cell"]).withColumn("_step", F.least(F.lit(STEPS - 1), F.floor(F.col("dist") / F.greatest("_most", F.lit(1e-300)) * STEPS)).cast("int")).drop("_most")
    sizes = store.keep(stepped.groupBy("dim", "cell", "_step").agg(F.count(F.lit(1)).alias("_n")), "steps")
    before = Window.partitionBy("dim", "cell").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    ring = F.floor(F.coalesce(F.sum("_n").over(before), F.lit(0)) / each)
    sizes = sizes.select("dim", "cell", "_step", "_n", ring.alias("_ring"))
    cut = stepped.join(sizes, ["dim", "cell", "_step"])
    part = F.when(F.col("_n") > each, F.pmod(F.xxhash64(F.lit(3), "vec_id", "dist"), F.ceil(F.col("_n") / each)) + 1).otherwise(0)
    return cut.withColumn(name, F.xxhash64("dim", "cell", "_ring", F.when(F.col("_n") > each, F.col("_step")), part)).drop("_n", "_ring", "_step")


def _bounds(query: pd.DataFrame, data: pd.DataFrame, pivots: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(group, block) pairs that may hold one of a group's best ``k`` ids; the ids that a block's ``rows`` count are in no other's."""
    p = pivots[query["cell"]] @ pivots[data["cell"]].T
    pn = np.linalg.norm(pivots, axis=1)
    # q = p + dq and x = s + dx with |dq| <= rq and |dx| <= rx: the product lies within this of p.s.
    rq, rx = query["radius"].to_numpy()[:, None], data["radius"].to_numpy()[None, :]
    qn, xn = query["norm"].to_numpy()[:, None], data["norm"].to_numpy()[None, :]
    far = rq * pn[data["cell"]][None, :]
    room = (1 + 1e-9) * far + 1e-6 * (1 + np.abs(p))
    low = p - room - (1 + 1e-9) * (pn[query["cell"]][:, None] * rx + rq * rx)
    high = np.minimum(p + room + (1 + 1e-9) * qn * rx, (1 + 1e-9) * qn * xn + 1e-6)
    # Also 2 q.x = |q|^2 + |x|^2 - |q - x|^2, and a ring keeps its distance from q's ball.
    both = pn[query["cell"]][:, None] + pn[data["cell"]][None, :]
    apart = np.sqrt(np.maximum(both**2 - 2 * (pn[query["cell"]][:, None] * pn[data["cell"]][None, :] + p), 0))
    off = 1e-6 * both + 1e-3
    inner = data["inner"].to_numpy()[None, :] if "inner" in data else 0
    gap = np.maximum(np.maximum(apart - off - rq - rx, inner - apart - off - rq), 0)
    high = np.minimum(high, (qn**2 + xn**2 - gap**2) / 2 + 1e-9 * (qn**2 + xn**2) + 1e-6)
    # Scores that stop at a long's ends are ties there, so bounds beyond them tell nothing.
    end = float(LONG) * (1 - 1e-9)
    low, high, out = np.minimum(low, end), np.maximum(high, -end), []
    n = data["rows"].to_numpy()
    for i in range(len(query)):
        order = np.argsort(-low[i], kind="stable")
        enough = np.searchsorted(np.cumsum(n[order]), k)
        least = low[i][order[enough]] if enough < len(order) else -np.inf
        out += [(query["grp"].iloc[i], b) for b in data["block"].to_numpy()[high[i] >= least]]
    return out


def top_k(df: DataFrame, queries: DataFrame, k: int = K, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` highest integer inner products over ``df``.

    A candidate is every row with another id than the query's; ties go to the
    smaller id, and a query with fewer candidates has them all. Vectors of another
    length than the query's are no candidates. Rows that repeat an id are
    candidates of their own, and repeated queries are one. Scores beyond a long
    stop at its ends. Empty tables give no rows.
    """
    data = store.cut(quantized(df, id_column, vector))
    asked = store.cut(quantized(queries, id_column, vector).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("s")).select("vec_id", "s.v", "s.dim"))
    n, q = data.count(), asked.count()
    spark = df.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n or not q:
        return none
    pivots = _pivots(data, n)
    data = store.cut(_blocked(_cells(data, pivots), BLOCK_ROWS, "block"))
    # Queries go by as many of the pivots as give groups of some size: each group has blocks sent to it.
    few = max(1, -(-q // (GROUP_QUERIES // 2)))
    asked = store.cut(_blocked(_cells(asked, {d: p[:few] for d, p in pivots.items()}), GROUP_QUERIES, "grp"))
    # Summaries: a row for each block, 1 / BLOCK_ROWS of the data plus one for each cell.
    blocks = data.groupBy("dim", "cell", "block").agg(F.max("dist").alias("radius"), F.min("dist").alias("inner"), F.max("norm").alias("norm"))
    # An id counts for the least of its blocks; partial minima keep a very common id from meeting in one task.
    counted = data.groupBy("dim", "vec_id").agg(F.min("block").alias("block")).groupBy("dim", "block").agg(F.count(F.lit(1)).alias("rows"))
    blocks = store.keep(blocks.join(counted, ["dim", "block"], "left").fillna(0, ["rows"]), "summaries")
    groups = asked.groupBy("dim", "cell", "grp").agg(F.max("dist").alias("radius"), F.max("norm").alias("norm"))
    shared = spark.sparkContext.broadcast(pivots)

    def plan(key: tuple, g: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        d = int(key[0])
        p = shared.value.get(d)
        found = _bounds(g, b, np.zeros((1, d)) if p is None else p, k + 1) if len(g) and len(b) else []
        return pd.DataFrame(found, columns=["grp", "cell"]).astype("int64")

    # First whole cells, of which there are as many as pivots: a task plans a few groups against all cells of their dimension.
    parts = max(1, -(-(-(-q // GROUP_QUERIES) + MAX_PIVOTS) // PLAN_GROUPS)) if q > GROUP_QUERIES else 1
    groups = store.keep(groups.withColumn("part", F.pmod(F.xxhash64("grp"), F.lit(parts))), "groups")
    whole = blocks.groupBy("dim", "cell").agg(F.max("radius").alias("radius"), F.max("norm").alias("norm"), F.sum("rows").alias("rows")).withColumn("block", F.col("cell").cast("long"))
    whole = whole.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    near = groups.groupBy("dim", "part").cogroup(whole.groupBy("dim", "part")).applyInPandas(plan, "grp long, cell long")

    def refine(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        d = int(rows["dim"].iloc[0])
        p = shared.value.get(d)
        g = rows.iloc[:1][["grp", "q_cell", "q_radius", "q_norm"]].set_axis(["grp", "cell", "radius", "norm"], axis=1)
        return pd.DataFrame(_bounds(g, rows, np.zeros((1, d)) if p is None else p, k + 1), columns=["grp", "block"]).astype("int64")

    # Then the blocks of those cells: a group's task has a row of 60 bytes for each of them, 1 / BLOCK_ROWS of the data at most.
    mine = groups.select("grp", "dim", F.col("cell").alias("q_cell"), F.col("radius").alias("q_radius"), F.col("norm").alias("q_norm"))
    of = near.join(mine, "grp").join(blocks.withColumn("cell", F.col("cell").cast("long")), ["dim", "cell"])
    pairs = store.keep(of.groupBy("grp").applyInPandas(refine, "grp long, block long"), "pairs")
    packed = data.groupBy("block").agg(F.collect_list(F.struct("vec_id", "v")).alias("d"))
    bundles = asked.groupBy("grp").agg(F.first("dim").alias("dim"), F.collect_list(F.struct("vec_id", "v")).alias("q"))
    met = pairs.join(packed, "block").join(bundles, "grp").select("dim", "d", "q")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                dim = batch.column(0)[i].as_py()
                d, asks = batch.column(1)[i].values, batch.column(2)[i].values
                ids, own = d.field(0).to_numpy(zero_copy_only=False), asks.field(0).to_numpy(zero_copy_only=False)
                x, y = _matrix(d.field(1), dim), _matrix(asks.field(1), dim)
                order = np.argsort(ids, kind="stable")
                ids, score = ids[order], products(y, x[order])
                out_q, out_v, out_s = [], [], []
                for j, me in enumerate(own.tolist()):
                    s, other = score[j], ids != me
                    if len(s) > k + 1:
                        # Everything above or at the (k + 1)-th best; ties are settled by the stable sort below.
                        edge = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                        other &= s >= edge
                        if (ids == me).sum() > 1:
                            other = ids != me
                    at = np.flatnonzero(other)
                    best = at[np.argsort(-s[at].astype(object) if s.min(initial=0) == -LONG - 1 else -s[at], kind="stable")[:k]]
                    out_q.append(np.full(len(best), me))
                    out_v.append(ids[best])
                    out_s.append(s[best])
                if out_q:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (out_q, out_v, out_s)], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
