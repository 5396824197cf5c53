"""Extendible hashing: a directory of hash prefixes in which only oversized buckets split.

A bucket at depth d holds the rows whose hash starts with its d bits. It splits
on bit d + 1 if its bytes exceed the limit, so shards have different depths and
the directory is a binary tree. Sums are taken once at a depth of a few bits
more than the even split needs and rolled up by halves; the few buckets that are
still oversized there go on, bit by bit, with their own rows only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

MAX_DEPTH = 62
EXTRA_BITS = 3
#: Depths that are rolled up in one pass.
ROLL = 8
ROWS_PER_PART = 20_000


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("_hash", 64 - depth) if depth else F.lit(0).cast("long")


def shard(df: DataFrame, keys: list[str], weight: Column, limit: int) -> DataFrame:
    """(keys, bytes, shard, depth, slice, shard_bytes) of each row.

    ``shard`` is the bucket's bits, followed by a dot and the slice number where
    rows with one and the same hash exceed the limit together: those are cut into
    slices by their running bytes, so a hot key has as many shards as it
    needs. Only a single row above the limit makes a shard above the limit.
    Null keys hash like a value of their own; a null weight counts as 0.
    """
    if limit < 1:
        raise ValueError("the limit must be positive")
    if clash := {"bytes", "shard", "depth", "slice", "shard_bytes"} & set(keys):
        raise ValueError(f"{sorted(clash)} are columns of the result")
    rows = df.select(*[F.col(f"`{k}`") for k in keys], F.coalesce(weight.cast("long"), F.lit(0)).alias("bytes")).withColumn("_hash", F.xxhash64(F.lit(1), *keys))
    rows = store.cut(rows)
    total = rows.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    top = min(MAX_DEPTH, max(1, math.ceil(math.log2(max(2.0, total / limit))) + EXTRA_BITS))
    sums = lambda d, of: of.groupBy(_prefix(d).alias("prefix")).agg(F.sum("bytes").alias("shard_bytes")).withColumn("depth", F.lit(d))
    levels, base = [store.cut(sums(top, rows))], top
    # The sums of ROLL depths at a time: the buckets shrink by halves, so each pass reads far fewer than the one before.
    while base > 0:
        each = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftrightunsigned("prefix", base - d).alias("prefix")) for d in range(max(0, base - ROLL), base)]))
        up = levels[-1].where(F.col("depth") == base).select("shard_bytes", each.alias("at")).groupBy("at.depth", "at.prefix").agg(F.sum("shard_bytes").alias("shard_bytes"))
        levels.append(store.cut(up.select("prefix", "shard_bytes", "depth")))
        base = max(0, base - ROLL)
    deep, depth = levels[0].where(F.col("shard_bytes") > limit), top
    pending = rows.join(deep.select("prefix"), _prefix(top) == F.col("prefix"), "left_semi")
    while depth < MAX_DEPTH and not deep.isEmpty():
        # Rows that one hash holds above the limit cannot be parted by bits; they are cut into slices below.
        several = pending.groupBy(_prefix(depth).alias("prefix")).agg(F.min("_hash").alias("a"), F.max("_hash").alias("b")).where("a <> b")
        pending = store.cut(pending.join(several, _prefix(depth) == F.col("prefix"), "left_semi"))
        if pending.isEmpty():
            break
        depth += 1
        level = store.cut(sums(depth, pending))
        levels.append(level)
        deep = level.where(F.col("shard_bytes") > limit)
        pending = pending.join(deep.select("prefix"), _prefix(depth) == F.col("prefix"), "left_semi")
    tree = levels[0]
    for level in levels[1:]:
        tree = tree.unionByName(level)
    tree = store.cut(tree)
    split = tree.where(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
    # A bucket is there if its parent is oversized (the root always is), and a leaf if no bucket below it is there.
    there = tree.withColumn("up", F.shiftrightunsigned("prefix", 1)).join(split, ["depth", "up"], "left_semi").unionByName(tree.where("depth = 0").withColumn("up", F.lit(0).cast("long")))
    inner = there.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("up").alias("prefix")).distinct()
    leaves = store.cut(there.join(inner, ["depth", "prefix"], "left_anti").select("prefix", "depth", "shard_bytes"))
    return _assign(rows, leaves, limit, keys)


def _assign(rows: DataFrame, leaves: DataFrame, limit: int, keys: list[str]) -> DataFrame:
    """Each row looks its bucket up in the directory, once for each depth that the directory has."""
    depths = sorted(r["depth"] for r in leaves.select("depth").distinct().collect())
    if not depths:
        return rows.select(*keys, "bytes", F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("slice"), F.col("bytes").alias("shard_bytes"))
    tries = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(d).alias("prefix")) for d in depths])
    directory = leaves.withColumn("oversized", F.col("shard_bytes") > limit)
    placed = rows.withColumn("_t", F.explode(tries)).select(*keys, "bytes", "_hash", "_t.*").join(directory, ["depth", "prefix"])
    placed = placed.withColumn("shard", F.when(F.col("depth") > 0, F.substring(F.lpad(F.bin("_hash"), 64, "0"), F.lit(1), F.col("depth"))).otherwise(""))
    out = [*keys, "bytes", "shard", "depth", "slice", "shard_bytes"]
    usual = placed.where(~F.col("oversized")).withColumn("slice", F.lit(0).cast("long")).select(*out)
    hot = placed.where("oversized")
    if leaves.where(F.col("shard_bytes") > limit).isEmpty():
        return usual
    return usual.unionByName(_slices(hot, limit, keys).select(*out))


def _slices(hot: DataFrame, limit: int, keys: list[str]) -> DataFrame:
    """Oversized buckets of one hash, cut by running bytes.

    Rows of up to half the limit fill slices by where they start, in steps of half the
    limit, so that a slice cannot pass the limit; each larger row is a slice alone.
    The running sums go over parts first, so no bucket meets in one task.
    """
    half = max(1, limit // 2)
    hot = hot.withColumn("_large", F.col("bytes") > half).withColumn("_row", F.monotonically_increasing_id())
    hot = store.cut(hot)
    parts = store.spread(hot, hot.count(), ROWS_PER_PART)
    hot = hot.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(parts)))
    weight = F.when(F.col("_large"), F.lit(half).cast("long")).otherwise(F.col("bytes"))
    group = ["shard", "_large"]
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = hot.groupBy(*group, "_part").agg(F.sum(weight).alias("_b")).select(*group, "_part", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy(*group, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_ahead") + F.coalesce(F.sum(weight).over(within), F.lit(0))
    step = F.floor(start / F.lit(half)).cast("long")
    sliced = hot.join(ahead, [*group, "_part"]).withColumn("slice", F.when(F.col("_large"), 2 * step + 1).otherwise(2 * step))
    size = sliced.groupBy("shard", "slice").agg(F.sum("bytes").alias("_size"))
    sliced = sliced.join(size, ["shard", "slice"]).withColumn("shard_bytes", F.col("_size"))
    return sliced.withColumn("shard", F.concat_ws(".", "shard", F.col("slice").cast("string")))
