"""Mixing sources to target weights along a curriculum, with DataFrame operations alone.

Each source has a weight schedule, linear between knots over training time 0 to
1. The integral of its schedule is its share of the mix; a share above
``max_epochs`` times the source's size stops there and the excess goes to the
others by weight. A source's cumulative demand at time t is the integral of its
schedule up to t, scaled to its target. A document covers an interval of its
source's cumulative words, and its training position is the time at which the
demand reaches the middle of that interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that are numbered together, and how many times fewer if they carry their texts along.
ROWS_PER_BUCKET, CARRIED = 20_000, 5
#: With the schedule of the contract: weights of the sources in turn, and how far a schedule swings around its weight.
TURNS = (1.0, 2.0, 3.0)
SWING = 0.5


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def by_code_point(column: str) -> list[Column]:
    """Sort by code point (the order of UTF-8 bytes), null last."""
    return [F.col(column).isNull().asc(), F.col(column).cast("binary").asc()]


def turn_schedule(sources: DataFrame) -> DataFrame:
    """(source, t0, t1, w0, w1): sources in code point order weigh 1, 2, 3 in turn; one falls over time while the next rises."""
    order = sources.withColumn("_n", F.row_number().over(Window.orderBy(*by_code_point("source"))) - 1)
    weight = F.element_at(F.array(*map(F.lit, TURNS)), (F.col("_n") % len(TURNS) + 1).cast("int"))
    slope = F.when(F.col("_n") % 2 == 0, F.lit(SWING)).otherwise(F.lit(-SWING))
    return order.select("source", F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"), (weight * (1 + slope)).alias("w0"), (weight * (1 - slope)).alias("w1"))


def targets(sizes: DataFrame, schedule: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """(source, source_size, target, pieces) for (source, source_size).

    The targets are min(max_epochs * size, level * weight) with the one level at
    which they sum to all sizes: sources are taken in the order in which they
    stop, and the level is that of the first stretch that holds it. A source
    without a schedule weighs nothing. One row per source is sorted here, not the
    documents.
    """
    piece = F.struct("t0", "t1", "w0", "w1", ((F.col("w0") + F.col("w1")) / 2 * (F.col("t1") - F.col("t0"))).alias("area"))
    weights = schedule.groupBy("source").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    weights = weights.withColumn("weight", F.aggregate("pieces", F.lit(0.0), lambda a, p: a + p["area"]))
    rows = sizes.join(weights, sizes["source"].eqNullSafe(weights["source"]), "left").select(sizes["source"], "source_size", "pieces", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    rows = rows.withColumn("cap", max_epochs * F.col("source_size")).withColumn("stop", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")))
    order = Window.orderBy(F.col("stop").asc_nulls_last(), *by_code_point("source"))
    upto, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("total", F.sum("source_size").over(everything)).withColumn("used", F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("cap"))).over(upto), F.lit(0.0)))
    rows = rows.withColumn("rest", F.sum("weight").over(ahead)).withColumn("level", F.when(F.col("weight") > 0, (F.col("total") - F.col("used")) / F.col("rest")))
    # From the first source that doesn't stop below the level, the level holds for all that follow.
    rows = rows.withColumn("_n", F.row_number().over(order))
    rows = rows.withColumn("level", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("_n", "level"))).over(everything)["level"])
    target = F.when(F.col("weight") > 0, F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))).otherwise(F.lit(0.0))
    return rows.select("source", "source_size", target.alias("target"), "pieces", "weight")


def position(demand: Column, target: Column, pieces: Column, weight: Column) -> Column:
    """The time at which a source's cumulative demand reaches ``demand``."""
    want = demand / target * weight
    start = F.struct(F.lit(0.0).alias("done"), F.lit(None).cast("double").alias("at"))

    def step(a: Column, p: Column) -> Column:
        need, span = want - a["done"], p["t1"] - p["t0"]
        slope = (p["w1"] - p["w0"]) / span
        # Of slope / 2 * x^2 + w0 * x = need, in the form that also holds for a slope of 0.
        x = 2 * need / (p["w0"] + F.sqrt(F.greatest(p["w0"] * p["w0"] + 2 * slope * need, F.lit(0.0))))
        here = a["at"].isNull() & (need <= p["area"]) & (p["area"] > 0)
        return F.struct((a["done"] + p["area"]).alias("done"), F.when(here, p["t0"] + F.least(span, F.coalesce(x, F.lit(0.0)))).otherwise(a["at"]).alias("at"))

    return F.when(target > 0, F.coalesce(F.aggregate(pieces, start, step)["at"], F.lit(1.0)))


def mix(docs: DataFrame, schedule: DataFrame | None = None, max_epochs: float = 3.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: source, doc_id, size, source_size, target, taken, position, and ``carried``, a struct of the columns in ``carry``.

    Documents stand in an order drawn from a hash of doc_id and source, the same
    on every run. A source takes whole passes over its documents, then the words
    up to its target from the first documents in that order; the last of them is
    cut. ``position`` is where the document's last, cut or only, copy begins its
    place in training; null if it takes no word. Null texts have no words; null
    sources are one source; repeated rows are documents of their own, and rows that
    differ in what they carry alone follow a hash of that. An empty table gives no
    rows; columns that are not named here are not read.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []))
    rows = rows.withColumn("_order", F.shiftrightunsigned(F.xxhash64(F.lit(7), "doc_id", "source", "size"), 1)).withColumn("_tie", F.xxhash64(*[F.col("carried").getField(c) for c in carry if "map<" not in dict(docs.dtypes)[c]], F.lit(0)) if carry else F.lit(0).cast("long"))
    rows = store.table(rows, "mix") if carry else store.cut(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    sizes = store.cut(sizes)
    schedule = turn_schedule(sizes.select("source")) if schedule is None else schedule
    goal = targets(sizes.select("source", "source_size"), schedule, max_epochs)
    count = sizes.agg(F.sum("_n").alias("n")).first()["n"] or 0
    buckets = max(1, -(-count // (ROWS_PER_BUCKET // CARRIED if carry else ROWS_PER_BUCKET)))
    # A source may hold any share of the rows: it is dealt to buckets by the order's leading bits.
    rows = rows.withColumn("_bucket", F.shiftright(F.shiftright("_order", 32) * F.lit(buckets), 31)).withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    before = Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("_key", "_bucket").agg(F.sum("size").alias("_s")).select("_key", "_bucket", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_ahead"))
    goal = goal.withColumn("_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    ahead = ahead.join(goal, "_key")
    within = Window.partitionBy("_key", "_bucket").orderBy("_order", "doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.coalesce(F.sum("size").over(within), F.lit(0))).join(ahead, ["_key", "_bucket"])
    start = F.col("_ahead") + F.col("_own")
    words = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    part = F.greatest(F.lit(0), F.least("size", words - passes * F.col("source_size") - start))
    out = rows.withColumn("_passes", passes).withColumn("_start", start).withColumn("_part", part).withColumn("taken", F.col("_passes") * F.col("size") + F.col("_part"))
    last = F.when(F.col("_part") > 0, F.col("_passes")).otherwise(F.col("_passes") - 1)
    middle = last * F.col("source_size") + F.col("_start") + F.when(F.col("_part") > 0, F.col("_part")).otherwise(F.col("size")) / 2
    out = out.withColumn("position", F.when(F.col("taken") > 0, position(middle, F.col("target"), F.col("pieces"), F.col("weight"))))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "position", *(["carried"] if carry else []), "_passes", "_part", "_start", "pieces", "weight")


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy, range-sorted by training position: (doc_id, source, copy, words, position).

    A document of which whole passes are taken has a copy in each, at the
    positions where the source's demand reaches it.
    """
    copies = mixed.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_passes") + F.when(F.col("_part") > 0, 0).otherwise(-1))))
    words = F.when(F.col("copy") < F.col("_passes"), F.col("size")).otherwise(F.col("_part"))
    at = position(F.col("copy") * F.col("source_size") + F.col("_start") + words / 2, F.col("target"), F.col("pieces"), F.col("weight"))
    return copies.withColumn("words", words).where("words > 0").withColumn("position", at).drop("_passes", "_part", "_start", "pieces", "weight").orderBy("position", "doc_id", "copy")


def first_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), n.cast("int")), "")
