"""Table operators: temporal validity, upserts, close-out, hierarchy links, quality checks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from addrloom.functions import dicts


def valid_at(as_of: Column, valid_from: Column | None = None, valid_to: Column | None = None) -> Column:
    """Both ends belong to the interval; no last day means that it is open."""
    start, end = F.col("valid_from") if valid_from is None else valid_from, F.col("valid_to") if valid_to is None else valid_to
    return (start <= as_of) & (end.isNull() | (end >= as_of))


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("gso_code", "valid_from"), keep: tuple[str, ...] = ("valid_to",)) -> DataFrame:
    """``new`` rows in place of ``old`` ones with their keys; columns in ``keep`` stay as they were.

    Keys that ``new`` repeats are an error at the sink of a database; here one of the rows stays.
    """
    new = new.dropDuplicates(list(keys))
    before = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in keep], F.lit(True).alias("_was"))
    merged = new.join(before, list(keys), "left")
    for c in keep:
        merged = merged.withColumn(c, F.when(F.col("_was"), F.col(f"_{c}")).otherwise(F.col(c)))
    return old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(merged.select(*old.columns))


def close_out(units: DataFrame, era: str = "pre_merger", last: date = dicts.PRE_MERGER_LAST) -> DataFrame:
    """Open rows of ``era`` end on ``last``."""
    return units.withColumn("valid_to", F.when(F.col("era") == era, F.coalesce("valid_to", F.lit(last))).otherwise(F.col("valid_to")))


def backfill_era(units: DataFrame, era: str = "pre_merger") -> DataFrame:
    """``era`` wherever the row has another one or none."""
    return units.withColumn("era", F.when(~F.col("era").eqNullSafe(F.lit(era)), F.lit(era)).otherwise(F.col("era")))


def resolve_parents(units: DataFrame, links: DataFrame) -> DataFrame:
    """``units`` with parent_id by (gso_code, parent_gso_code, era) links; only rows whose parent changes do.

    Codes are looked up within an era, as they are given anew in each.
    """
    ids = units.select(F.col("gso_code").alias("parent_gso_code"), "era", F.col("id").alias("_parent"))
    found = links.join(ids, ["parent_gso_code", "era"]).select("gso_code", "era", "_parent")
    joined = units.join(found, ["gso_code", "era"], "left")
    changed = F.col("_parent").isNotNull() & ~F.col("parent_id").eqNullSafe(F.col("_parent"))
    return joined.withColumn("parent_id", F.when(changed, F.col("_parent")).otherwise(F.col("parent_id"))).select(*units.columns)


def counts(units: DataFrame, *by: str) -> DataFrame:
    return units.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).orderBy(*by)


def open_rows(units: DataFrame) -> DataFrame:
    return units.where(F.col("valid_to").isNull())


def orphans(units: DataFrame) -> DataFrame:
    """Units below a province without a parent."""
    return units.where((F.col("unit_type") != "province") & F.col("parent_id").isNull())


def broken_links(units: DataFrame) -> DataFrame:
    """Units whose parent is not in the table."""
    return units.where(F.col("parent_id").isNotNull()).join(units.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select(*units.columns)


def quality_checks(units: DataFrame, aliases: DataFrame, ranges: dict[str, tuple[int, int]] = dicts.COUNT_RANGES, least: int = dicts.MIN_PROVINCE_ALIASES) -> DataFrame:
    """(check, value, low, high, ok): counts of the open units by type, orphans among them, aliases of provinces."""
    spark = units.sparkSession
    bounds = [(f"count_{k}", lo, hi) for k, (lo, hi) in ranges.items()] + [("orphans", 0, 0), ("province_aliases", least, None)]
    wanted = spark.createDataFrame(bounds, "check string, low bigint, high bigint")
    live = open_rows(units)
    found = live.groupBy(F.concat(F.lit("count_"), "unit_type").alias("check")).agg(F.count(F.lit(1)).alias("value"))
    found = found.unionByName(orphans(live).agg(F.count(F.lit(1)).alias("value")).select(F.lit("orphans").alias("check"), "value"))
    found = found.unionByName(aliases.where("alias_type = 'province'").agg(F.count(F.lit(1)).alias("value")).select(F.lit("province_aliases").alias("check"), "value"))
    value = F.coalesce("value", F.lit(0))
    return wanted.join(found, "check", "left").select("check", value.alias("value"), "low", "high", ((value >= F.col("low")) & (F.col("high").isNull() | (value <= F.col("high")))).alias("ok"))


def spot_check(units: DataFrame, name: str = "Ho Chi Minh") -> DataFrame:
    """The first province whose plain name contains ``name``."""
    return units.where(F.col("ascii_name").contains(name) & (F.col("unit_type") == "province")).orderBy("gso_code").limit(1)


def through_mergers(units: DataFrame, mergers: DataFrame) -> DataFrame:
    """(old unit, new unit, effective_date, decree_ref) of each merger."""
    side = lambda p: units.select(F.col("id").alias(f"{p}_unit_id"), F.col("full_name").alias(f"{p}_full_name"), F.col("gso_code").alias(f"{p}_gso_code"))
    return mergers.join(side("old"), "old_unit_id").join(side("new"), "new_unit_id")


def with_places(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Streets or postal codes with the names of their ward, district and province."""
    for level in ("ward", "district", "province"):
        names = units.where(F.col("unit_type") == level).select(F.col("id").alias(f"{level}_id"), F.col("full_name").alias(f"{level}_name"))
        rows = rows.join(names, f"{level}_id", "left")
    return rows


def repair_tokens(rows: DataFrame, confusions: DataFrame, column: str) -> DataFrame:
    """``column`` with its misread tokens put right: a token's most frequent correction, the first by letter on ties.

    Each distinct text, known by its MD5, is taken apart into (text, place, token), so
    corrections are joined by token whatever the size of their table. A null text stays null.
    """
    best = confusions.groupBy("wrong_token").agg(F.min(F.struct((-F.col("frequency")).alias("f"), "corrected_token"))["corrected_token"].alias("right"))
    known = F.md5(F.col(column).cast("binary"))
    spread = rows.where(F.col(column).isNotNull()).select(known.alias("_text"), column).distinct().select("_text", F.posexplode(F.split(column, " ")).alias("_at", "wrong_token"))
    fixed = spread.join(best, "wrong_token", "left").groupBy("_text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("right", "wrong_token").alias("t")))), lambda x: x["t"]), " ").alias("_fixed"))
    return rows.withColumn("_text", known).join(fixed, "_text", "left").withColumn(column, F.col("_fixed")).select(*rows.columns)
