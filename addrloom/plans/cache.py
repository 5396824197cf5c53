"""Replies kept by all that they depend on, so that an address is resolved once for each gazetteer.

Replies lie in a folder for each version: a fingerprint of the gazetteer, the table of
places and the mode. A key is a digest of what resolution reads of a request: the
normalized text, the variants of its last segment, whether it names a place, the day,
whether a lookup is wanted, and with a table of places the text that is looked up. So
texts that differ in case, accents or spacing alone share a reply.

A new gazetteer takes over the replies that its changes cannot reach. The cascade finds
a unit only below a unit that it found, by a similarity above the level's threshold or
by an alias. A changed unit can thus matter only to replies whose variants find it and
each of the units above it; ``stale`` says which those are by equi-joins over the
trigrams of the changed units and of those above them. It may name too many replies,
never too few.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from addrloom.functions import dicts
from addrloom.operators import match
from addrloom.operators.stages import cut
from addrloom.plans import resolve as plan

UNIT = ("id", "gso_code", "full_name", "name", "unit_type", "ascii_name", "parent_id", "valid_from", "valid_to")
ALIAS = ("alias", "unit_id", "weight")
PLACE = ("query_key", "address", "display_name", "source")
THRESHOLDS = {"province": min(dicts.ANCHOR_THRESHOLD, dicts.PROVINCE_THRESHOLD), "district": dicts.CHILD_THRESHOLD, "ward": dicts.CHILD_THRESHOLD}


def _digest(rows: DataFrame, columns: tuple[str, ...]) -> str:
    """The same for the same rows in any order; repeated rows count."""
    h = rows.select(F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias("h"))
    n, xor, total = h.agg(F.count("h"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    return f"{n}:{xor}:{total}"


def version(gaz: plan.Gazetteer, poi: DataFrame | None = None, compat: bool = True) -> str:
    """The name of the folder of replies by this gazetteer, these places and this mode."""
    parts = [_digest(gaz.units, UNIT), _digest(gaz.aliases.where("unit_id IS NOT NULL"), ALIAS), "" if poi is None else _digest(poi, PLACE), str(compat)]
    return gaz.units.sparkSession.range(1).select(F.sha2(F.lit("/".join(parts)), 256)).first()[0][:32]


def keyed(addresses: DataFrame, today: date, places: bool = False, compat: bool = True) -> DataFrame:
    """Addresses (addr_id, raw_input, as_of_date, use_geocoder, is_place, place_key) with ``key`` and ``variants``, all of them at every level."""
    day = F.coalesce("as_of_date", F.lit(today).cast("date"))
    rows = plan.prepare(addresses.select("addr_id", "raw_input", "as_of_date", F.coalesce("use_geocoder", F.lit(True)).alias("use_geocoder"), plan.names_place(addresses).alias("is_place"), plan.place_key(addresses).alias("place_key")).withColumn("as_of", day), compat)
    looked_up = F.col("place_key") if places else F.lit(None).cast("string")
    read = F.struct("normalized", "anchor_variants", F.col("is_place").alias("named"), F.col("as_of_date").isNull().alias("either"), "as_of", "use_geocoder", looked_up.alias("looked_up"))
    every = F.array_distinct(F.transform(F.concat("variants", F.coalesce("anchor_variants", F.array().cast("array<string>"))), lambda v: F.lower(F.trim(v))))
    return rows.select("addr_id", "raw_input", "as_of_date", "use_geocoder", "is_place", "place_key", F.sha2(F.to_json(read, {"ignoreNullFields": "false"}), 256).alias("key"), F.coalesce(every, F.array().cast("array<string>")).alias("variants"))


def entries(spark: SparkSession, folder: str) -> DataFrame | None:
    """(key, variants, reply) rows of a version's folder, once each; None if it has none."""
    try:
        return spark.read.parquet(folder).dropDuplicates(["key"])
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def resolve(addresses: DataFrame, gaz: plan.Gazetteer, today: date, folder: str, poi: DataFrame | None = None, compat: bool = True) -> DataFrame:
    """What ``plan.resolve`` gives, with new texts alone resolved; their replies are added below ``folder``.

    Two runs at once may both add a text's reply; one is read. A second place of a
    request is resolved as part of it, so a reply that used the table of places is
    kept whole.
    """
    spark, gaz = addresses.sparkSession, plan.indexed(gaz)
    where = f"{folder}/{version(gaz, poi, compat)}"
    rows = cut(keyed(addresses, today, poi is not None, compat))
    new = rows.groupBy("key").agg(F.min(F.struct("addr_id", "raw_input", "as_of_date", "use_geocoder", "is_place", "place_key", "variants")).alias("one"))
    if (known := entries(spark, where)) is not None:
        new = new.join(known.select("key"), "key", "left_anti")
    new = cut(new)
    if known is None or not new.isEmpty():
        found = plan.resolve(new.select("one.addr_id", "one.raw_input", "one.as_of_date", "one.use_geocoder", "one.is_place", "one.place_key"), gaz, today, poi, compat)
        reply = F.struct(*[c for c in found.columns if c not in ("addr_id", "raw_input")]).alias("reply")
        made = new.select("key", F.col("one.addr_id").alias("addr_id"), F.col("one.variants").alias("variants")).join(found, "addr_id").select("key", "variants", reply)
        made.write.mode("append").parquet(where)
    kept = entries(spark, where)
    return rows.select("addr_id", "raw_input", "key").join(kept.drop("variants"), "key").select("addr_id", "raw_input", "reply.*")


def _chains(ids: DataFrame, units: DataFrame, side: str) -> DataFrame:
    """(change, unit_id, level, name): each changed unit and those above it, as they are on one side."""
    u = units.select(F.col("id").alias("unit_id"), F.col("unit_type").alias("level"), F.col("ascii_name").alias("name"), "parent_id")
    at = ids.select(F.col("id").alias("unit_id")).join(u, "unit_id").withColumn("change", F.concat(F.lit(side), F.col("unit_id").cast("string")))
    steps = [at]
    for _ in range(len(THRESHOLDS) - 1):
        at = at.select("change", F.col("parent_id").alias("unit_id")).join(u, "unit_id").select(*at.columns)
        steps.append(at)
    return reduce(DataFrame.unionByName, steps).select("change", "unit_id", "level", "name")


def changes(old: plan.Gazetteer, new: plan.Gazetteer) -> tuple[DataFrame, DataFrame]:
    """(chains, aliases): the units that differ or have other aliases, each with those above it on either side, and the aliases of both sides."""
    a, b = old.units.select(*UNIT), new.units.select(*UNIT)
    p, q = (g.aliases.where("unit_id IS NOT NULL").select(*ALIAS) for g in (old, new))
    named = p.subtract(q).unionByName(q.subtract(p)).select(F.col("unit_id").alias("id"))
    ids = cut(a.subtract(b).unionByName(b.subtract(a)).select("id").unionByName(named).distinct())
    return cut(_chains(ids, a, "old ").unionByName(_chains(ids, b, "new "))), p.unionByName(q).select("alias", "unit_id").distinct()


def stale(kept: DataFrame, old: plan.Gazetteer, new: plan.Gazetteer) -> DataFrame:
    """(key) of the entries whose reply may be another by the new gazetteer."""
    chains, aliases = changes(old, new)
    chains = chains.withColumn("node", F.xxhash64("unit_id", "level", F.coalesce("name", F.lit(""))))
    nodes = chains.select("node", "unit_id", "level", "name").distinct()
    as_units = nodes.select(F.col("node").alias("id"), F.col("level").alias("unit_type"), F.col("name").alias("ascii_name"), F.lit(None).cast("bigint").alias("parent_id"), F.lit(date(1900, 1, 1)).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    asked = kept.select("key", F.explode("variants").alias("variant"))
    levels = F.explode(F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair]))
    pairs = asked.select("variant").distinct().select("variant", levels.alias("level", "threshold")).select("level", F.lit(match.ROOT).cast("bigint").alias("parent"), "variant", F.lit(date(1900, 1, 1)).alias("as_of"), "threshold")
    least = F.element_at(F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair]), F.col("level"))
    similar = match.scored(pairs, match.index_units(as_units)).where(F.col("sim") > least).select("variant", F.col("unit_id").alias("node"))
    by_alias = aliases.join(nodes.select("unit_id", "node"), "unit_id").select(F.col("alias").alias("variant"), "node")
    hits = asked.join(similar.unionByName(by_alias).distinct(), "variant").select("key", "node").distinct()
    lengths = chains.groupBy("change").agg(F.count_distinct("node").alias("length"))
    met = hits.join(chains.select("change", "node").distinct(), "node").groupBy("key", "change").agg(F.count(F.lit(1)).alias("n"))
    return met.join(lengths, "change").where("n = length").select("key").distinct()


def carry(spark: SparkSession, folder: str, old: plan.Gazetteer, new: plan.Gazetteer, poi: DataFrame | None = None, compat: bool = True) -> None:
    """Copy the old version's replies that the new gazetteer leaves as they are to the new version; those already there stay.

    With a table of places a reply may rest on a place's address, whose variants an
    entry lacks; such replies are not taken over.
    """
    kept = entries(spark, f"{folder}/{version(old, poi, compat)}")
    if kept is None:
        return
    target = f"{folder}/{version(new, poi, compat)}"
    left = kept.join(stale(kept, old, new), "key", "left_anti").where("NOT reply.geocoder_used")
    if (there := entries(spark, target)) is not None:
        left = left.join(there.select("key"), "key", "left_anti")
    left.write.mode("append").parquet(target)
