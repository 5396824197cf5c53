"""Resolving addresses: the cascade through the levels, eras, places of interest, and the public calls."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from addrloom.functions import dicts, scoring, text
from addrloom.operators import match, tables
from addrloom.operators.stages import cut
from addrloom.operators.tables import counts
from addrloom.sources import gazetteer, schemas
from addrloom.sources import landing as landed


@dataclass(frozen=True)
class Gazetteer:
    """Units with ids, the aliases for them, and their trigram index, which is made once if it is not given.

    ``counts`` are rows that a build met, by step, if it was built here.
    """

    units: DataFrame
    aliases: DataFrame
    index: DataFrame | None = None
    counts: dict[str, int] | None = None


def indexed(gaz: Gazetteer) -> Gazetteer:
    return gaz if gaz.index is not None else Gazetteer(gaz.units, gaz.aliases, cut(match.index_units(match.first_units(gaz.units))), gaz.counts)


def build(spark: SparkSession, nested: str, objects: str, aliases_before_merger: bool = False) -> Gazetteer:
    """The gazetteer of both eras from their files.

    ``aliases_before_merger`` derives aliases from the older era alone, as a first
    load in steps would; units of both eras have them otherwise.
    """
    return from_units(gazetteer.scan_nested(spark, nested), gazetteer.scan_objects(spark, objects), aliases_before_merger)


def from_units(old: DataFrame, new: DataFrame, aliases_before_merger: bool = False) -> Gazetteer:
    """The same from the scanned units of either era, each read once; rows are counted as they pass."""
    seen = {name: Observation() for name in ("old", "new", "units", "aliases")}
    passed = lambda df, name: cut(df.observe(seen[name], F.count(F.lit(1)).alias("n")))
    old, new = gazetteer.with_ids(passed(old, "old")), gazetteer.with_ids(passed(new, "new"))
    units = passed(tables.close_out(tables.upsert(old, new)), "units")
    aliases = passed(gazetteer.seed_aliases(units.where("era = 'pre_merger'") if aliases_before_merger else units), "aliases")
    return indexed(Gazetteer(units, aliases, counts={name: o.get["n"] for name, o in seen.items()}))


def save(gaz: Gazetteer, folder: str) -> None:
    """Parquet by era and unit type, written to a new folder: a reader sees the old one or the whole new one."""
    gaz.units.write.partitionBy("era", "unit_type").parquet(f"{folder}/admin_units")
    gaz.aliases.write.parquet(f"{folder}/aliases")
    indexed(gaz).index.write.partitionBy("level").parquet(f"{folder}/trigrams")


def load(spark: SparkSession, folder: str) -> Gazetteer:
    return Gazetteer(*[spark.read.parquet(f"{folder}/{name}") for name in ("admin_units", "aliases", "trigrams")])


def refresh(spark: SparkSession, landing: str, folder: str, url: str | None = None, names: tuple[str, str] = ("nested.json", "objects.json"), force: bool = False, strict: bool = True) -> tuple[Gazetteer, DataFrame]:
    """Land the two files, build the gazetteer of both eras, check it, and save it to a new folder: (gazetteer, checks).

    Without ``url`` the files in ``landing`` are taken as they are. With ``strict`` a check
    that fails is an error, and nothing is saved; there are a few checks.
    """
    if url is not None:
        landed.land_all(url, names, landing, force)
    gaz = build(spark, f"{landing}/{names[0]}", f"{landing}/{names[1]}")
    checks = cut(tables.quality_checks(gaz.units.where("era = 'pre_merger'").withColumn("valid_to", F.lit(None).cast("date")), gaz.aliases))
    failed = [r["check"] for r in checks.where("NOT ok").collect()]
    if failed and strict:
        raise ValueError(f"checks failed: {', '.join(sorted(failed))}")
    save(gaz, folder)
    return gaz, checks


def prepare(addresses: DataFrame, compat: bool = True) -> DataFrame:
    """(addr_id, raw_input, as_of) with era, normalized, house_number, rest, variants, anchor_variants."""
    out = addresses.withColumn("era", scoring.era_of(F.col("as_of"))).withColumn("normalized", text.normalize(F.col("raw_input"), compat))
    number, rest = text.house_number(F.col("normalized")), text.without_house_number(F.col("normalized"))
    if not compat:
        # A number right after the word for a numbered district belongs to it.
        shielded = F.regexp_replace("normalized", r"(?U)\bquan (\d+)\b", "quan_$1")
        hidden = F.regexp_replace(shielded, r"quan_\d+", "quan")
        plain = F.col("normalized") != shielded
        number = F.when(plain, text.house_number(hidden)).otherwise(number)
        rest = F.when(plain & text.house_match(hidden).isNull(), F.col("normalized")).otherwise(rest)
    out = out.withColumn("house_number", number).withColumn("rest", rest).withColumn("variants", text.variants(F.col("rest")))
    parts = F.split("raw_input", ",")
    last = text.normalize(F.trim(F.element_at(parts, -1)), compat)
    return out.withColumn("anchor_variants", F.when((F.size(parts) >= 2) & (last != ""), text.variants(last)))


def _requests(rows: DataFrame, level: Column | str, parent: Column, variants: Column | str, threshold: float) -> DataFrame:
    level = F.lit(level) if isinstance(level, str) else level
    return rows.select("request", level.alias("level"), parent.alias("parent"), "as_of", F.lit(threshold).cast("double").alias("threshold"), (F.col(variants) if isinstance(variants, str) else variants).alias("variants"))


def provinces(prepared: DataFrame, gaz: Gazetteer) -> DataFrame:
    """(addr_id, as_of, p_rank, province, p_score): the sole province of a trusted last segment, else the best three."""
    rows = prepared.withColumn("request", F.struct("addr_id", "as_of"))
    none = F.lit(None).cast("bigint")
    anchors = match.best_match(_requests(rows.where(F.col("anchor_variants").isNotNull()), "province", none, "anchor_variants", dicts.ANCHOR_THRESHOLD), gaz.units, gaz.aliases, 1, gaz.index)
    anchors = cut(anchors.where(F.col("score") >= dicts.ANCHOR_ACCEPT))
    rest = rows.join(anchors.select("request"), "request", "left_anti")
    others = match.best_match(_requests(rest, "province", none, "variants", dicts.PROVINCE_THRESHOLD), gaz.units, gaz.aliases, dicts.FAN_OUT, gaz.index)
    return anchors.unionByName(others).select("request.addr_id", "request.as_of", F.col("rank").alias("p_rank"), F.col("unit").alias("province"), F.col("score").alias("p_score"))


def candidates(prepared: DataFrame, gaz: Gazetteer) -> DataFrame:
    """(addr_id, as_of, place, province, p_score, district, d_score, ward, w_score, score) before ranks.

    ``place`` orders candidates of one score as the cascade would find them.
    """
    key = ["addr_id", "as_of"]
    base = prepared.select(*key, "era", "variants")
    top = provinces(prepared, gaz).join(base, key).withColumn("variants", text.without_parent(F.col("variants"), F.col("province.ascii_name")))
    top = cut(top.withColumn("request", F.struct(*key, "p_rank")))
    post = F.col("era") == "post_merger"
    below = _requests(top, F.when(post, "ward").otherwise("district"), F.col("province.id"), "variants", dicts.CHILD_THRESHOLD)
    found = cut(match.best_match(below, gaz.units, gaz.aliases, dicts.FAN_OUT, gaz.index).select("request", F.col("rank").alias("c_rank"), F.col("unit").alias("child"), F.col("score").alias("c_score")))
    unit, none, number = found.schema["child"].dataType, lambda t: F.lit(None).cast(t), F.lit(None).cast("double")
    joined = top.join(found, "request", "left")
    shape = lambda df, second, d, ds, w, ws, d_rank, w_rank: df.select(*key, "era", F.struct(F.col("p_rank"), F.lit(second).alias("second"), d_rank.alias("d"), w_rank.alias("w")).alias("place"), "province", "p_score", d.alias("district"), ds.alias("d_score"), w.alias("ward"), ws.alias("w_score"))
    zero, child, c_score, c_rank = F.lit(0), F.col("child"), F.col("c_score"), F.coalesce("c_rank", F.lit(0))
    wards = shape(joined.where(post), 0, none(unit), number, child, c_score, zero, c_rank)
    bare = shape(top.where(post).join(found.select("request").distinct(), "request", "left_semi"), 1, none(unit), number, none(unit), number, zero, zero)
    no_district = shape(joined.where(~post & child.isNull()), 0, none(unit), number, none(unit), number, zero, zero)
    districts = joined.where(~post & child.isNotNull())
    deeper = districts.withColumn("variants", text.without_parent(F.col("variants"), F.col("child.ascii_name"))).withColumn("request", F.struct(*key, "p_rank", "c_rank"))
    last = match.best_match(_requests(deeper, "ward", F.col("child.id"), "variants", dicts.CHILD_THRESHOLD), gaz.units, gaz.aliases, dicts.FAN_OUT, gaz.index).select("request", F.col("rank").alias("w_rank"), F.col("unit").alias("ward"), F.col("score").alias("w_score"))
    full = shape(deeper.join(last, "request", "left"), 0, child, c_score, F.col("ward"), F.col("w_score"), c_rank, F.coalesce("w_rank", F.lit(0)))
    best = shape(districts.where("c_rank = 1"), 1, child, c_score, none(unit), number, zero, zero)
    every = wards.unionByName(bare).unionByName(no_district).unionByName(full).unionByName(best)
    return every.withColumn("score", scoring.candidate_score(F.col("p_score"), F.col("d_score"), F.col("w_score")))


def ranked(found: DataFrame) -> DataFrame:
    """The five best distinct candidates of each address and date, with rank and the next one's score."""
    key = ["addr_id", "as_of"]
    order = [F.desc("score"), "place"]
    same = Window.partitionBy(*key, F.col("province.id"), F.col("district.id"), F.col("ward.id")).orderBy(*order)
    once = found.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    best = Window.partitionBy(*key).orderBy(*order)
    return once.withColumn("rank", F.row_number().over(best)).withColumn("runner_up", F.lead("score").over(best)).where(F.col("rank") <= dicts.KEPT)


def _unit_out(unit: str, score: str) -> Column:
    u = F.col(unit)
    return F.when(u.isNotNull(), F.struct(*[u[c].alias(c) for c in ("id", "gso_code", "full_name", "name", "unit_type", "ascii_name")], F.bround(score, 4).alias("score")))


def resolve_at(addresses: DataFrame, gaz: Gazetteer, compat: bool = True) -> DataFrame:
    """One row for each (addr_id, raw_input, as_of): the best candidates in the era of the date, confidence, house number, street."""
    prepared = cut(prepare(addresses, compat))
    rows = ranked(candidates(prepared, indexed(gaz)))
    reasons = F.array_compact(F.array(*[scoring.reason(level, F.col(f"{level}.name"), F.col(s)) for level, s in (("province", "p_score"), ("district", "d_score"), ("ward", "w_score"))]))
    one = F.struct("rank", F.col("score").alias("score"), reasons.alias("reasons"), _unit_out("province", "p_score").alias("province"), _unit_out("district", "d_score").alias("district"), _unit_out("ward", "w_score").alias("ward"))
    depth = scoring.depth(F.col("province"), F.col("district"), F.col("ward"))
    rows = rows.withColumn("confidence", F.when(F.col("rank") == 1, scoring.confidence(F.col("score"), F.col("runner_up"), depth, F.col("era"))))
    per = rows.groupBy("addr_id", "as_of").agg(F.array_sort(F.collect_list(one)).alias("candidates"), F.max("confidence").alias("confidence"))
    out = prepared.join(per, ["addr_id", "as_of"], "left")
    top = F.element_at(F.when(F.size("candidates") > 0, F.col("candidates")), 1)
    out = out.withColumn("top", top.dropFields("rank")).withColumn("candidates", F.transform(F.coalesce("candidates", F.array().cast(per.schema["candidates"].dataType)), lambda c: c.dropFields("rank")))
    names = F.array(*[F.col(f"top.{level}.ascii_name") for level in ("province", "district", "ward")])
    street = F.when(F.col("top").isNotNull(), text.street(F.col("rest"), names))
    confidence = F.coalesce("confidence", F.lit(0.0))
    return out.select("addr_id", "as_of", "raw_input", "normalized", "era", confidence.alias("confidence"), scoring.action(confidence).alias("action"), "house_number", street.alias("street_raw"), "top", "candidates")


def best_era(addresses: DataFrame, gaz: Gazetteer, today: date, compat: bool = True) -> DataFrame:
    """(addr_id, raw_input, as_of_date): at the date if given; else today's era, unless the last day before the merger is clearly better."""
    dates = F.when(F.col("as_of_date").isNotNull(), F.array("as_of_date")).otherwise(F.array(F.lit(today).cast("date"), F.lit(dicts.PRE_MERGER_LAST)))
    rows = resolve_at(addresses.select("addr_id", "raw_input", F.explode(dates).alias("as_of")), gaz, compat)
    return pick_era(rows, today)


def pick_era(rows: DataFrame, today: date) -> DataFrame:
    """Of an address's two results, the older era's only if its confidence is more than the margin above."""
    value = F.col("confidence") - F.when(F.col("as_of") < F.lit(today).cast("date"), F.lit(dicts.ERA_MARGIN)).otherwise(0.0)
    order = Window.partitionBy("addr_id").orderBy(F.desc(F.bround(value, 6)), F.desc("as_of"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def best_poi(poi: DataFrame) -> DataFrame:
    """One place for each key: the source that is asked first has it, then the first by address."""
    order = Window.partitionBy("query_key").orderBy(F.when(F.col("source") == "gemini", 0).otherwise(1), "address")
    return poi.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("query_key", "address", "display_name", "source")


def names_place(addresses: DataFrame) -> Column:
    """Whether an address names a place: by its column ``is_place``, where there is one and it is known, else by the text."""
    told = text.is_place_name(F.col("raw_input"))
    return F.coalesce("is_place", told) if "is_place" in addresses.columns else told


def place_key(addresses: DataFrame) -> Column:
    """The key under which an address is looked up: its column ``place_key``, where there is one and it is known, else the text."""
    key = F.lower(F.trim("raw_input"))
    return F.coalesce("place_key", key) if "place_key" in addresses.columns else key


def resolve(addresses: DataFrame, gaz: Gazetteer, today: date, poi: DataFrame | None = None, compat: bool = True) -> DataFrame:
    """One row for each address (addr_id, raw_input, as_of_date, use_geocoder); addr_id is its key.

    Places by name and results below a confidence are looked up in ``poi``, a table
    (query_key, address, display_name, source) in place of a geocoder. The place's
    address is resolved too, and wins if it is clearly better or the text names a
    place. Without a table nothing is looked up. Addresses may say themselves whether
    they name a place (``is_place``), and under which key one is on file (``place_key``):
    two customers may write the same text and mean different places.
    """
    gaz = indexed(gaz)
    first = cut(best_era(addresses, gaz, today, compat))
    empty = [F.lit(None).cast("string").alias(c) for c in ("geocoder_source", "geocoder_address")]
    echo = addresses.select("addr_id", F.date_format(F.coalesce("as_of_date", F.lit(today).cast("date")), "yyyy-MM-dd").alias("as_of_date"))
    if poi is None:
        return first.drop("as_of").select("*", F.lit(False).alias("geocoder_used"), *empty).join(echo, "addr_id")
    flags = addresses.select("addr_id", "as_of_date", F.coalesce("use_geocoder", F.lit(True)).alias("_use"), names_place(addresses).alias("_named"), place_key(addresses).alias("_key"))
    rows = first.drop("as_of").join(flags, "addr_id")
    ask = F.col("_use") & (F.col("_named") | (F.col("confidence") < dicts.GEOCODER_BELOW))
    places = best_poi(poi).withColumnRenamed("address", "_address")
    asked = rows.where(ask).select("addr_id", "as_of_date", F.col("_key").alias("query_key")).join(places, "query_key")
    second = best_era(asked.select("addr_id", F.col("_address").alias("raw_input"), "as_of_date"), gaz, today, compat).drop("as_of")
    again = second.select("addr_id", F.struct(*[c for c in second.columns if c != "addr_id"]).alias("_new")).join(asked.select("addr_id", F.col("source").alias("_source"), F.col("display_name").alias("_shown")), "addr_id")
    both = rows.join(again, "addr_id", "left")
    wins = F.col("_new").isNotNull() & (F.col("_named") | (F.col("_new.confidence") > F.col("confidence") + dicts.ERA_MARGIN))
    kept = [F.when(wins, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in first.columns if c not in ("addr_id", "as_of")]
    return both.select("addr_id", *kept, F.col("_source").isNotNull().alias("geocoder_used"), F.col("_source").alias("geocoder_source"), F.col("_shown").alias("geocoder_address")).join(echo, "addr_id")


# --- the public calls


def request_errors(addresses: DataFrame) -> DataFrame:
    """(addr_id, error) of texts that are blank and dates that are no dates, for string columns address and as_of_date."""
    blank = F.col("address").isNull() | (F.trim("address") == "")
    bad = F.col("as_of_date").isNotNull() & F.try_to_date("as_of_date", "yyyy-MM-dd").isNull()
    return addresses.select("addr_id", F.when(blank, "address must not be empty").when(bad, "as_of_date must be an ISO date").alias("error")).where("error IS NOT NULL")


def resolve_one(spark: SparkSession, address: str, gaz: Gazetteer, today: date, as_of_date: str | None = None, use_geocoder: bool = True, poi: DataFrame | None = None) -> DataFrame:
    """A single address; a blank one or a bad date is a ValueError."""
    if not address.strip():
        raise ValueError("address must not be empty")
    day = date.fromisoformat(as_of_date) if as_of_date else None
    return resolve(spark.createDataFrame([(0, address, day, use_geocoder)], schemas.ADDRESSES), gaz, today, poi)


def search(spark: SparkSession, q: str, gaz: Gazetteer, today: date, unit_type: str = "province", limit: int = 10, by_sound: bool = False) -> DataFrame:
    """Units of a type whose names are like ``q``, best first; shorthand is not expanded here. ``by_sound`` finds names that sound like it too."""
    if not q:
        raise ValueError("q must not be empty")
    if unit_type not in schemas.UNIT_TYPES:
        raise ValueError(f"type must be one of {schemas.UNIT_TYPES}")
    if not 1 <= limit <= 30:
        raise ValueError("limit must lie between 1 and 30")
    asked = spark.createDataFrame([(0, q, today)], "query_id bigint, q string, as_of date")
    return search_many(asked, gaz, unit_type, limit, by_sound).drop("query_id").orderBy("rank")


def search_many(asked: DataFrame, gaz: Gazetteer, unit_type: str, limit: int, by_sound: bool = False) -> DataFrame:
    """(query_id, rank, unit fields, score) for (query_id, q, as_of)."""
    rows = asked.select(F.col("query_id").alias("request"), "as_of", F.array(text.to_ascii(F.col("q"))).alias("variants"))
    units = gaz.units.where(F.col("unit_type") == unit_type)
    sounds = match.index_sounds(units, below_root=True) if by_sound else None
    hits = match.best_match(_requests(rows, unit_type, F.lit(None).cast("bigint"), "variants", dicts.SEARCH_THRESHOLD), gaz.units, gaz.aliases, limit, match.search_index(units), sounds, below_root=True)
    return hits.select(F.col("request").alias("query_id"), "rank", *[F.col(f"unit.{c}").alias(c) for c in ("id", "gso_code", "full_name", "name", "unit_type", "ascii_name")], F.bround("score", 4).alias("score"))


def health(gaz: Gazetteer, today: date) -> DataFrame:
    """(era, n, active): units of each era, and whether it is the era of ``today``."""
    return counts(gaz.units, "era").withColumn("active", F.col("era") == scoring.era_of(F.lit(today).cast("date")))


def to_json(results: DataFrame) -> DataFrame:
    """(addr_id, response): each result as the JSON object of a reply."""
    return results.select("addr_id", F.to_json(F.struct(*[c for c in results.columns if c != "addr_id"]), {"ignoreNullFields": "false"}).alias("response"))
