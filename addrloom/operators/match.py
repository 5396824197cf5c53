"""Fuzzy matching of text variants against units, as equi-joins.

Many addresses ask for the same variant below the same parent, so each distinct
(parent, variant, day) is scored once: its trigrams meet an inverted index of the
units on (parent, trigram), those not valid on the day drop out, and shared
trigrams are counted. Similarities of pairs without a shared trigram are 0, below
every threshold in use. Addresses then look their variants' hits up.

Many units may have one name too. Those with the same name, level, parent and validity
are alike for every variant, so the first of them (by id) stands for all in an index,
and of the best names for a variant the first few units are read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from addrloom.functions import phonetic, text
from addrloom.operators import blocks, simjoin
from addrloom.operators.stages import cut
from addrloom.operators.tables import valid_at

UNIT_FIELDS = ("id", "gso_code", "full_name", "name", "unit_type", "ascii_name", "parent_id")
#: Stands for "no parent" in joins.
ROOT = -1


def index_units(units: DataFrame, below_root: bool = False) -> DataFrame:
    """(level, parent, g, unit_id, n, valid_from, valid_to): a row for each trigram of each unit's plain name.

    Units stand below their parent, those without one below ROOT; with ``below_root``
    all stand there, where a search without a parent looks.
    """
    t = text.trigrams(F.col("ascii_name"))
    parent = F.lit(ROOT).cast("bigint") if below_root else F.coalesce("parent_id", F.lit(ROOT))
    rows = units.where(F.col("ascii_name").isNotNull()).select(F.col("id").alias("unit_id"), F.col("unit_type").alias("level"), parent.alias("parent"), "valid_from", "valid_to", t.alias("t"), F.size(t).alias("n"))
    return rows.select("level", "parent", F.explode("t").alias("g"), "unit_id", "n", "valid_from", "valid_to")


def _name_key(units: DataFrame, below_root: bool) -> list[Column]:
    parent = F.lit(ROOT).cast("bigint") if below_root else F.coalesce("parent_id", F.lit(ROOT))
    return [F.col("unit_type"), parent, F.col("ascii_name"), F.col("valid_from"), F.col("valid_to")]


def first_units(units: DataFrame, below_root: bool = False) -> DataFrame:
    """Of the units that have one name, level, parent and validity the one with the smallest id, with the columns that an index reads."""
    key = _name_key(units, below_root)
    names = ["unit_type", "_parent", "ascii_name", "valid_from", "valid_to"]
    rows = units.where(F.col("ascii_name").isNotNull()).select("id", *[c.alias(n) for c, n in zip(key, names)])
    return rows.groupBy(*names).agg(F.min("id").alias("id")).withColumn("parent_id", F.nullif("_parent", F.lit(ROOT).cast("bigint"))).drop("_parent")


def namesakes(units: DataFrame, top: int, below_root: bool = False) -> DataFrame:
    """(first, unit_id): the first unit of each name with the ``top`` first ones, itself included."""
    order = Window.partitionBy(*_name_key(units, below_root)).orderBy("id")
    few = units.where(F.col("ascii_name").isNotNull()).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top)
    return few.select(F.min("id").over(order).alias("first"), F.col("id").alias("unit_id"))


def scored(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """(level, parent, variant, as_of, unit_id, sim float) for (level, parent, variant, as_of, threshold) rows.

    Only units valid on the day, and only such sizes as can pass the least threshold
    asked for: the similarity is at most the smaller trigram set over the larger.
    """
    key = ["level", "parent", "variant", "as_of"]
    distinct = pairs.groupBy(*key).agg(F.min("threshold").alias("least")).withColumn("t", text.trigrams(F.col("variant")))
    asked = distinct.select(*key, "least", F.size("t").alias("m"), F.explode("t").alias("g"))
    # A little less than the threshold, as similarities are compared as 4-byte floats.
    sizes = F.least("m", "n") >= F.col("least") * F.greatest("m", "n") * (1 - 1e-6)
    return _shared(asked.join(index, ["level", "parent", "g"]).where(valid_at(F.col("as_of")) & sizes), key)


def _shared(met: DataFrame, key: list[str]) -> DataFrame:
    shared = met.groupBy(*key, "unit_id", "m", "n").agg(F.count(F.lit(1)).alias("c"))
    return shared.select(*key, "unit_id", text.overlap(F.col("c"), F.col("m"), F.col("n")).alias("sim"))


def similar(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """(level, parent, variant, unit_id, sim float) for (level, parent, variant) rows: every unit of any day with a trigram in common."""
    key = ["level", "parent", "variant"]
    distinct = pairs.select(*key).distinct().withColumn("t", text.trigrams(F.col("variant")))
    index = index_units(units).unionByName(index_units(units.where("parent_id IS NOT NULL"), below_root=True))
    return _shared(distinct.select(*key, F.size("t").alias("m"), F.explode("t").alias("g")).join(index, ["level", "parent", "g"]), key)


@dataclass(frozen=True)
class PrefixIndex:
    """Postings of units below their parents by the rarity of their trigrams, and the trigrams' frequencies."""

    postings: DataFrame
    freq: DataFrame
    sizes: list[int]


def prefix_index(units: DataFrame, below_root: bool = False) -> PrefixIndex:
    """The same units as in ``index_units``, for searches of the best few among many."""
    parent = F.lit(ROOT).cast("bigint") if below_root else F.coalesce("parent_id", F.lit(ROOT))
    rows = units.where(F.col("ascii_name").isNotNull()).select(F.col("id").alias("unit_id"), F.col("unit_type").alias("level"), parent.alias("parent"), "valid_from", "valid_to", "ascii_name")
    freq = simjoin.frequencies(rows, "ascii_name")
    index = cut(simjoin.postings(rows, ["level", "parent", "unit_id", "valid_from", "valid_to"], "ascii_name", freq))
    return PrefixIndex(index, freq, simjoin.set_sizes(index))


@dataclass(frozen=True)
class NameIndex:
    """Names of units below their parents, to be compared with all variants of the parent in blocks."""

    names: DataFrame


def name_index(units: DataFrame, below_root: bool = False) -> NameIndex:
    """The same units as in ``index_units``, for many variants below few parents, whose names have trigrams in common."""
    parent = F.lit(ROOT).cast("bigint") if below_root else F.coalesce("parent_id", F.lit(ROOT))
    return NameIndex(units.where(F.col("ascii_name").isNotNull()).select(F.col("unit_type").alias("level"), parent.alias("parent"), F.col("id").alias("unit_id"), "ascii_name", "valid_from", "valid_to"))


@dataclass(frozen=True)
class AlikeIndex:
    """Names of units below their parents, of which the best for a variant mostly are very much like it."""

    names: DataFrame


def alike_index(units: DataFrame, below_root: bool = False) -> AlikeIndex:
    """The same units as in ``index_units``, for as many variants as names below a parent."""
    return AlikeIndex(name_index(units, below_root).names)


#: Similarities at which names are looked for in turn, until a variant has enough of them.
STEPS = (0.55, 0.4)


def scored_alike(pairs: DataFrame, index: AlikeIndex, top: int) -> DataFrame:
    """The ``top`` best hits that ``scored`` gives for each variant, by similarity and id.

    All names as similar as a step are found at it; who has ``top`` of them has its best.
    """
    key = ["level", "parent", "variant", "as_of"]
    rows = cut(pairs.where(F.col("variant").isNotNull() & F.col("as_of").isNotNull()).groupBy(*key).agg(F.min("threshold").alias("least")))
    last = max(rows.agg(F.min("least")).first()[0] or 0.0, 1e-9)
    found = None
    for step in (*[x for x in STEPS if x > last], last):
        met = simjoin.alike(rows.select("level", "parent", F.col("variant").alias("_left")), index.names.select("level", "parent", F.col("ascii_name").alias("_right")), ["level", "parent"], step)
        met = met.where(F.col("sim") >= F.lit(step).cast("float") * (1 - 1e-6)) if step == last else met.where(F.col("sim") >= F.lit(step).cast("float"))
        hits = rows.join(met.withColumnRenamed("_left", "variant"), ["level", "parent", "variant"]).join(index.names.withColumnRenamed("ascii_name", "_right"), ["level", "parent", "_right"]).where(valid_at(F.col("as_of")))
        best = cut(_first(hits, key, [F.desc("sim"), F.col("unit_id")], top).select(*key, "unit_id", "sim"))
        if step != last:
            full = best.groupBy(*key).count().where(F.col("count") >= top).select(*key)
            rows, best = cut(rows.join(full, key, "left_anti")), best.join(full, key, "left_semi")
        found = best if found is None else found.unionByName(best)
    return found


#: Units among which a search reads whole postings: fewer stages then weigh more than fewer candidates.
FEW_UNITS = 2_000


def search_index(units: DataFrame) -> DataFrame | PrefixIndex:
    """An index of all ``units`` below ROOT, by the first of each name; either kind gives the same hits."""
    units = cut(first_units(units, below_root=True))
    return index_units(units, below_root=True) if units.limit(FEW_UNITS + 1).count() <= FEW_UNITS else prefix_index(units, below_root=True)



def scored_best(pairs: DataFrame, index: PrefixIndex, top: int) -> DataFrame:
    """What ``scored`` gives, but of each variant the ``top`` best alone and those as good as the last of them.

    A unit among a request's best is among those of the variant it is best by, so
    no request loses one.
    """
    key = ["level", "parent", "variant", "as_of"]
    distinct = pairs.groupBy(*key).agg(F.min("threshold").alias("least"))
    asked = cut(simjoin.by_rarity(distinct, [*key, "least"], "variant", index.freq))
    return simjoin.top_k(asked, index.postings, key, ["level", "parent"], top, valid_at(F.col("as_of")), index.sizes).select(*key, "unit_id", "sim")


def named(variants: DataFrame, units: DataFrame, aliases: DataFrame) -> DataFrame:
    """(request, as_of, unit_id, score) of the units with an alias among (request, level, parent, as_of, variant) rows, and its greatest weight."""
    places = units.select(F.col("id").alias("unit_id"), F.col("unit_type").alias("level"), F.explode(F.array_distinct(F.array(F.coalesce("parent_id", F.lit(ROOT)), F.lit(ROOT)))).alias("parent"))
    weights = aliases.where(F.col("unit_id").isNotNull()).groupBy(F.col("alias").alias("variant"), "unit_id").agg(F.max("weight").alias("score")).join(places, "unit_id")
    return variants.join(weights, ["level", "parent", "variant"]).select("request", "as_of", "unit_id", "score")


def index_sounds(units: DataFrame, below_root: bool = False) -> DataFrame:
    """(level, parent, key, unit_id, ascii_name, valid_from, valid_to): units by the sound of their name."""
    parent = F.lit(ROOT).cast("bigint") if below_root else F.coalesce("parent_id", F.lit(ROOT))
    key = phonetic.sound_key(F.col("ascii_name"))
    return units.where(key != "").select(F.col("unit_type").alias("level"), parent.alias("parent"), key.alias("key"), F.col("id").alias("unit_id"), "ascii_name", "valid_from", "valid_to")


def sounding(variants: DataFrame, sounds: DataFrame) -> DataFrame:
    """(request, as_of, unit_id, score) of the units that sound like a variant of (request, level, parent, as_of, variant) rows.

    An equi-join on the sound key. The score lies halfway between the trigram
    similarity and 1, so that of names that sound alike the one spelt alike is first.
    """
    asked = variants.withColumn("key", phonetic.sound_key(F.col("variant"))).where(F.col("key") != "")
    met = asked.join(sounds, ["level", "parent", "key"]).where(valid_at(F.col("as_of")))
    score = (text.read_back(text.similarity(F.col("variant"), F.col("ascii_name"))) + 1) / 2
    return met.groupBy("request", "as_of", "unit_id").agg(F.max(score).alias("score"))


def similar_broadcast(pairs: DataFrame, units: DataFrame, top: int | None = None) -> DataFrame:
    """The same by comparing each variant with all names below its parent; for few names to a parent, or a few best ones.

    With ``top`` a variant keeps its best names alone, and of each name the first units:
    the ``top`` best by similarity and id are among them.
    """
    distinct = pairs.select("level", "parent", "variant").distinct()
    below = units.where(F.col("ascii_name").isNotNull()).select(F.col("id").alias("unit_id"), F.col("unit_type").alias("level"), F.explode(F.array_distinct(F.array(F.coalesce("parent_id", F.lit(ROOT)), F.lit(ROOT)))).alias("parent"), "ascii_name")
    names = below.groupBy("level", "parent", "ascii_name").agg(F.min("unit_id").alias("first"))
    if top is None:
        distinct, names = distinct.withColumn("t", text.trigrams(F.col("variant"))), names.withColumn("u", text.trigrams(F.col("ascii_name")))
        shared = F.size(F.array_intersect("t", "u"))
        hits = distinct.join(names, ["level", "parent"]).withColumn("shared", shared).where("shared > 0").select("level", "parent", "variant", "ascii_name", text.overlap(F.col("shared"), F.size("t"), F.size("u")).alias("sim"))
    else:
        day = F.lit(0).cast("int")
        always = names.select("level", "parent", F.col("first").alias("unit_id"), "ascii_name", F.date_from_unix_date(day).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
        hits = blocks.best_names(distinct.withColumn("as_of", F.date_from_unix_date(day)), always, ["level", "parent"], top).withColumnRenamed("unit_id", "first")
        hits = _first(hits, ["level", "parent", "variant"], [F.desc("sim"), F.col("first")], top).join(names, ["level", "parent", "first"])
        below = _first(below, ["level", "parent", "ascii_name"], [F.col("unit_id")], top)
    return hits.join(below, ["level", "parent", "ascii_name"]).select("level", "parent", "variant", "unit_id", "sim")


def _first(rows: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def best_match(requests: DataFrame, units: DataFrame, aliases: DataFrame, top: int, index: DataFrame | PrefixIndex | NameIndex | AlikeIndex | None = None, sounds: DataFrame | None = None, below_root: bool = False) -> DataFrame:
    """(request, rank, unit, score) for requests (request, level, parent, as_of, threshold, variants).

    A unit's score is its best similarity above the threshold over the variants,
    or its weightiest alias among them if that is more; aliases pass without a
    threshold. Ties go to units with an alias, then to the smaller id. Requests
    without variants have no hits. The requests are read twice, so they had better
    come from a table or a cut stage, and so had the ``index`` (of ``index_units``;
    made here if it is not given). Where thousands of units stand below a parent, one
    of ``prefix_index`` leaves out the postings of common trigrams; one of ``name_index``
    compares all names below a parent, for requests by the thousands to each, and one of
    ``alike_index`` looks for very similar ones first. With ``sounds`` (of
    ``index_sounds``) units that sound like a variant are hits as well.
    """
    variants = requests.select("request", "level", F.coalesce("parent", F.lit(ROOT)).alias("parent"), "as_of", "threshold", F.explode(F.transform("variants", lambda v: F.lower(F.trim(v)))).alias("variant"))
    unit = F.struct(*UNIT_FIELDS)
    known = units.select(F.col("id").alias("unit_id"), unit.alias("unit"), "valid_from", "valid_to")
    if index is None:
        index = index_units(first_units(units, below_root), below_root)
    if isinstance(index, NameIndex):
        hits = blocks.best_names(variants.select("level", "parent", "variant", "as_of").distinct(), index.names, ["level", "parent"], top)
    elif isinstance(index, AlikeIndex):
        hits = scored_alike(variants, index, top)
    else:
        hits = scored_best(variants, index, top) if isinstance(index, PrefixIndex) else scored(variants, index)
    # Each name has at least one unit, so the best units of a variant have its best names, by the first unit's id.
    hits = _first(hits, ["level", "parent", "variant", "as_of"], [F.desc("sim"), F.col("unit_id")], top).withColumnRenamed("unit_id", "first")
    found = variants.join(hits, ["level", "parent", "variant", "as_of"]).where(F.col("sim") > F.col("threshold")).groupBy("request", "as_of", "first").agg(F.max("sim").alias("sim"))
    fuzzy = found.join(namesakes(units, top, below_root), "first").select("request", "as_of", "unit_id", text.read_back(F.col("sim")).alias("score"), F.lit(0).alias("by_alias"))
    exact = named(variants, units, aliases).withColumn("by_alias", F.lit(1))
    # A unit with an alias goes first among equals, so its similarity counts wherever it stands among its namesakes.
    level, parent, name, _, _ = _name_key(units, below_root)
    spelt = exact.select("request", "as_of", "unit_id").distinct().join(units.where(name.isNotNull()).select(F.col("id").alias("unit_id"), level.alias("level"), parent.alias("parent"), "ascii_name"), "unit_id")
    spelt = spelt.join(variants, ["request", "as_of", "level", "parent"]).withColumn("sim", text.similarity(F.col("variant"), F.col("ascii_name"))).where(F.col("sim") > F.col("threshold"))
    fuzzy = fuzzy.unionByName(spelt.select("request", "as_of", "unit_id", text.read_back(F.col("sim")).alias("score"), F.lit(0).alias("by_alias")))
    if sounds is not None:
        fuzzy = fuzzy.unionByName(sounding(variants, sounds).withColumn("by_alias", F.lit(0)))
    hits = fuzzy.unionByName(exact).groupBy("request", "as_of", "unit_id").agg(F.max("score").alias("score"), F.max("by_alias").alias("by_alias"))
    found = hits.join(known, "unit_id").where(valid_at(F.col("as_of")))
    order = Window.partitionBy("request").orderBy(F.desc("score"), F.desc("by_alias"), "unit_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("request", "rank", "unit", "score")
