"""Scans of gazetteer files, and the rules that make units of them.

Files are landed beforehand; a path is whatever Spark can read. A scan gives
rows with UNIT_COLUMNS: the parent by its code, ids come with ``with_ids``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from addrloom.functions import dicts, text
from addrloom.sources import schemas


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """(doc variant) of a JSON file, one row per file."""
    return spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("doc"))


def check_nested(doc: DataFrame) -> DataFrame:
    """``doc`` if its root is a non-empty list whose first element is a list of five; an error otherwise."""
    first = F.try_variant_get("doc", "$[0]", "array<variant>")
    return doc.where(F.coalesce(F.assert_true(F.coalesce(F.size(first) == 5, F.lit(False)), "the root must be a list of lists of five").cast("boolean"), F.lit(True)))


def check_levels(doc: DataFrame) -> DataFrame:
    """``doc`` if it is a list, or an object with a list under ``data``, of objects with level1_id and level2s."""
    first = F.coalesce(F.try_variant_get("doc", "$.data[0]", "variant"), F.try_variant_get("doc", "$[0]", "variant"))
    ok = F.try_variant_get(first, "$.level1_id", "string").isNotNull() & F.try_variant_get(first, "$.level2s", "array<variant>").isNotNull()
    return doc.where(F.coalesce(F.assert_true(F.coalesce(ok, F.lit(False)), "elements must have level1_id and level2s").cast("boolean"), F.lit(True)))


def _node(level: DataFrame, parent: Column) -> DataFrame:
    """The fields of (node, ...) with the list of children."""
    at = lambda k, kind="string": F.try_variant_get("node", f"$[{k}]", kind)
    name, prefix = at(1), F.coalesce(at(2), F.lit(""))
    kind = F.when(parent.isNull(), F.lit("province")).otherwise(text.unit_type_of(prefix)) if parent is not None else F.lit("province")
    return level.select(
        at(0).alias("gso_code"), F.when(prefix != "", F.concat_ws(" ", prefix, name)).otherwise(name).alias("full_name"), name.alias("name"), prefix.alias("name_prefix"),
        kind.alias("unit_type"), F.trim(text.drop_apostrophes(at(3))).alias("ascii_name"), parent.alias("parent_gso_code"), at(4, "array<variant>").alias("children"),
    )


def scan_nested(spark: SparkSession, path: str) -> DataFrame:
    """Units of a nested list [code, name, prefix, plain name, children], three levels deep, valid from the first day on."""
    return nested_units(read_document(spark, path))


def nested_units(docs: DataFrame) -> DataFrame:
    """The same for (doc variant) rows."""
    roots = check_nested(docs).select(F.explode(F.variant_get("doc", "$", "array<variant>")).alias("node"))
    levels = [_node(roots, F.lit(None).cast("string"))]
    for _ in range(2):
        up = levels[-1].where(F.size("children") > 0).select(F.col("gso_code").alias("_up"), F.explode("children").alias("node"))
        levels.append(_node(up, F.col("_up")))
    units = levels[0].unionByName(levels[1]).unionByName(levels[2]).drop("children")
    return units.withColumns({"valid_from": F.lit(dicts.PRE_MERGER_FIRST), "valid_to": F.lit(None).cast("date"), "era": F.lit("pre_merger")}).select(*schemas.UNIT_COLUMNS)


def scan_objects(spark: SparkSession, path: str) -> DataFrame:
    """Units of a list of provinces with their wards, valid from the merger on."""
    return object_units(spark.read.schema(schemas.POST_MERGER_JSON).json(path, multiLine=True))


def object_units(provinces: DataFrame) -> DataFrame:
    """The same for (Code, FullName, Wards) rows."""
    wards = provinces.select(F.col("Code").alias("parent_gso_code"), F.explode("Wards").alias("w")).select("w.Code", "w.FullName", "parent_gso_code")

    def units(rows: DataFrame, kind: str) -> DataFrame:
        prefix, name = text.split_prefix(F.col("FullName"))
        return rows.select(
            F.col("Code").alias("gso_code"), F.col("FullName").alias("full_name"), name.alias("name"), prefix.alias("name_prefix"), F.lit(kind).alias("unit_type"), text.index_name(name).alias("ascii_name"),
            "parent_gso_code", F.lit(dicts.MERGER_DATE).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit("post_merger").alias("era"),
        )

    return units(provinces.withColumn("parent_gso_code", F.lit(None).cast("string")), "province").unionByName(units(wards, "ward"))


def count_objects(spark: SparkSession, path: str) -> DataFrame:
    """(provinces, wards) that a file of provinces holds."""
    return object_counts(spark.read.schema(schemas.POST_MERGER_JSON).json(path, multiLine=True))


def object_counts(provinces: DataFrame) -> DataFrame:
    """The same for (Code, FullName, Wards) rows."""
    return provinces.agg(F.count(F.lit(1)).alias("provinces"), F.coalesce(F.sum(F.when(F.col("Wards").isNotNull(), F.size("Wards"))), F.lit(0)).alias("wards"))


def scan_date(spark: SparkSession, path: str) -> DataFrame:
    """(data_as_of) of the text file that names the data's date."""
    return first_date(spark.read.text(path))


def first_date(lines: DataFrame) -> DataFrame:
    """The same for (value) rows of one file, in order."""
    return lines.select(F.trim("value").alias("data_as_of")).where("data_as_of <> ''").limit(1)


def unit_id(code: Column, valid_from: Column) -> Column:
    """The id of a unit: the same on every build."""
    return F.xxhash64(code, valid_from)


def with_ids(units: DataFrame) -> DataFrame:
    """Units with id and parent_id; a parent is the unit with the code in the same era."""
    own = units.withColumn("id", unit_id(F.col("gso_code"), F.col("valid_from")))
    up = own.select(F.col("gso_code").alias("_code"), F.col("era").alias("_era"), F.col("id").alias("parent_id"), F.col("unit_type").alias("_kind"))
    # A code may recur at several levels of one era; the parent stands one level up.
    level = lambda c: F.when(c == "province", 0).when(c == "district", 1).otherwise(2)
    joined = own.join(up, (F.col("parent_gso_code") == F.col("_code")) & (F.col("era") == F.col("_era")) & (level(F.col("_kind")) < level(F.col("unit_type"))), "left")
    return joined.drop("_code", "_era", "_kind", "parent_gso_code")


def seed_aliases(units: DataFrame) -> DataFrame:
    """Aliases: those of provinces and unit types, which name no unit, and one for each unit with a plain name."""
    spark = units.sparkSession
    fixed = [(a.lower().strip(), c, "province", None, w) for a, c, w in dicts.PROVINCE_ALIASES] + [(a.lower().strip(), c, "unit_type", None, w) for a, c, w in dicts.UNIT_TYPE_ALIASES]
    seeds = spark.createDataFrame(fixed, schemas.ALIASES)
    own = units.where("ascii_name IS NOT NULL AND ascii_name <> ''").select(F.lower(F.trim("ascii_name")).alias("alias"), F.col("full_name").alias("canonical"), F.col("unit_type").alias("alias_type"), F.col("id").alias("unit_id"), F.lit(1.0).alias("weight"))
    return add_aliases(seeds, own)


def add_aliases(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both, once each: a repeated load adds nothing."""
    return old.unionByName(new).dropDuplicates(["alias", "canonical", "alias_type", "unit_id"])


def link_aliases(aliases: DataFrame, units: DataFrame) -> DataFrame:
    """Aliases of provinces that name no unit, with the unit of their canonical name (an extension; see the README)."""
    names = units.where("unit_type = 'province'").select(F.col("full_name").alias("canonical"), F.col("id").alias("_id"))
    free = aliases.where("unit_id IS NULL AND alias_type = 'province'").join(names, "canonical", "left")
    return free.withColumn("unit_id", F.col("_id")).select(*aliases.columns).unionByName(aliases.where("NOT (unit_id IS NULL AND alias_type = 'province')"))
