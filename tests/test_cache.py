"""Kept replies: what is resolved again, what a changed gazetteer leaves, and aliases at every level."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from addrloom import registry
from addrloom.plans import cache
from addrloom.plans import resolve as plan
from addrloom.sources import sample, schemas

TODAY = date(2026, 1, 1)


@pytest.fixture(scope="module")
def gaz(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("gaz")
    plan.save(plan.build(spark, *sample.write(str(folder / "files"))), str(folder / "tables"))
    return plan.load(spark, str(folder / "tables"))


def plain(rows):
    return {r["addr_id"]: str(r.asDict(recursive=True)) for r in rows.select(sorted(rows.columns)).collect()}


def test_new_texts_alone_are_resolved(spark, gaz, tmp_path):
    folder, rows = str(tmp_path), sample.addresses(spark)
    first = rows.where("addr_id <= 4")
    cache.resolve(first, gaz, TODAY, folder)
    where = f"{folder}/{cache.version(gaz)}"
    before = spark.read.parquet(where).count()
    shouted = rows.withColumn("raw_input", F.upper("raw_input")).where("addr_id <= 4").withColumn("addr_id", F.col("addr_id") + 1000)
    got = plain(cache.resolve(rows.unionByName(shouted), gaz, TODAY, folder))
    assert {k: v for k, v in got.items() if k < 1000} == plain(plan.resolve(rows, gaz, TODAY)) and len(got) == rows.count() + 4
    keys = cache.keyed(rows, TODAY).select("key").distinct().count()
    assert spark.read.parquet(where).count() == keys > before
    cache.resolve(rows, gaz, TODAY, folder)
    assert spark.read.parquet(where).count() == keys


def test_an_empty_cache_and_no_rows(spark, gaz, tmp_path):
    assert cache.resolve(sample.addresses(spark).limit(0), gaz, TODAY, str(tmp_path)).isEmpty()
    cache.carry(spark, str(tmp_path / "none"), gaz, gaz)


def test_the_version_is_of_rows_not_of_their_order(spark, gaz):
    again = plan.Gazetteer(gaz.units.orderBy(F.desc("id")), gaz.aliases.repartition(3), gaz.index)
    assert cache.version(again) == cache.version(gaz)
    assert cache.version(gaz, compat=False) != cache.version(gaz) != cache.version(plan.Gazetteer(gaz.units.where("unit_type <> 'ward'"), gaz.aliases))
    assert cache.version(gaz, spark.createDataFrame(registry.POI_ROWS, schemas.POI)) != cache.version(gaz)


def test_a_changed_gazetteer_takes_over_what_it_cannot_change(spark, gaz, tmp_path):
    """A ward gets another name, one goes, and one has a new alias: other replies stay, and all are as if resolved anew."""
    rows, folder = sample.addresses(spark), str(tmp_path)
    old = plain(cache.resolve(rows, gaz, TODAY, folder))
    units = gaz.units.where("full_name <> 'Xã Nam Lý'").withColumn("ascii_name", F.when(F.col("full_name") == "Phường Cát Linh", "Xyz").otherwise(F.col("ascii_name")))
    named = units.where("full_name = 'Phường Sơn Kỳ'").select(F.lit("bo bao").alias("alias"), F.col("full_name").alias("canonical"), F.lit("ward").alias("alias_type"), F.col("id").alias("unit_id"), F.lit(0.9).alias("weight"))
    new = plan.indexed(plan.Gazetteer(units, gaz.aliases.unionByName(named)))
    cache.carry(spark, folder, gaz, new)
    target = f"{folder}/{cache.version(new)}"
    kept, every = spark.read.parquet(target).count(), spark.read.parquet(f"{folder}/{cache.version(gaz)}").count()
    assert 0 < kept < every
    want = plain(plan.resolve(rows, new, TODAY))
    assert plain(cache.resolve(rows, new, TODAY, folder)) == want != old
    cache.carry(spark, folder, gaz, new)
    assert spark.read.parquet(target).groupBy("key").count().where("count > 1").isEmpty()


def test_aliases_decide_at_every_level(spark):
    """In the query's addresses, a weight that no similarity has shows that an alias decided."""
    rows = registry.resolve_full(spark, "/root/testdata/sf0.01").select("reasons", "province").collect()
    for level, weight in (("province", "0.90"), ("district", "0.50"), ("ward", "0.70")):
        assert any(f"{level}=" in r["reasons"] and f"({weight})" in r["reasons"].split(f"{level}=")[1].split(";")[0] for r in rows if r["reasons"])


def test_branches_by_hand(spark, gaz):
    """An alias for a province, one too light to be trusted as the last segment, and a lookup whose place is unknown."""
    lands = {r["full_name"]: r["id"] for r in gaz.units.where("unit_type = 'province' AND era = 'post_merger'").collect()}
    name = "Tỉnh Ninh Bình"
    of = lambda alias, weight: spark.createDataFrame([(alias, name, "province", lands[name], weight)], schemas.ALIASES)
    asked = spark.createDataFrame([(1, "nam lý, zzqx", TODAY)], "addr_id bigint, raw_input string, as_of date")
    trusted = plan.provinces(plan.prepare(asked), plan.Gazetteer(gaz.units, of("zzqx", 0.5), gaz.index)).collect()
    assert [(r["province"]["full_name"], r["p_score"]) for r in trusted] == [(name, 0.5)]
    light = plan.provinces(plan.prepare(asked), plan.Gazetteer(gaz.units, of("zzqx", 0.49), gaz.index)).collect()
    assert (name, 0.49) in [(r["province"]["full_name"], r["p_score"]) for r in light]
    poi = spark.createDataFrame([("somewhere else", "Hà Nội", "x", "gemini", None, None, None)], schemas.POI)
    row = plan.resolve_one(spark, "Nhà hàng Qx", gaz, TODAY, poi=poi).first()
    assert not row["geocoder_used"] and row["geocoder_source"] is None
