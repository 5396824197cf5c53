from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from addrloom import registry
from addrloom.operators import match, tables
from addrloom.plans import resolve as plan
from addrloom.sources import gazetteer, sample, schemas
from addrloom.streaming import stream

TODAY = date(2026, 1, 1)


@pytest.fixture(scope="module")
def gaz(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("gaz")
    plan.save(plan.build(spark, *sample.write(str(folder / "files"))), str(folder / "tables"))
    return plan.load(spark, str(folder / "tables"))


@pytest.fixture(scope="module")
def results(spark, gaz):
    return {r["addr_id"]: r for r in plan.resolve(sample.addresses(spark), gaz, TODAY).collect()}


def names(row):
    return tuple(row["top"][level]["full_name"] if row["top"] and row["top"][level] else None for level in ("province", "district", "ward"))


def test_build(gaz):
    assert {tuple(r) for r in tables.counts(gaz.units, "era", "unit_type").collect()} == {("post_merger", "province", 5), ("post_merger", "ward", 6), ("pre_merger", "district", 9), ("pre_merger", "province", 5), ("pre_merger", "ward", 13)}
    assert tables.orphans(gaz.units).isEmpty() and tables.broken_links(gaz.units).isEmpty()
    assert gaz.units.where("era = 'pre_merger' AND valid_to <> DATE'2025-06-30'").isEmpty()
    assert gaz.units.select("id").distinct().count() == gaz.units.count()
    assert gaz.units.where("full_name = 'Huyện Ea H''leo'").first()["ascii_name"] == "Ea Hleo"


def test_shape_checks(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{}")
    (tmp_path / "levels.json").write_text('{"data": [{"level1_id": "01", "level2s": []}]}')
    (tmp_path / "date.txt").write_text("2025-03-01\n")
    with pytest.raises(Exception, match="list of lists of five"):
        gazetteer.scan_nested(spark, str(tmp_path / "bad.json")).collect()
    assert gazetteer.check_levels(gazetteer.read_document(spark, str(tmp_path / "levels.json"))).count() == 1
    with pytest.raises(Exception, match="level1_id"):
        gazetteer.check_levels(gazetteer.read_document(spark, str(tmp_path / "bad.json"))).collect()
    assert gazetteer.scan_date(spark, str(tmp_path / "date.txt")).first()[0] == "2025-03-01"


def test_aliases_load_twice(gaz):
    seeds = gazetteer.seed_aliases(gaz.units)
    assert gazetteer.add_aliases(seeds, seeds).count() == seeds.count() == gaz.aliases.count()
    linked = gazetteer.link_aliases(gaz.aliases, gaz.units)
    assert linked.where("alias = 'hn' AND unit_id IS NOT NULL").count() == 1


def test_documented_cases(results):
    assert results[1]["era"] == "post_merger" and names(results[1]) == ("Thành phố Hà Nội", None, "Xã Đoài Phương")
    assert results[2]["era"] == "pre_merger" and names(results[2]) == ("Tỉnh Bình Phước", "Thị xã Phước Long", "Phường Long Phước")
    assert results[3]["era"] == "post_merger" and names(results[3]) == ("Tỉnh Ninh Bình", None, "Xã Nam Lý") and results[3]["street_raw"] == "nha hang minh đuc"
    assert results[4]["house_number"] == "6"
    assert results[5]["era"] == "pre_merger" and names(results[5])[:2] == ("Thành phố Trung ương Hà Nội", "Quận Đống Đa")
    assert names(results[8]) == ("Thành phố Trung ương Hồ Chí Minh", "Quận Tân Phú", "Phường Sơn Kỳ") and results[8]["house_number"] == "22"


def test_before_merger_case(spark, gaz):
    row = plan.resolve_one(spark, "so 6 db phu thi tran eadrang huyen eahleo dak lak", gaz, TODAY, "2025-06-30").first()
    assert names(row)[:2] == ("Tỉnh Đắk Lắk", "Huyện Ea H'leo") and row["house_number"] == "6" and row["as_of_date"] == "2025-06-30"


def test_edges(results):
    assert len(results) == len(sample.ADDRESSES)
    assert results[9]["confidence"] == 0.0 and results[9]["top"] is None and results[9]["candidates"] == [] and results[9]["street_raw"] is None
    assert results[10]["house_number"] == "1"


def test_properties(results, gaz):
    parents = {r["id"]: r["parent_id"] for r in gaz.units.collect()}
    for r in results.values():
        assert 0 <= r["confidence"] <= 1 and len(r["candidates"]) <= 5
        scores = [c["score"] for c in r["candidates"]]
        assert scores == sorted(scores, reverse=True)
        for c in r["candidates"]:
            if c["ward"]:
                assert parents[c["ward"]["id"]] == (c["district"] or c["province"])["id"]
            if c["district"]:
                assert parents[c["district"]["id"]] == c["province"]["id"]


def test_nothing_is_valid_before_the_first_day(spark, gaz):
    assert plan.resolve_one(spark, "ha noi", gaz, TODAY, "1999-12-31").first()["top"] is None


def test_numbers_of_districts_without_compat(spark, gaz):
    rows = spark.createDataFrame([(1, "so 6 q1 hcm", date(2025, 6, 30))], "addr_id bigint, raw_input string, as_of date")
    row = plan.prepare(rows, compat=False).first()
    assert row["house_number"] == "6"


def test_poi(spark, gaz):
    poi = spark.createDataFrame(registry.POI_ROWS, schemas.POI)
    rows = {r["addr_id"]: r for r in plan.resolve(sample.addresses(spark), gaz, TODAY, poi).collect()}
    assert rows[3]["geocoder_used"] and rows[3]["geocoder_source"] == "gemini" and rows[3]["geocoder_address"] == "Nhà hàng Minh Đức"
    assert rows[5]["geocoder_used"] and names(rows[5]) == ("Thành phố Trung ương Hà Nội", "Quận Đống Đa", "Phường Cát Linh")
    assert not rows[1]["geocoder_used"]


def test_calls(spark, gaz):
    assert plan.search(spark, "hà nội", gaz, TODAY).first()["full_name"] == "Thành phố Hà Nội"
    assert plan.search(spark, "dong da", gaz, TODAY, "district").isEmpty()
    assert [(r["era"], r["active"]) for r in plan.health(gaz, TODAY).collect()] == [("post_merger", True), ("pre_merger", False)]
    for bad in ({"q": ""}, {"q": "x", "unit_type": "street"}, {"q": "x", "limit": 31}):
        with pytest.raises(ValueError):
            plan.search(spark, gaz=gaz, today=TODAY, **bad)
    with pytest.raises(ValueError):
        plan.resolve_one(spark, "  ", gaz, TODAY)
    with pytest.raises(ValueError):
        plan.resolve_one(spark, "ha noi", gaz, TODAY, "01/02/2025")
    asked = spark.createDataFrame([(1, " ", None), (2, "x", "2025-13-01"), (3, "x", "2025-01-01"), (4, None, None)], "addr_id int, address string, as_of_date string")
    assert {r["addr_id"] for r in plan.request_errors(asked).collect()} == {1, 2, 4}


def test_strategies_agree(spark, gaz):
    pairs = spark.createDataFrame([(level, match.ROOT, v) for level in ("province", "district", "ward") for v in ("ha noi", "dong da", "tan", "phu", "x", "")], "level string, parent bigint, variant string")
    a = {tuple(r) for r in match.similar(pairs, gaz.units).collect()}
    b = {tuple(r) for r in match.similar_broadcast(pairs, gaz.units).select("level", "parent", "variant", "unit_id", "sim").collect()}
    assert a == b and a


@pytest.mark.parametrize(("start", "end", "day", "ok"), [("2000-01-01", "2025-06-30", "2025-06-30", True), ("2000-01-01", "2025-06-30", "2025-07-01", False), ("2025-07-01", None, "2025-07-01", True), ("2000-01-01", None, "1999-12-31", False)])
def test_validity(spark, start, end, day, ok):
    df = spark.createDataFrame([(date.fromisoformat(start), date.fromisoformat(end) if end else None)], "valid_from date, valid_to date")
    assert df.select(tables.valid_at(F.lit(date.fromisoformat(day)))).first()[0] is ok


def test_backfill(spark):
    df = spark.createDataFrame([("a", None), ("b", "post_merger")], "k string, era string")
    assert {r["era"] for r in tables.backfill_era(df).collect()} == {"pre_merger"}


def test_stream(spark, gaz, tmp_path):
    sample.addresses(spark).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schemas.ADDRESSES).parquet(str(tmp_path / "in"))
    stream.resolve_stream(source, gaz, TODAY, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(sample.ADDRESSES)


def test_refresh_checks_and_saves(spark, tmp_path):
    sample.write(str(tmp_path / "landing"))
    with pytest.raises(ValueError, match="count_province"):
        plan.refresh(spark, str(tmp_path / "landing"), str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()
    gaz, checks = plan.refresh(spark, str(tmp_path / "landing"), str(tmp_path / "out"), strict=False)
    assert checks.count() == 5
    assert gaz.counts == {"old": 27, "new": 11, "units": 38, "aliases": gaz.aliases.count()}
    again = plan.load(spark, str(tmp_path / "out"))
    assert again.units.count() == gaz.units.count() and again.index.count() == gaz.index.count()
    assert plan.search(spark, "ha noi", again, TODAY).first()["full_name"] == "Thành phố Hà Nội"


def test_repaired_tokens_keep_rows(spark):
    rows = spark.createDataFrame([(1, "a bad ring"), (1, "a bad ring"), (2, None), (3, "")], "k int, s string")
    fixed = tables.repair_tokens(rows, spark.createDataFrame([("bad", "red", 2)], schemas.OCR_CONFUSIONS), "s")
    assert sorted(map(tuple, fixed.collect()), key=str) == sorted([(1, "a red ring"), (1, "a red ring"), (2, None), (3, "")], key=str)
