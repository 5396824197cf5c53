from __future__ import annotations

import threading
from datetime import date, datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from addrloom.functions import text
from addrloom.operators import extensions, tables
from addrloom.plans import resolve as plan
from addrloom.sources import landing, sample, schemas

TODAY = date(2026, 1, 1)


@pytest.fixture
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.headers.get("If-None-Match"))
            if self.path.endswith("missing"):
                self.send_response(404)
                self.end_headers()
            elif self.headers.get("If-None-Match") == '"v1"':
                self.send_response(304)
                self.end_headers()
            else:
                self.send_response(200)
                self.send_header("ETag", '"v1"')
                self.end_headers()
                self.wfile.write(b"[]")

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", asked
    http.shutdown()


def test_landing(server, tmp_path):
    url, asked = server
    assert landing.land(f"{url}/a.json", str(tmp_path)) == (str(tmp_path / "a.json"), True)
    assert landing.land(f"{url}/a.json", str(tmp_path))[1] is False
    assert landing.land(f"{url}/a.json", str(tmp_path), force=True)[1] is True
    assert asked == [None, '"v1"', None]
    assert landing.land_all(url, ("b.json", "date.txt"), str(tmp_path)) == {"b.json": True, "date.txt": True}
    with pytest.raises(OSError):
        landing.land(f"{url}/missing", str(tmp_path))


def test_batches(spark, tmp_path):
    (tmp_path / "in.csv").write_text('addr_id,raw_input,as_of_date,use_geocoder\n1,"Cát Linh, Đống Đa, Hà Nội",2025-06-30,false\n2,ha noi,,\n', encoding="utf-8")
    rows = landing.read_addresses(spark, str(tmp_path / "in.csv"))
    assert [tuple(r) for r in rows.orderBy("addr_id").collect()] == [(1, "Cát Linh, Đống Đa, Hà Nội", date(2025, 6, 30), False), (2, "ha noi", None, True)]
    gaz = plan.build(spark, *sample.write(str(tmp_path / "gaz")))
    found = plan.resolve(rows, gaz, TODAY)
    landing.write_results(found, str(tmp_path / "out"), "csv")
    back = spark.read.csv(str(tmp_path / "out"), header=True).orderBy("addr_id").collect()
    assert [r["ward_full_name"] for r in back] == ["Phường Cát Linh", "Xã Đoài Phương"] or back[0]["ward_full_name"] == "Phường Cát Linh"
    landing.write_results(found, str(tmp_path / "nested"))
    assert spark.read.parquet(str(tmp_path / "nested")).where("size(candidates) > 0").count() == 2
    assert len(landing.report_lines(gaz.units)) == landing.report(gaz.units).count() > 0
    assert extensions.explain(found).where("explanation LIKE '%reasons%'").count() == 2


def test_database_options():
    assert landing.database_options({"DATABASE_URL": "postgresql://h/db"})["url"] == "jdbc:postgresql://h/db"
    assert landing.database_options({"POSTGRES_HOST": "h", "POSTGRES_DB": "d", "POSTGRES_USER": "u"}) == {"url": "jdbc:postgresql://h:5432/d", "user": "u", "password": ""}


def test_corrections(spark, tmp_path):
    rows = spark.createDataFrame([("a", '{"x": 1}', 0.5, "me", datetime(2026, 1, 1))], "raw_input string, corrected_address string, confidence double, reviewer string, created_at timestamp")
    rows = rows.withColumn("predicted_address", F.struct(F.lit(1).alias("ward")))
    for _ in range(2):
        landing.log_corrections(rows, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.count() == 2 and back.first()["predicted_address"] == '{"ward":1}'


def test_calibration(spark):
    rows = spark.createDataFrame([(i / 100, int(i + 20 * (i % 3) > 60)) for i in range(100)], "confidence double, correct int")
    p = [r["probability"][1] for r in extensions.calibrate(rows, ["confidence"]).transform(rows).orderBy("confidence").collect()]
    assert p == sorted(p) and p[0] < 0.2 < 0.8 < p[-1]


def test_ambiguity_and_terms(spark):
    df = spark.createDataFrame([(10.0, 9.5), (10.0, 5.0), (10.0, None)], "a double, b double")
    assert [r[0] for r in df.select(extensions.ambiguous(F.col("a"), F.col("b"), 1.0)).collect()] == [True, False, False]
    with pytest.raises(ValueError):
        extensions.seven_terms(nothing=F.lit(1.0))


def test_tables_beside_the_gazetteer(spark, tmp_path):
    gaz = plan.build(spark, *sample.write(str(tmp_path / "gaz")))
    ward = gaz.units.where("full_name = 'Phường Cát Linh'").first()
    codes = spark.createDataFrame([("11500", ward["id"], ward["parent_id"], None)], schemas.POSTAL_CODES)
    row = tables.with_places(codes, gaz.units).first()
    assert (row["ward_name"], row["district_name"], row["province_name"]) == ("Phường Cát Linh", "Quận Đống Đa", None)
    assert tables.spot_check(gaz.units).first()["full_name"] == "Thành phố Trung ương Hồ Chí Minh"


def test_plans_stay_in_the_jvm_and_push_down(spark, tmp_path):
    gaz = plan.build(spark, *sample.write(str(tmp_path / "gaz")))
    plan.save(gaz, str(tmp_path / "tables"))
    units = plan.load(spark, str(tmp_path / "tables")).units
    one = units.where((F.col("era") == "post_merger") & (F.col("unit_type") == "ward") & tables.valid_at(F.lit(TODAY))).select("id", "ascii_name")
    text_plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(era" in text_plan and "LessThanOrEqual(valid_from" in text_plan and "embedding" not in text_plan
    rows = spark.createDataFrame([(1, "ha noi", TODAY)], "addr_id bigint, raw_input string, as_of date")
    assert "Python" not in plan.prepare(rows).select("normalized", "variants", "house_number")._jdf.queryExecution().toString()


def test_normalize_ignores_unicode_form(spark):
    import unicodedata

    s = "Đường Nguyễn Huệ, Quận 1"
    df = spark.createDataFrame([(unicodedata.normalize(f, s),) for f in ("NFC", "NFD")], "s string").select(text.normalize(F.col("s")))
    assert df.distinct().count() == 1
