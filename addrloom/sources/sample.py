"""A small gazetteer of both eras, in the shapes of the source files, for tests and inline queries."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import SparkSession

NESTED = [
    ["01", "Hà Nội", "Thành phố Trung ương", "Ha Noi", [
        ["006", "Đống Đa", "Quận", "Dong Da", [["00178", "Cát Linh", "Phường", "Cat Linh", []], ["00181", "Văn Miếu", "Phường", "Van Mieu", []]]],
        ["001", "Ba Đình", "Quận", "Ba Dinh", [["00001", "Phúc Xá", "Phường", "Phuc Xa", []]]],
    ]],
    ["70", "Bình Phước", "Tỉnh", "Binh Phuoc", [
        ["688", "Phước Long", "Thị xã", "Phuoc Long", [["25217", "Long Phước", "Phường", "Long Phuoc", []], ["25216", "Thác Mơ", "Phường", "Thac Mo", []]]],
        ["689", "Đồng Xoài", "Thành phố", "Dong Xoai", [["25195", "Tân Phú", "Phường", "Tan Phu", []]]],
    ]],
    ["66", "Đắk Lắk", "Tỉnh", "Dak Lak", [
        ["645", "Ea H'leo", "Huyện", "Ea H'leo", [["24181", "Ea Drăng", "Thị trấn", "Ea Drang", []], ["24184", "Ea H'leo", "Xã", "Ea H'leo", []]]],
        ["643", "Buôn Ma Thuột", "Thành phố", "Buon Ma Thuot", [["24118", "Tân Lập", "Phường", "Tan Lap", []]]],
    ]],
    ["37", "Ninh Bình", "Tỉnh", "Ninh Binh", [["369", "Ninh Bình", "Thành phố", "Ninh Binh", [["14320", "Đông Thành", "Phường", "Dong Thanh", []]]]]],
    ["79", "Hồ Chí Minh", "Thành phố Trung ương", "Ho Chi Minh", [
        ["767", "Tân Phú", "Quận", "Tan Phu", [["27022", "Sơn Kỳ", "Phường", "Son Ky", []], ["27025", "Tân Quý", "Phường", "Tan Quy", []]]],
        ["760", "Quận 1", "Quận", "Quan 1", [["26734", "Tân Định", "Phường", "Tan Dinh", []]]],
    ]],
]

OBJECTS = [
    {"Code": "01", "FullName": "Thành phố Hà Nội", "Wards": [{"Code": "10126", "FullName": "Xã Đoài Phương"}, {"Code": "00178", "FullName": "Phường Ô Chợ Dừa"}]},
    {"Code": "37", "FullName": "Tỉnh Ninh Bình", "Wards": [{"Code": "13456", "FullName": "Xã Nam Lý"}, {"Code": "13459", "FullName": "Xã Nam Xang"}]},
    {"Code": "79", "FullName": "Thành phố Hồ Chí Minh", "Wards": [{"Code": "26734", "FullName": "Phường Tân Định"}]},
    {"Code": "48", "FullName": "Thành phố Đà Nẵng"},
    {"Code": "66", "FullName": "Tỉnh Đắk Lắk", "Wards": [{"Code": "24112", "FullName": "Phường Tân An"}]},
]

ADDRESSES = [
    (1, "Đoàn Kết, Xã Đoài Phương, Hà Nội", None),
    (2, "Trung tâm y tế thị xã PHƯỚC LONG, BÌNH PHƯỚC", None),
    (3, "nhà hàng minh đức, nam lý, NB", None),
    (4, "so 6 db phu thi tran eadrang huyen eahleo dak lak", None),
    (5, "dong da ha noi", "2025-06-30"),
    (6, "hcm", None),
    (7, "son ky tan phu", "2025-06-30"),
    (8, "22 bờ báo btaan thang p son ky q tần phú tphcm", "2025-06-30"),
    (9, "123", None),
    (10, "q1 hcm,", "2025-06-30"),
]


def write(folder: str) -> tuple[str, str]:
    """Write both files to a new local folder and return their paths."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    paths = f"{folder}/nested.json", f"{folder}/objects.json"
    for path, data in zip(paths, (NESTED, OBJECTS)):
        Path(path).write_text(json.dumps(data, ensure_ascii=False), encoding="utf-8")
    return paths


def addresses(spark: SparkSession):  # noqa: ANN201
    from addrloom.sources import schemas

    rows = [(i, a, None, True) for i, a, _ in ADDRESSES]
    df = spark.createDataFrame(rows, schemas.ADDRESSES)
    dates = spark.createDataFrame([(i, d) for i, _, d in ADDRESSES], "addr_id bigint, d string")
    return df.join(dates, "addr_id").selectExpr("addr_id", "raw_input", "to_date(d) AS as_of_date", "use_geocoder")
