"""Fixed values of the address domain: they decide the results and are stated as they are."""

from __future__ import annotations

from datetime import date

# Province shorthand and name, in the order in which equally long ones apply.
PROVINCES = [
    ("hcm", "ho chi minh"),
    ("hcmc", "ho chi minh"),
    ("sg", "ho chi minh"),
    ("saigon", "ho chi minh"),
    ("tphcm", "ho chi minh"),
    ("hn", "ha noi"),
    ("hanoi", "ha noi"),
    ("dn", "da nang"),
    ("danang", "da nang"),
    ("hp", "hai phong"),
    ("ct", "can tho"),
    ("ag", "an giang"),
    ("bk", "bac kan"),
    ("bg", "bac giang"),
    ("bl", "bac lieu"),
    ("bn", "bac ninh"),
    ("bt", "binh thuan"),
    ("bd", "binh duong"),
    ("bp", "binh phuoc"),
    ("bte", "ben tre"),
    ("brvt", "ba ria vung tau"),
    ("vung tau", "ba ria vung tau"),
    ("cb", "cao bang"),
    ("cbb", "cao bang"),
    ("dlk", "dak lak"),
    ("dnai", "dong nai"),
    ("dt", "dong thap"),
    ("gl", "gia lai"),
    ("hb", "hoa binh"),
    ("hg", "ha giang"),
    ("hnam", "ha nam"),
    ("ht", "ha tinh"),
    ("hd", "hai duong"),
    ("hy", "hung yen"),
    ("hue", "hue"),
    ("tth", "hue"),
    ("kg", "kien giang"),
    ("kh", "khanh hoa"),
    ("kont", "kon tum"),
    ("la", "long an"),
    ("ld", "lam dong"),
    ("ls", "lang son"),
    ("lc", "lai chau"),
    ("lci", "lao cai"),
    ("mb", "moc bai"),
    ("na", "nghe an"),
    ("nb", "ninh binh"),
    ("nt", "ninh thuan"),
    ("pt", "phu tho"),
    ("py", "phu yen"),
    ("qb", "quang binh"),
    ("qn", "quang nam"),
    ("qng", "quang ngai"),
    ("qni", "quang ngai"),
    ("qt", "quang tri"),
    ("sc", "soc trang"),
    ("sl", "son la"),
    ("tb", "thai binh"),
    ("tg", "tien giang"),
    ("th", "thanh hoa"),
    ("tn", "thai nguyen"),
    ("tv", "tra vinh"),
    ("vl", "vinh long"),
    ("vp", "vinh phuc"),
    ("yb", "yen bai"),
]

# Unit type shorthand and word. Numbered districts q1 to q12 and q.1 to q.12 are "quan" and the number.
UNIT_TYPES = [
    ("tp", "thanh pho"),
    ("q", "quan"),
    ("h", "huyen"),
    ("p", "phuong"),
    ("x", "xa"),
    ("tx", "thi xa"),
    ("tt", "thi tran"),
    ("kp", "khu pho"),
    ("dg", "duong"),
    ("d", "duong"),
    ("hxh", "hem"),
    ("hem", "hem"),
    ("ql", "quoc lo"),
    ("tl", "tinh lo"),
]
DISTRICT_NUMBERS = range(1, 13)

# Words of unit types, which are no names.
STRUCTURAL = ["thanh", "pho", "quan", "huyen", "phuong", "xa", "thi", "tran", "khu", "duong", "hem", "ngo", "ngach"]

# Fixed value: a house number with the word before it; its first group is the number.
HOUSE = r"(?:\bso\.?\s*|\bs\.?\s*|#\s*)?(\d+[a-z]?(?:[/\-]\d+[a-z]?)*)"

# Street shorthand and words.
STREETS = [
    ("db", "Dien Bien"),
    ("dl", "Dai Lo"),
    ("ql", "Quoc Lo"),
    ("tl", "Tinh Lo"),
    ("nt", "Nguyen Trai"),
    ("ck", "Cach Mang"),
    ("le", "Le"),
    ("ng", "Nguyen"),
]

# A text with one of these in it names a place, not an address.
PLACE_WORDS = [
    "bệnh viện", "benh vien", "phòng khám", "phong kham", "trạm y tế", "tram y te",
    "trường", "truong", "đại học", "dai hoc", "học viện", "hoc vien", "trung học", "tiểu học", "mầm non", "mam non",
    "khách sạn", "khach san", "nhà hàng", "nha hang", "resort", "hotel",
    "siêu thị", "sieu thi", "trung tâm thương mại", "trung tam", "chợ", "cho", "công ty", "cong ty", "chi nhánh", "chi nhanh",
    "chùa", "chua", "nhà thờ", "nha tho", "đình", "dinh", "đền", "den", "tháp", "thap", "cầu", "cau",
    "ủy ban", "uy ban", "tòa án", "toa an", "bưu điện", "buu dien", "công an", "cong an", "sân bay", "san bay", "ga ",
]

# Prefixes of each unit type, and those that full names are split at.
PREFIXES = {"province": ["thành phố trung ương", "tỉnh"], "district": ["quận", "huyện", "thành phố", "thị xã"], "ward": ["phường", "xã", "thị trấn"]}
FULL_PREFIXES = ["Thành phố", "Tỉnh", "Phường", "Xã", "Thị trấn", "Thị xã", "Quận", "Huyện"]

# Alias, full name of a province, weight.
PROVINCE_ALIASES = [
    ("tphcm", "Thành phố Hồ Chí Minh", 2.0),
    ("tp hcm", "Thành phố Hồ Chí Minh", 2.0),
    ("tp.hcm", "Thành phố Hồ Chí Minh", 2.0),
    ("hcm", "Thành phố Hồ Chí Minh", 1.8),
    ("hcmc", "Thành phố Hồ Chí Minh", 1.8),
    ("sg", "Thành phố Hồ Chí Minh", 1.5),
    ("sai gon", "Thành phố Hồ Chí Minh", 1.5),
    ("saigon", "Thành phố Hồ Chí Minh", 1.5),
    ("sài gòn", "Thành phố Hồ Chí Minh", 1.5),
    ("hn", "Thành phố Hà Nội", 2.0),
    ("ha noi", "Thành phố Hà Nội", 1.8),
    ("hanoi", "Thành phố Hà Nội", 1.8),
    ("dn", "Thành phố Đà Nẵng", 2.0),
    ("da nang", "Thành phố Đà Nẵng", 1.8),
    ("danang", "Thành phố Đà Nẵng", 1.8),
    ("hp", "Thành phố Hải Phòng", 2.0),
    ("hai phong", "Thành phố Hải Phòng", 1.8),
    ("ct", "Thành phố Cần Thơ", 1.8),
    ("can tho", "Thành phố Cần Thơ", 1.8),
    ("qn", "Tỉnh Quảng Nam", 1.5),
    ("qng", "Tỉnh Quảng Ngãi", 1.5),
    ("qb", "Tỉnh Quảng Bình", 1.5),
    ("qt", "Tỉnh Quảng Trị", 1.5),
    ("qni", "Tỉnh Quảng Ninh", 1.5),
    ("kh", "Tỉnh Khánh Hòa", 1.5),
    ("bd", "Tỉnh Bình Dương", 1.5),
    ("bl", "Tỉnh Bình Long", 1.2),
    ("brvt", "Tỉnh Bà Rịa - Vũng Tàu", 2.0),
    ("vung tau", "Tỉnh Bà Rịa - Vũng Tàu", 1.5),
    ("vt", "Tỉnh Bà Rịa - Vũng Tàu", 1.3),
    ("ld", "Tỉnh Lâm Đồng", 1.5),
    ("dalat", "Tỉnh Lâm Đồng", 1.3),
    ("da lat", "Tỉnh Lâm Đồng", 1.3),
    ("ag", "Tỉnh An Giang", 1.5),
    ("dt", "Tỉnh Đồng Tháp", 1.5),
    ("la", "Tỉnh Long An", 1.3),
    ("tg", "Tỉnh Tiền Giang", 1.5),
    ("btre", "Tỉnh Bến Tre", 1.5),
    ("tv", "Tỉnh Trà Vinh", 1.5),
    ("vl", "Tỉnh Vĩnh Long", 1.5),
    ("hg", "Tỉnh Hậu Giang", 1.5),
    ("kg", "Tỉnh Kiên Giang", 1.5),
    ("cm", "Tỉnh Cà Mau", 1.5),
    ("st", "Tỉnh Sóc Trăng", 1.5),
    ("bg", "Tỉnh Bắc Giang", 1.5),
    ("bk", "Tỉnh Bắc Kạn", 1.5),
    ("bn", "Tỉnh Bắc Ninh", 1.5),
    ("cb", "Tỉnh Cao Bằng", 1.5),
    ("hb", "Tỉnh Hòa Bình", 1.5),
    ("hd", "Tỉnh Hải Dương", 1.5),
    ("hnam", "Tỉnh Hà Nam", 1.5),
    ("hg2", "Tỉnh Hà Giang", 1.3),
    ("ht", "Tỉnh Hà Tĩnh", 1.5),
    ("hue", "Tỉnh Thừa Thiên Huế", 1.5),
    ("tth", "Tỉnh Thừa Thiên Huế", 1.8),
    ("lang son", "Tỉnh Lạng Sơn", 1.5),
    ("ls", "Tỉnh Lạng Sơn", 1.3),
    ("lc", "Tỉnh Lai Châu", 1.5),
    ("nb", "Tỉnh Ninh Bình", 1.5),
    ("nt", "Tỉnh Ninh Thuận", 1.5),
    ("na", "Tỉnh Nghệ An", 1.5),
    ("py", "Tỉnh Phú Yên", 1.5),
    ("pt", "Tỉnh Phú Thọ", 1.5),
    ("sb", "Tỉnh Sơn La", 1.5),
    ("tbn", "Tỉnh Thái Bình", 1.5),
    ("tn", "Tỉnh Thái Nguyên", 1.5),
    ("th", "Tỉnh Thanh Hóa", 1.5),
    ("tb", "Tỉnh Tuyên Quang", 1.3),
    ("vp", "Tỉnh Vĩnh Phúc", 1.5),
    ("yb", "Tỉnh Yên Bái", 1.5),
    ("gl", "Tỉnh Gia Lai", 1.5),
    ("dak lak", "Tỉnh Đắk Lắk", 1.5),
    ("dl", "Tỉnh Đắk Lắk", 1.3),
    ("dak nong", "Tỉnh Đắk Nông", 1.5),
    ("kon tum", "Tỉnh Kon Tum", 1.5),
    ("bp", "Tỉnh Bình Phước", 1.5),
    ("bt", "Tỉnh Bình Thuận", 1.5),
    ("br", "Tỉnh Bình Phước", 1.2),
    ("dn2", "Tỉnh Đồng Nai", 1.5),
    ("tay ninh", "Tỉnh Tây Ninh", 1.5),
]

# Alias, unit type, weight.
UNIT_TYPE_ALIASES = [
    ("tp", "thành phố", 2.0),
    ("tphcm", "thành phố", 1.5),
    ("q", "quận", 2.0),
    ("qua", "quận", 1.5),
    ("h", "huyện", 1.8),
    ("hu", "huyện", 1.5),
    ("p", "phường", 2.0),
    ("phu", "phường", 1.5),
    ("x", "xã", 2.0),
    ("tx", "thị xã", 2.0),
    ("tt", "thị trấn", 2.0),
    ("kp", "khu phố", 2.0),
    ("khu", "khu phố", 1.5),
    ("dg", "đường", 2.0),
    ("d", "đường", 1.8),
    ("duong", "đường", 1.8),
    ("hxh", "hẻm", 2.0),
    ("hem", "hẻm", 2.0),
    ("ngo", "ngõ", 1.8),
    ("nga", "ngách", 1.8),
    ("tl", "tỉnh lộ", 1.8),
    ("ql", "quốc lộ", 1.8),
    ("cl", "canal", 1.3),
]

# Dates, weights, thresholds and limits.
MERGER_DATE, PRE_MERGER_LAST, PRE_MERGER_FIRST = date(2025, 7, 1), date(2025, 6, 30), date(2000, 1, 1)
W_PROVINCE, W_DISTRICT, W_WARD, BONUS_DISTRICT, BONUS_WARD = 10.0, 8.0, 6.0, 6.0, 10.0
MAX_SCORE = {"pre_merger": 40.0, "post_merger": 26.0}
ANCHOR_THRESHOLD, ANCHOR_ACCEPT, PROVINCE_THRESHOLD, CHILD_THRESHOLD, SEARCH_THRESHOLD = 0.3, 0.5, 0.1, 0.08, 0.05
FAN_OUT, KEPT, ERA_MARGIN, GEOCODER_BELOW, CLOSE_GAP = 3, 5, 0.05, 0.65, 3.0
COUNT_RANGES = {"province": (60, 70), "district": (650, 750), "ward": (10_000, 12_000)}
MIN_PROVINCE_ALIASES = 10
