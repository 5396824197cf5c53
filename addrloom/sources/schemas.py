"""Schemas of the engine's tables, as DDL."""

from __future__ import annotations

from addrloom.functions import dicts

ADMIN_UNITS = (
    "id bigint, gso_code string, full_name string, name string, name_prefix string, unit_type string, ascii_name string, parent_id bigint, "
    "valid_from date, valid_to date, era string, aliases array<string>, embedding array<float>, created_at timestamp, updated_at timestamp"
)
ALIASES = "alias string, canonical string, alias_type string, unit_id bigint, weight double"
ADMIN_UNIT_MERGERS = "old_unit_id bigint, new_unit_id bigint, effective_date date, decree_ref string, notes string"
STREETS = "name string, ascii_name string, ward_id bigint, district_id bigint, province_id bigint, osm_id bigint, aliases array<string>, popularity_score double"
POSTAL_CODES = "code string, ward_id bigint, district_id bigint, province_id bigint"
OCR_CONFUSIONS = "wrong_token string, corrected_token string, frequency int"
CORRECTION_LOGS = "raw_input string, predicted_address string, corrected_address string, confidence double, reviewer string, created_at timestamp"
POI = "query_key string, address string, display_name string, source string, reasoning string, lat double, lon double"
ADDRESSES = "addr_id bigint, raw_input string, as_of_date date, use_geocoder boolean"
POST_MERGER_JSON = "Code string, FullName string, Wards array<struct<Code: string, FullName: string>>"

#: Columns of a unit that the engine itself computes; the rest of ADMIN_UNITS is filled on write.
UNIT_COLUMNS = ("gso_code", "full_name", "name", "name_prefix", "unit_type", "ascii_name", "parent_gso_code", "valid_from", "valid_to", "era")
UNIT_TYPES = tuple(dicts.PREFIXES)
