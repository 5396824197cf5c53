"""SQL text for DuckDB, from which the queries' oracles are put together."""

from __future__ import annotations

from addrloom.functions import dicts

STRUCT = "[" + ", ".join(f"'{w}'" for w in dicts.STRUCTURAL) + "]"
HOUSE = "(?i)" + dicts.HOUSE


def trigrams(x: str) -> str:
    return (
        f"list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), "
        f"lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
    )


def overlap(a: str, b: str) -> str:
    """Similarity of two trigram lists, as a 4-byte float."""
    both = f"len(list_intersect({a}, {b}))"
    return f"CAST(CASE WHEN len({a}) + len({b}) > {both} THEN {both} / (len({a}) + len({b}) - {both}) WHEN {both} > 0 THEN 1 ELSE 0 END AS FLOAT)"


def read_back(x: str) -> str:
    return f"CAST(CAST({x} AS VARCHAR) AS DOUBLE)"


def tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def normalize(x: str) -> str:
    """One replacement after the other for every shorthand; for texts whose letters are ASCII once accents go."""
    x = f"lower(strip_accents(regexp_replace({x}, '[''`‘’ʼ​‌‍﻿]', '', 'g')))"
    x = f"trim(regexp_replace(regexp_replace({x}, '[,/\\-–—]+', ' ', 'g'), '\\s+', ' ', 'g'))"
    units = dict(dicts.UNIT_TYPES) | {f"q{i}": f"quan {i}" for i in dicts.DISTRICT_NUMBERS} | {f"q\\.{i}": f"quan {i}" for i in dicts.DISTRICT_NUMBERS}
    for table in (dict(dicts.PROVINCES), units):
        for key in sorted(table, key=lambda k: len(k.replace("\\", "")), reverse=True):
            x = f"regexp_replace({x}, '\\b{key}\\b', '{table[key]}', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def variants(x: str, t: str) -> str:
    """Variants of the text ``x`` whose words are the list ``t``, as a list without order."""
    kept = f"list_filter({t}, lambda w: NOT list_contains({STRUCT}, w))"
    runs = lambda n: f"list_transform(range(1, greatest(len({t}) - {n} + 2, 1)), lambda i: array_to_string({t}[i:i+{n - 1}], ' '))"
    plain = f"[{x}, CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, ' ') ELSE {x} END]"
    names = f"list_filter({kept}, lambda w: length(w) >= 2)"
    return f"list_distinct(list_filter({plain} || {names} || {runs(2)} || {runs(3)} || {runs(4)}, lambda v: trim(v) <> ''))"


def house(x: str) -> str:
    """The longest match of a house number, the first of equally long ones; null if there is none."""
    return f"list_reduce(nullif(regexp_extract_all({x}, '{HOUSE}', 0), []), lambda a, b: CASE WHEN length(trim(b)) > length(trim(a)) THEN b ELSE a END)"


def values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS t({names})"
