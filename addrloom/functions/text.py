"""Address text as column expressions: normalisation, variants, trigrams, house numbers, streets.

Everything here is built from Spark's own functions, so it stays in the JVM and
needs no Python worker.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dicts

WORD_OR_GAP = r"((?U)\w+|(?U)\W+)"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
SPACES = r"(?U)[\s\x{1c}-\x{1f}]+"


def _words(values: list[str]) -> Column:
    """An array of literals, given to Spark in one piece."""
    return F.expr("array(" + ", ".join(f"'{v}'" for v in values) + ")")


def _mapping(values: dict[str, str]) -> Column:
    return F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in values.items()) + ")")


@cache
def _accents() -> tuple[str, str]:
    """Characters of the basic plane that a canonical decomposition reduces to one other, and what they become."""
    found = [(chr(c), "".join(x for x in unicodedata.normalize("NFD", chr(c)) if unicodedata.category(x) != "Mn")) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]
    found = [(a, b) for a, b in found if a != b and len(b) == 1]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


def to_ascii(s: Column) -> Column:
    """Lower case without combining marks; the letter d with a stroke has none and stays."""
    src, dst = _accents()
    return F.lower(F.regexp_replace(F.translate(s, src, dst), r"\p{Mn}", ""))


def fold_stroke(s: Column) -> Column:
    """The d with a stroke as a plain d."""
    return F.translate(s, "đĐ", "dD")


def drop_apostrophes(s: Column) -> Column:
    return F.translate(s, "'\u2019\u2018\u02bc\u0060", "")


def _collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, SPACES, " "))


def expand_shorthand(s: Column) -> Column:
    """Shorthand for provinces, then for unit types, as whole words.

    The dictionaries allow three steps in place of a rescan for each entry: the one
    key of two words, numbered districts with a stop, then all words at once.
    """
    s = F.regexp_replace(s, r"(?U)\bvung tau\b", dict(dicts.PROVINCES)["vung tau"])
    s = F.regexp_replace(s, r"(?U)\bq\.(1[0-2]|[1-9])\b", "quan $1")
    words = {k: v for k, v in dicts.PROVINCES if " " not in k} | dict(dicts.UNIT_TYPES) | {f"q{i}": f"quan {i}" for i in dicts.DISTRICT_NUMBERS}
    table = _mapping(words)
    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(WORD_OR_GAP), F.lit(0)), lambda w: F.coalesce(F.element_at(table, w), w)), "")


def normalize(s: Column, compat: bool = True) -> Column:
    """Plain lower-case text with shorthand expanded. Without ``compat`` the d with a stroke becomes d too."""
    s = drop_apostrophes(F.translate(s, ZERO_WIDTH, ""))
    s = to_ascii(s) if compat else fold_stroke(to_ascii(s))
    return _collapse(expand_shorthand(_collapse(F.regexp_replace(s, "[,/\\-\u2013\u2014]+", " "))))


def tokens(s: Column) -> Column:
    return F.filter(F.split(s, " "), lambda w: w != "")


def _structural() -> Column:
    return _words(dicts.STRUCTURAL)


def strip_structural(s: Column) -> Column:
    """Without words of unit types; unchanged if nothing would be left."""
    kept = F.filter(tokens(s), lambda w: ~F.array_contains(_structural(), w))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(s)


def ngrams(words: Column, n: int) -> Column:
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, n), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def variants(s: Column) -> Column:
    """The text, the text without structural words, its names, and its runs of two to four words; first seen first."""
    words = tokens(s)
    names = F.filter(words, lambda w: (F.length(w) >= 2) & ~F.array_contains(_structural(), w))
    every = F.concat(F.array(s, strip_structural(s)), names, ngrams(words, 2), ngrams(words, 3), ngrams(words, 4))
    return F.array_distinct(F.filter(F.transform(every, lambda v: F.trim(v)), lambda v: v != ""))


def without_parent(of: Column, parent_name: Column) -> Column:
    """Variants with a word that the parent's name lacks; all of them if none has."""
    own = tokens(F.lower(parent_name))
    kept = F.filter(of, lambda v: F.size(F.array_except(tokens(F.lower(v)), own)) > 0)
    return F.when(F.size(kept) > 0, kept).otherwise(of)


def trigrams(s: Column) -> Column:
    """The set of trigrams of the words, each with two blanks before and one after."""
    words = F.filter(F.split(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))))


def trigram_codes(s: Column) -> Column:
    """The set of trigrams as numbers, made of the three characters' code points."""
    place = lambda g, i: F.ascii(F.substring(g, i, 1)).cast("bigint")
    return F.transform(trigrams(s), lambda g: F.shiftleft(place(g, 1), 42) + F.shiftleft(place(g, 2), 21) + place(g, 3))


def overlap(shared: Column, a: Column, b: Column) -> Column:
    """Shared trigrams over all, as a 4-byte float; 0 if there are none."""
    return F.when(a + b > shared, shared / (a + b - shared)).when(shared > 0, F.lit(1.0)).otherwise(F.lit(0.0)).cast("float")


def similarity(a: Column, b: Column) -> Column:
    """Trigram similarity of two texts."""
    x, y = trigrams(a), trigrams(b)
    return overlap(F.size(F.array_intersect(x, y)), F.size(x), F.size(y))


def read_back(score: Column) -> Column:
    """A 4-byte float as the double of its shortest decimal form."""
    return score.cast("string").cast("double")


HOUSE = "(?iU)" + dicts.HOUSE


def house_match(s: Column) -> Column:
    """The longest house number with its prefix; the first of equally long ones."""
    found = F.regexp_extract_all(s, F.lit(HOUSE), F.lit(0))
    longer = lambda a, m: F.when(F.length(F.trim(m)) > F.length(F.trim(a)), m).otherwise(a)
    best = F.aggregate(found, F.lit(""), longer)
    return F.when(best != "", best)


def house_number(s: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(house_match(s), HOUSE, 1), F.lit("")))


def without_house_number(s: Column) -> Column:
    """The text with the chosen match as a blank."""
    m = house_match(s)
    edge = F.when(F.lower(m).startswith("s"), F.lit(r"(?U)\b")).otherwise(F.lit(""))
    rest = F.array_join(F.split(s, F.concat(edge, F.lit(r"\Q"), m, F.lit(r"\E")), F.lit(2)), " ")
    return F.when(m.isNull(), s).otherwise(_collapse(rest))


def street(s: Column, names: Column) -> Column:
    """What the structural words and the matched units' names (an array, nulls allowed) leave, with shorthand expanded."""
    parts = F.transform(F.array_compact(names), lambda n: tokens(F.lower(n)))
    gone = F.concat(_structural(), F.flatten(parts), F.transform(parts, lambda p: F.array_join(p, "")))
    kept = F.filter(tokens(s), lambda w: (F.length(w) > 1) & ~F.array_contains(gone, w))
    table = _mapping(dict(dicts.STREETS))
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda w: F.coalesce(F.element_at(table, w), w)), " "))


def is_place_name(s: Column) -> Column:
    # The text is lowered once, not for every word.
    return F.transform(F.array(F.lower(s)), lambda x: F.exists(_words(dicts.PLACE_WORDS), lambda k: F.contains(x, k)))[0]


def unit_type_of(prefix: Column) -> Column:
    """The unit type that a prefix names; an unknown one is an error."""
    key = F.lower(F.trim(prefix))
    out = None
    for kind, known in dicts.PREFIXES.items():
        out = F.when(key.isin(known), kind) if out is None else out.when(key.isin(known), kind)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown prefix: "), prefix)).cast("string"))


def split_prefix(full: Column) -> tuple[Column, Column]:
    """(prefix, name) of a full name at the longest known prefix; ("", full name) if none is there."""
    pattern = "^(" + "|".join(sorted(dicts.FULL_PREFIXES, key=len, reverse=True)) + ") "
    prefix = F.regexp_extract(full, pattern, 1)
    return prefix, F.when(prefix == "", full).otherwise(F.substring(full, F.length(prefix) + 2, F.length(full)))


def index_name(name: Column) -> Column:
    """The plain lower-case form under which new units are found."""
    return F.lower(fold_stroke(to_ascii(F.translate(name, "'\u2019\u02bc", ""))))


def code_fences_off(s: Column) -> Column:
    """A reply without the fences of a code block around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", ""))


def reply_address(s: Column) -> Column:
    """The address of a reply: its JSON field, or the whole reply if that is no JSON and has at most 300 characters."""
    plain = code_fences_off(s)
    json = F.try_parse_json(plain)
    return F.when(json.isNotNull(), F.nullif(F.trim(F.get_json_object(plain, "$.address")), F.lit(""))).when((F.length(plain) <= 300) & (plain != ""), plain)


def join_parts(parts: Column, fallback: Column) -> Column:
    """The known parts of an address, once each and in order, with commas; the fallback if there are none."""
    known = F.array_distinct(F.filter(F.array_compact(parts), lambda p: F.trim(p) != ""))
    return F.when(F.size(known) > 0, F.array_join(known, ", ")).otherwise(fallback)
