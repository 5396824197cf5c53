"""A sound key of Vietnamese names: syllables whose spellings are confused by ear get one code.

A key folds what speakers of one dialect or another don't tell apart: onsets
(s/x, tr/ch, l/n, d/gi/r, c/k/q, ng/ngh, g/gh, f/ph), the nucleus y/i, the glide
o/u, and endings (n/ng/nh, t/c/ch). It comes from plain letters, so it is the same
with and without accents; the letter d with a stroke counts as d, which names in
the index can't tell apart. The tone is a class of its own, as texts mostly come
without: the two tones that are confused are one class.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

#: What becomes what in a plain lower-case name, one after the other. Codes are capitals.
SOUNDS = (
    ("y", "i"),
    (r"\bngh?", "G"), (r"\bnh", "J"), (r"\bkh", "X"), (r"\bph|\bf", "F"), (r"\bth", "T"), (r"\btr|\bch", "C"),
    (r"\bgh", "Q"), (r"\bgi([aeou])", r"Z\1"), (r"\bgi", "Zi"), (r"\bg", "Q"), (r"\b[drz]", "Z"), (r"\b[ckq]", "K"), (r"\b[sx]", "S"), (r"\b[ln]", "L"),
    (r"o([ae])", r"u\1"),
    (r"([aeiou])n[gh]\b", r"\1n"), (r"([aeiou])ch?\b", r"\1t"),
)
#: The marks of the five written tones; the third and fourth are confused.
TONES = {"̀": "1", "́": "2", "̉": "3", "̃": "3", "̣": "4"}


def plain(s: Column) -> Column:
    """Lower-case words of plain letters and digits."""
    return F.trim(F.regexp_replace(text.fold_stroke(text.to_ascii(text.drop_apostrophes(s))), "[^a-z0-9]+", " "))


def sound_key(s: Column) -> Column:
    """The codes of all syllables of a name, with blanks between; null for null, empty for a text without letters or digits."""
    out = plain(s)
    for pattern, code in SOUNDS:
        out = F.regexp_replace(out, pattern, code.replace("\\1", "$1"))
    return out


@cache
def _tone_letters() -> tuple[str, str]:
    found = [(chr(c), [TONES[x] for x in unicodedata.normalize("NFD", chr(c)) if x in TONES]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    found = [(c, t[0]) for c, t in found if t]
    return "".join(c for c, _ in found) + "".join(TONES), "".join(t for _, t in found) + "".join(TONES.values())


def tone_classes(s: Column) -> Column:
    """One class for each word: 0 without a tone mark, 1 to 4 by the mark; of several marks in a word the first counts."""
    src, dst = _tone_letters()
    words = text.tokens(F.trim(F.regexp_replace(s, r"(?U)[^\p{L}\p{N}\p{M}]+", " ")))
    digits = lambda w: F.regexp_replace(F.translate(F.regexp_replace(w, r"\p{N}", ""), src, dst), "[^1-4]", "")
    return F.array_join(F.transform(words, lambda w: F.when(digits(w) == "", "0").otherwise(F.substring(digits(w), 1, 1))), "")
