"""Canonical forms of strings across scripts, as Column expressions.

Only Unicode composition (NFC) needs Python, and it is skipped for ASCII.
Null is taken as empty everywhere.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The transliteration tables and the name spellings held equal.
CONJUNCTS = {"क्ष": "ksh", "त्र": "tr", "ज्ञ": "gy", "श्र": "shr"}
VOWELS = {"अ": "a", "आ": "a", "इ": "i", "ई": "i", "उ": "u", "ऊ": "u", "ऋ": "ri", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au"}
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "ny", "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th",
    "द": "d", "ध": "dh", "न": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "w", "श": "sh", "ष": "sh", "स": "s", "ह": "h",
}
MATRAS = {"ा": "a", "ि": "i", "ी": "i", "ु": "u", "ू": "u", "ृ": "ri", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "ं": "n", "ः": "h"}
HALANT = "्"
DIGITS = {"०": "0", "१": "1", "२": "2", "३": "3", "४": "4", "५": "5", "६": "6", "७": "7", "८": "8", "९": "9"}
EQUAL_NAMES = (("prasad", "parsad"), ("kumar", "kumer"), ("kumari", "kumary"), ("bahadur", "bdr"), ("maya", "maiya"), ("laxmi", "lakshmi"), ("shrestha", "shreshtha"), ("gurung", "gurng"))
PUNCTUATION = ".,;:!?'\"()[]/\\-"

_PIECE = f"(?sU)({'|'.join([*CONJUNCTS, *CONSONANTS])})([{''.join(MATRAS)}{HALANT}\\s])?|(.)"


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_whitespace(c: Column) -> Column:
    return F.trim(F.regexp_replace(_text(c), r"(?U)[\s\x1c-\x1f]+", " "))


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_text(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


@F.pandas_udf(T.StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda s: s if s is None else unicodedata.normalize("NFC", s))


def nfc(c: Column) -> Column:
    """Composed form; ASCII needs none, so an ASCII value is sent as null."""
    other = F.when(_text(c).rlike(r"[^\x00-\x7F]"), c)
    return F.coalesce(_nfc(other), _text(c))


def strip_punctuation(c: Column) -> Column:
    return F.translate(_text(c), PUNCTUATION, " " * len(PUNCTUATION))


def has_devanagari(c: Column) -> Column:
    return _text(c).rlike(r"[\x{0900}-\x{097F}]")


def transliterate(c: Column) -> Column:
    """Devanagari to Latin, left to right with one character of look-ahead.

    A conjunct or consonant takes the sign after it; before a white space or
    the end its vowel is dropped, before anything else it is "a".
    """
    ended = F.concat(_text(c), F.lit("\n"))
    part = lambda i: F.regexp_extract_all(ended, F.lit(_PIECE), F.lit(i))
    base, sign, single = _map(CONJUNCTS | CONSONANTS), _map(MATRAS | {HALANT: ""}), _map(VOWELS | DIGITS | {HALANT: ""})
    zipped = F.arrays_zip(part(1).alias("base"), part(2).alias("sign"), part(3).alias("other"))
    piece = lambda t: F.when(
        t["base"] == "", F.coalesce(F.try_element_at(single, t["other"]), t["other"])
    ).otherwise(F.concat(F.element_at(base, t["base"]), F.when(t["sign"] == "", "a").otherwise(F.coalesce(F.try_element_at(sign, t["sign"]), t["sign"]))))
    return F.regexp_replace(F.array_join(F.transform(zipped, piece), ""), r"\n\z", "")


def _latin(c: Column) -> Column:
    composed = nfc(c)
    return F.when(has_devanagari(composed), transliterate(composed)).otherwise(composed)


def canonical_text(c: Column) -> Column:
    return F.lower(normalize_whitespace(strip_punctuation(_latin(c))))


def canonical_name(c: Column) -> Column:
    """canonical_text with each word replaced by the least of its spellings."""
    least = _map({x: min(group) for group in EQUAL_NAMES for x in group})
    return F.array_join(F.transform(F.split(canonical_text(c), " "), lambda t: F.coalesce(F.try_element_at(least, t), t)), " ")


def canonical_id(c: Column) -> Column:
    return F.regexp_replace(F.upper(nfc(c)), "[^A-Z0-9]", "")
