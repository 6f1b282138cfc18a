"""Verdicts on a pair of values: structs of result, confidence and detail.

Everything but the similarity of unequal strings is native; that one is a
pandas UDF (Ratcliff-Obershelp, asymmetric: the first value stays first) and
gets only pairs whose canonical forms differ; pairs that come again (a name and a
text of one form, usual values) are remembered by the process, the last 65,536.
"""

from __future__ import annotations

import difflib
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestor.functions import dates
from attestor.functions.normalize import canonical_id, canonical_name, canonical_text, strip

# Thresholds, translated value groups, dispatch keywords, details.
NAME_BANDS, TEXT_BANDS = (0.90, 0.75, 0.55), (0.92, 0.78, 0.55)
VALUE_GROUPS = (("male", "पुरुष", "m"), ("female", "महिला", "स्त्री", "f"), ("others", "अन्य", "other"), ("yes", "छ", "हो", "y"), ("no", "छैन", "होइन", "n"), ("married", "विवाहित"), ("single", "अविवाहित", "एकल"))
ID_WORDS = ("citizenship_no", "citizenship_number", "national_id", "pan_number", "pan_no", "passport_no")
ENUM_WORDS = ("gender", "marital", "sex")
EMPTY = "One or both values are empty/unread."
EXACT = "Exact match after normalization."
TRANSLATED, NO_CHARACTERS = "Matched via translated value equivalence.", "Could not extract digits/letters."
NORMALIZED, DIFFERENT_IDS = "Matches once spacing/hyphenation/case differences are removed.", "Identifiers do not match."
NO_DATE, UNSURE_DATE = "Could not parse one or both dates.", "BS date could not be confidently resolved to AD (out of supported range) or dates differ by ~1 day."
NAME_DETAILS = ("High similarity after transliteration/normalization.", "Likely the same name, but not close enough to auto-confirm.", "Partial similarity only -- needs human review.", "Names do not appear to correspond.")


def outcome(result: str | Column, confidence: float | Column, detail: str | None = None) -> Column:
    lit = lambda x, t: (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return F.struct(lit(result, "string").alias("result"), lit(confidence, "double").alias("confidence"), lit(detail, "string").alias("detail"))


@lru_cache(1 << 16)
def _ratio(x: str, y: str) -> float:
    return difflib.SequenceMatcher(None, x, y).ratio() if x and y else float(not x and not y)


@F.pandas_udf(T.StructType([T.StructField("ratio", T.DoubleType()), T.StructField("confidence", T.DoubleType())]))
def _similarity(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    ratio = [None if x is None or y is None else _ratio(x, y) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame({"ratio": ratio, "confidence": [None if r is None else round(r * 100, 1) for r in ratio]})


def similarity(a: Column, b: Column) -> Column:
    """ratio and its rounded percentage; null where the two are equal."""
    return _similarity(F.when(a != b, a), F.when(a != b, b))


def empty(a: Column, b: Column) -> Column:
    return (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")


def _fuzzy(a: Column, b: Column, x: Column, y: Column, bands: tuple, details: tuple) -> Column:
    s = similarity(F.when(~empty(a, b), x), y)
    result = outcome("MISMATCH", s["confidence"], details[3])
    for band, verdict, detail in reversed(list(zip(bands, ("MATCH", "PROBABLE_MATCH", "REVIEW_REQUIRED"), details, strict=False))):
        result = F.when(s["ratio"] >= band, outcome(verdict, s["confidence"], detail)).otherwise(result)
    return F.when(empty(a, b), outcome("REVIEW_REQUIRED", 0.0, EMPTY)).when(x == y, outcome("MATCH", 99.0, EXACT)).otherwise(result)


def match_name(a: Column, b: Column) -> Column:
    return _fuzzy(a, b, canonical_name(a), canonical_name(b), NAME_BANDS, NAME_DETAILS)


def match_text(a: Column, b: Column) -> Column:
    return _fuzzy(a, b, canonical_text(a), canonical_text(b), TEXT_BANDS, (None,) * 4)


def value_group(c: Column) -> Column:
    pairs = [F.lit(x) for i, group in enumerate(VALUE_GROUPS) for v in group for x in (v, i)]
    return F.try_element_at(F.create_map(*pairs), F.lower(strip(c)))


def match_enum(a: Column, b: Column, otherwise: Column | None = None) -> Column:
    """Translated values; unknown ones are compared as text (or ``otherwise``)."""
    x, y = value_group(a), value_group(b)
    rest = match_text(a, b) if otherwise is None else otherwise
    return (
        F.when(empty(a, b), outcome("REVIEW_REQUIRED", 0.0, EMPTY))
        .when(x == y, outcome("MATCH", 95.0, TRANSLATED))
        .when(x.isNotNull() & y.isNotNull(), outcome("MISMATCH", 0.0)).otherwise(rest)
    )


def match_id(a: Column, b: Column) -> Column:
    x, y = canonical_id(a), canonical_id(b)
    return (
        F.when(empty(a, b), outcome("UNREADABLE", 0.0, EMPTY))
        .when((x == "") | (y == ""), outcome("UNREADABLE", 0.0, NO_CHARACTERS))
        .when(strip(a) == strip(b), outcome("EXACT_MATCH", 100.0))
        .when(x == y, outcome("NORMALIZED_MATCH", 92.0, NORMALIZED))
        .otherwise(outcome("MISMATCH", 0.0, DIFFERENT_IDS))
    )


def match_date(a: Column, b: Column, as_of_year: int, hint_a: Column | None = None, hint_b: Column | None = None) -> Column:
    return match_parsed_dates(dates.parse(a, as_of_year, hint_a), dates.parse(b, as_of_year, hint_b))


def match_parsed_dates(x: Column, y: Column) -> Column:
    def judged(p: Column) -> Column:
        failed = p["x"]["error"].isNotNull() | p["y"]["error"].isNotNull()
        return F.struct(dates.equivalent(p["x"], p["y"]).alias("verdict"), F.coalesce(failed, F.lit(False)).alias("failed"))

    def told(j: Column) -> Column:
        confidence = F.when(j["verdict"] == "MATCH", 97.0).when(j["verdict"] == "REVIEW_REQUIRED", 40.0).otherwise(0.0)
        detail = F.when(j["verdict"] == "UNREADABLE", NO_DATE).when((j["verdict"] == "REVIEW_REQUIRED") & j["failed"], UNSURE_DATE)
        return F.struct(j["verdict"].alias("result"), confidence.alias("confidence"), detail.alias("detail"))

    return dates.let(dates.let(F.struct(x.alias("x"), y.alias("y")), judged), told)


def matcher_of(field: Column, field_type: Column) -> Column:
    """Which matcher a field takes: name, date, id, enum or text."""
    name = F.lower(field)
    return F.when(field_type == "NAME", "name").when(field_type == "DATE", "date").when(name.rlike("|".join(ID_WORDS)), "id").when(name.rlike("|".join(ENUM_WORDS)), "enum").otherwise("text")


KINDS = ("name", "date", "id", "enum", "text")


def match_field(field: Column, field_type: Column, a: Column, b: Column, as_of_year: int, kinds: tuple[str, ...] = KINDS, parsed: tuple[Column, Column] | None = None) -> Column:
    """The outcome by the field's matcher; dates may come parsed already.

    Only the matchers named in ``kinds`` are built; a matcher that a row does
    not take gets null, so that its UDF has nothing to do there.
    """
    kind = matcher_of(field, field_type)
    only = lambda *k: F.when(kind.isin(*k), a)
    text = match_text(only("text", "enum"), b) if {"text", "enum"} & set(kinds) else None
    made = {"name": lambda: match_name(only("name"), b), "date": lambda: match_parsed_dates(*parsed) if parsed else match_date(a, b, as_of_year), "id": lambda: match_id(a, b), "enum": lambda: match_enum(a, b, text), "text": lambda: text}
    out = F.lit(None).cast("struct<result: string, confidence: double, detail: string>")
    for k in reversed(KINDS):
        if k in kinds:
            out = F.when(kind == k, made[k]()).otherwise(out)
    return out
