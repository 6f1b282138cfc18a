"""Redaction, slugs and small formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of fields that are redacted.
SENSITIVE = ("citizenship_number", "citizenship_no", "national_id_no", "passport_no", "pan_number", "id_number", "id_no", "dob", "date_of_birth")


# Codes of the language packs for a region's language.
LANGUAGES = {"english": "eng", "nepali": "nep", "mixed": "eng+nep"}


def language_code(name: str | None, installed: frozenset[str] | None = None) -> str:
    """The packs of a language by name, ``eng`` if one is not installed (None: not known)."""
    code = LANGUAGES.get(name or "english", "eng")
    return code if installed is None or installed.issuperset(code.split("+")) else "eng"


def redact(c: Column, keep: int = 2) -> Column:
    """Stars but for ``keep`` characters at either end; short values all stars."""
    text = F.coalesce(c, F.lit(""))
    n = F.length(text)
    stars = lambda k: F.repeat(F.lit("*"), k)
    return F.when(n <= 2 * keep, stars(n)).otherwise(F.concat(F.substring(text, 1, keep), stars(n - 2 * keep), F.right(text, F.lit(keep))))


def redact_field(name: Column, c: Column) -> Column:
    return F.when(F.lower(name).isin(*SENSITIVE), redact(c)).otherwise(c)


def option_slug(c: Column) -> Column:
    return F.translate(F.lower(c), " .", "_")


def bytes_to_human(c: Column) -> Column:
    out = F.format_string("%.1fTB", c / 1024.0**4)
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(c / 1024.0**power < 1024, F.format_string(f"%.0f{unit}", c / 1024.0**power)).otherwise(out)
    return out


def new_id(prefix: str = "roi") -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 8))


def confidence_badge(confidence: Column, threshold: Column) -> Column:
    return F.when(confidence.isNull(), "").otherwise(F.concat(F.format_string("%.0f%%", confidence), F.when(confidence < threshold, " ⚠").otherwise("")))


def resolve_language(code: Column, installed: list[str]) -> Column:
    """``eng+nep`` style codes; a missing pack falls back to ``eng``."""
    missing = F.array_except(F.split(code, r"\+"), F.array(*map(F.lit, installed)))
    return F.when(F.size(missing) > 0, "eng").otherwise(code)
