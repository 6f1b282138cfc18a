"""Validation of record pairs: outcomes by field, and one status for a pair.

Values come in long form (pair_id, field, value); a field map says which
fields are compared, how, and how much they matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.functions import dates, match

# The default field map and the verdicts by kind.
FIELD_MAP = (
    ("full_name", "applicant_1_name", "NAME", "CRITICAL"),
    ("citizenship_number", "citizenship_no_applicant_1", "TEXT", "CRITICAL"),
    ("dob_bs", "dob_applicant_1", "DATE", "CRITICAL"),
    ("gender", "gender_applicant_1", "TEXT", "IMPORTANT"),
    ("father_name", "family_father_name", "NAME", "IMPORTANT"),
    ("permanent_address_district", "permanent_district", "ADDRESS", "IMPORTANT"),
    ("issuing_office_and_district", "citizenship_issue_district_applicant_1", "TEXT", "CRITICAL"),
)
MAP_COLUMNS = {"position": "int", "certificate_field": "string", "form_field": "string", "field_type": "string", "priority": "string"}
#: Most rows of a field map.
MAP_ROWS = 1000
MATCHED, REVIEW, MISMATCH, MISSING = ("MATCH", "EXACT_MATCH", "NORMALIZED_MATCH"), ("PROBABLE_MATCH", "REVIEW_REQUIRED"), ("MISMATCH",), ("UNREADABLE",)


def default_field_map(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(FIELD_MAP)]
    return spark.createDataFrame(rows, "position int, certificate_field string, form_field string, field_type string, priority string")


def map_rows(field_map: DataFrame) -> list:
    """The rows of a field map, in order, with their matchers.  It is a configuration and stands in
    the plan, so one of more than MAP_ROWS rows is an error."""
    kind = match.matcher_of(F.col("form_field"), F.col("field_type")).alias("kind")
    rows = field_map.select("position", "certificate_field", "form_field", "field_type", "priority", kind).orderBy("position").limit(MAP_ROWS + 1).collect()
    if len(rows) > MAP_ROWS:
        raise ValueError(f"a field map has at most {MAP_ROWS} rows")
    return rows


def pairs(certificate: DataFrame, form: DataFrame, field_map: DataFrame) -> DataFrame:
    """One row for each pair and map row, with "" where a value is missing.

    The values of mapped fields meet by pair in one shuffle; map rows are put
    beside them from a literal.  Of repeated values of a field the greatest holds.
    """
    return _pairs(certificate, form, map_rows(field_map))


def _pairs(certificate: DataFrame, form: DataFrame, chosen: list) -> DataFrame:
    sides = ((0, certificate, "certificate_field"), (1, form, "form_field"))
    # of fields that no row maps, only the pair is kept
    parts = [rows.select("pair_id", F.when(F.col("field").isin(sorted({r[name] for r in chosen})), F.struct(F.lit(side).alias("side"), "field", "value")).alias("v")) for side, rows, name in sides]
    values = parts[0].unionByName(parts[1]).groupBy("pair_id").agg(F.sort_array(F.collect_set("v"), asc=False).alias("_values"))
    fields = F.array(*(F.struct(*(F.lit(r[c]).cast(t).alias(c) for c, t in MAP_COLUMNS.items())) for r in chosen))
    value = lambda side, name: F.coalesce(F.get(F.filter("_values", lambda v: (v["side"] == side) & (v["field"] == F.col(f"_m.{name}")) & v["value"].isNotNull()), 0)["value"], F.lit(""))
    rows = values.withColumn("_m", F.explode(fields))
    return rows.select("pair_id", "_m.*", value(0, "certificate_field").alias("value_a"), value(1, "form_field").alias("value_b"))


def matchers(field_map: DataFrame) -> tuple[str, ...]:
    """The matchers that a field map needs, of the five there are."""
    return tuple(sorted({r["kind"] for r in map_rows(field_map)}))


def outcomes(rows: DataFrame, as_of_year: int, kinds: tuple[str, ...] = match.KINDS, months: DataFrame | None = None, start: str | None = None) -> DataFrame:
    """Adds result, confidence and detail by the field's matcher.

    With a table of months that begins on ``start``, BS dates are resolved.
    """
    parsed, kept = None, rows.columns
    if months is not None and "date" in kinds:
        dated = match.matcher_of(F.col("form_field"), F.col("field_type")) == "date"
        for side in ("a", "b"):
            rows = dates.resolve(rows.withColumn(f"_{side}", F.when(dated, dates.parse(F.col(f"value_{side}"), as_of_year))), f"_{side}", months, start)
        parsed = (F.col("_a"), F.col("_b"))
    found = rows.withColumn("_o", match.match_field(F.col("form_field"), F.col("field_type"), F.col("value_a"), F.col("value_b"), as_of_year, kinds, parsed))
    return found.select(*kept, "_o.*")


def status(critical_mismatch: Column, missing: Column, review: Column, mismatch: Column) -> Column:
    return F.when(critical_mismatch, "MISMATCH").when(missing > 0, "INCOMPLETE").when((review > 0) | (mismatch > 0), "PASS WITH REVIEW").otherwise("PASS")


def summarize(found: DataFrame, *keys: str) -> DataFrame:
    """Counts by kind of verdict and the overall status of each key.

    A form field (form_field; without it, each row is one) is critical if one
    of its map rows is.
    """
    count = lambda kinds: F.count_if(F.col("result").isin(*kinds))
    is_critical, differs = F.col("priority") == "CRITICAL", F.col("result").isin(*MISMATCH)
    if "form_field" in found.columns:
        critical = F.arrays_overlap(F.collect_set(F.when(is_critical, F.col("form_field"))), F.collect_set(F.when(differs, F.col("form_field"))))
    else:
        critical = F.coalesce(F.bool_or(is_critical & differs), F.lit(False))
    totals = found.groupBy(*keys).agg(
        F.count("*").alias("total"), count(MATCHED).alias("matched"), count(REVIEW).alias("needs_review"), count(MISMATCH).alias("mismatched"), count(MISSING).alias("missing"),
        critical.alias("_critical"),
    )
    return totals.withColumn("overall_status", status(F.col("_critical"), F.col("missing"), F.col("needs_review"), F.col("mismatched"))).drop("_critical")


def run_validation(certificate: DataFrame, form: DataFrame, as_of_year: int, field_map: DataFrame | None = None, months: DataFrame | None = None, start: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(outcomes, summary) of all pairs; without a map, or with an empty one,
    the default one holds.  months (bs_year, bs_month, n_days) from the day
    ``start`` on resolves BS dates, which else go to review."""
    chosen = [] if field_map is None else map_rows(field_map)
    chosen = chosen or map_rows(default_field_map(certificate.sparkSession))
    found = outcomes(_pairs(certificate, form, chosen), as_of_year, tuple(sorted({r["kind"] for r in chosen})), months, start)
    return found, summarize(found, "pair_id")
