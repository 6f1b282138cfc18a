"""Validation of records as they stream in.

Outcomes are stateless and append; the summary of a pair is a windowed
aggregate whose state a watermark bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.operators import validate


def outcomes(stream: DataFrame, field_map: DataFrame, as_of_year: int) -> DataFrame:
    """Outcomes of streamed rows (pair_id, form_field, value_a, value_b, ts)."""
    rows = stream.join(field_map.select("form_field", "field_type", "priority"), "form_field")
    return validate.outcomes(rows, as_of_year)


def summaries(found: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and status of each pair and window of time, late rows within the delay."""
    return validate.summarize(found.withWatermark("ts", delay).withColumn("window", F.window("ts", width)), "pair_id", "window")
