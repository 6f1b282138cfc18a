"""Marks of option groups: detection, double marks, the chosen option."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestor.functions import geometry


def detect(options: DataFrame, *group: str) -> DataFrame:
    """Adds checked, confidence, status to options (group, position, ink_ratio).

    Of several checked options of a group the one with most ink (then the
    first) stays; the others go to review, their confidence kept.
    """
    rows = options.withColumn("_m", geometry.detect_mark(F.col("ink_ratio"))).select("*", "_m.*").drop("_m")
    by = Window.partitionBy(*group).orderBy(F.col("checked").eqNullSafe(True).desc(), F.desc("ink_ratio"), "position")
    weaker = F.col("checked") & (F.col("_rank") > 1)
    rows = rows.withColumn("_rank", F.row_number().over(by))
    return rows.withColumn("status", F.when(weaker, "REVIEW_REQUIRED").otherwise(F.col("status"))).withColumn("checked", F.when(weaker, F.lit(None)).otherwise(F.col("checked"))).drop("_rank")


def chosen(marks: DataFrame, *group: str) -> DataFrame:
    """The value of each group: its first checked option, else REVIEW_REQUIRED
    if one is ambiguous, else empty; and all options as a map."""
    first = F.min_by(F.when(F.col("checked"), F.col("option")), F.when(F.col("checked"), F.col("position")))
    return marks.groupBy(*group).agg(
        F.when(F.bool_or("checked"), first).when(F.bool_or(F.col("status") == "REVIEW_REQUIRED"), "REVIEW_REQUIRED").otherwise("").alias("value"),
        F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct("position", "option", "checked"))), lambda s: F.struct(s["option"], s["checked"]))).alias("options"),
    )
