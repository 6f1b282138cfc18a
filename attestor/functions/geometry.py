"""Boxes (x0, y0, x1, y1 as array<double>) and detection confidences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestor.functions import dates


def round_half_even(c: Column, places: int = 1) -> Column:
    """A double rounded by its binary value, ties to even, as IEEE decimal rounding does.

    c * 10 is a sum of two doubles without error (8c + 2c and what their sum
    loses), so what lies beside a tie is told from the tie itself.
    """
    if places != 1:
        raise ValueError("only one place is supported")

    def rounded(x: Column) -> Column:
        return dates.let(
            F.struct((x * 8 + x * 2).alias("s"), x.alias("x")),
            lambda p: dates.let(
                F.struct((p["s"] - p["x"] * 8).alias("b"), F.floor(p["s"]).cast("double").alias("r"), p["s"].alias("s"), p["x"].alias("x")),
                lambda q: F.when(F.abs(q["x"]) < 1e14, (q["r"] + _up(q["s"] - q["r"] - 0.5, (q["x"] * 8 - (q["s"] - q["b"])) + (q["x"] * 2 - q["b"]), q["r"])) / 10).otherwise(q["x"]),
            ),
        )

    return dates.let(c.cast("double"), rounded)


def _up(over: Column, lost: Column, floor: Column) -> Column:
    """1 where a number over half past its floor, with what its sum lost, goes up."""
    odd = F.pmod(floor, F.lit(2.0)) == 1
    return ((over > 0) | ((over == 0) & ((lost > 0) | ((lost == 0) & odd)))).cast("double")


def scale_box(box: Column, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> Column:
    """Null parts where the source has no size."""
    x, y = F.try_divide(to_w, from_w), F.try_divide(to_h, from_h)
    return F.array(box[0] * x, box[1] * y, box[2] * x, box[3] * y)


def clamp_box(box: Column, width: Column, height: Column) -> Column:
    """x0, y0, x1, y1 clipped to a canvas; an empty side is one wide."""
    clip = lambda v, top: F.greatest(F.lit(0.0), F.least(v, top))
    x0, y0, x1, y1 = clip(box[0], width), clip(box[1], height), clip(box[2], width), clip(box[3], height)
    return F.array(x0, y0, F.when(x1 <= x0, F.least(width, x0 + 1)).otherwise(x1), F.when(y1 <= y0, F.least(height, y0 + 1)).otherwise(y1))


def crop_bounds(box: Column, width: Column, height: Column) -> Column:
    """Integer bounds, rounded half to even and clipped."""
    at = lambda v, top: F.greatest(F.lit(0), F.least(F.rint(v).cast("int"), top.cast("int")))
    return F.array(at(box[0], width), at(box[1], height), at(box[2], width), at(box[3], height))


def move(box: Column, dx: Column, dy: Column) -> Column:
    return F.when(box.isNotNull(), F.array(box[0] + dx, box[1] + dy, box[2] + dx, box[3] + dy))


def resize(box: Column, width: Column, height: Column) -> Column:
    return F.when(box.isNotNull(), F.array(box[0], box[1], box[0] + width, box[1] + height))


def _result(status: str, confidence: Column, yes: bool | None, name: str) -> Column:
    return F.struct(F.lit(yes).cast("boolean").alias(name), round_half_even(confidence).alias("confidence"), F.lit(status).alias("status"))


def detect_mark(ink: Column) -> Column:
    """checked (null: unsure), confidence and status of a mark's ink ratio."""
    hundred = F.lit(100.0)
    unsure = F.greatest(F.lit(0.0), 100 * (1 - F.abs(ink - 0.16) / 0.06))
    return F.when(ink <= 0.10, _result("UNCHECKED", 100 * (1 - ink / 0.10), False, "checked")).when(ink >= 0.22, _result("CHECKED", F.least(hundred, 100 * ink / 0.44), True, "checked")).otherwise(_result("REVIEW_REQUIRED", unsure, None, "checked"))


def detect_ink(ink: Column) -> Column:
    """Signature or thumbprint from the share of ink; null is an empty crop."""
    return (
        F.when(ink.isNull(), _result("NOT_DETECTED", F.lit(0.0), False, "present"))
        .when(ink < 0.006, _result("NOT_DETECTED", 90 + 10 * (1 - ink), False, "present"))
        .when(ink >= 0.015, _result("PRESENT", F.least(F.lit(100.0), 60 + 400 * ink), True, "present"))
        .otherwise(_result("REVIEW_REQUIRED", F.lit(40.0), False, "present"))
    )


def detect_photo(variance: Column) -> Column:
    """Photo from the variance of its grey values; null is an empty crop."""
    return (
        F.when(variance.isNull(), _result("NOT_DETECTED", F.lit(0.0), False, "present"))
        .when(variance >= 250, _result("PRESENT", F.least(F.lit(100.0), 50 + variance / 20), True, "present"))
        .when(variance < 75, _result("NOT_DETECTED", F.lit(80.0), False, "present"))
        .otherwise(_result("REVIEW_REQUIRED", F.lit(35.0), False, "present"))
    )
