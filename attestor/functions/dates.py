"""Dates of two calendars as structs: calendar, y, m, d, ad_date, error.

The month lengths of the second calendar (BS) come from a table (bs_year,
bs_month, n_days) with the date of its first day; without the table a BS date
stays unresolved, and comparisons with it go to review.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def parse(c: Column, as_of_year: int, hint: Column | None = None) -> Column:
    """A struct, or null where the text is no date.

    An unmarked year in 2000..2100 more than 30 years after ``as_of_year`` is
    taken as BS.
    """
    first, last = r"^(\d{4})[/.\-](\d{1,2})[/.\-](\d{1,2})$", r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})$"
    unmarked = hint if hint is not None else F.lit(None).cast("string")

    def cleaned(raw: Column) -> Column:
        bare = F.regexp_replace(raw, r"(?i)\b[ab]\.?\s*[sd]\.?\b", "")
        marked = F.when(raw.rlike(r"(?i)b\.s|\bBS\b"), "BS").when(raw.rlike(r"(?i)a\.d|\bAD\b"), "AD").otherwise(unmarked)
        return F.struct(F.trim(F.regexp_replace(bare, r"[^0-9/.\-]", ""), F.lit(" ./-")).alias("text"), marked.alias("calendar"))

    def parts(c: Column) -> Column:
        part = lambda i: F.when(c["text"].rlike(first), F.regexp_extract(c["text"], first, i)).when(c["text"].rlike(last), F.regexp_extract(c["text"], last, 4 - i)).cast("int")
        return F.struct(c["calendar"].alias("calendar"), part(1).alias("y"), part(2).alias("m"), part(3).alias("d"))

    def dated(p: Column) -> Column:
        calendar = F.coalesce(p["calendar"], F.when(p["y"].between(2000, 2100) & (p["y"] - as_of_year > 30), "BS").otherwise("AD"))
        ad = F.when(p["y"] >= 1, F.try_to_timestamp(F.concat_ws("-", p["y"], p["m"], p["d"]), F.lit("y-M-d")).cast("date"))
        return F.struct(calendar.alias("calendar"), p["y"].alias("y"), p["m"].alias("m"), p["d"].alias("d"), ad.alias("ad_date"))

    def checked(t: Column) -> Column:
        ad = F.when(t["calendar"] == "AD", t["ad_date"])
        error = F.when(t["calendar"] == "BS", "calendar table needed").when(ad.isNull(), "no such day")
        return F.when(t["y"].isNotNull(), F.struct(t["calendar"].alias("calendar"), t["y"].alias("y"), t["m"].alias("m"), t["d"].alias("d"), ad.alias("ad_date"), error.alias("error")))

    return let(let(let(let(F.trim(F.coalesce(c, F.lit(""))), cleaned), parts), dated), checked)


def resolve(rows: DataFrame, column: str, months: DataFrame, start: str) -> DataFrame:
    """Fill ad_date of BS dates in a struct column from a table of months
    (bs_year, bs_month, n_days; a few thousand rows) that begins on ``start``."""
    firsts = months.select(F.col("bs_year").alias("_y"), F.col("bs_month").alias("_m"), F.col("n_days").alias("_n"), F.expr(f"date_add(DATE '{start}', CAST(sum(n_days) OVER (ORDER BY bs_year, bs_month) - n_days AS INT))").alias("_first"))
    c = F.col(column)
    found = rows.join(firsts, (c["calendar"] == "BS") & (c["y"] == F.col("_y")) & (c["m"] == F.col("_m")), "left")
    ad = F.when((c["d"] >= 1) & (c["d"] <= F.col("_n")), F.date_add("_first", c["d"] - 1))
    filled = F.when(c["calendar"] == "BS", c.withField("ad_date", ad).withField("error", F.when(ad.isNull(), "no such day"))).otherwise(c)
    return found.withColumn(column, filled).drop("_y", "_m", "_n", "_first")


def ad_to_bs(rows: DataFrame, column: str, months: DataFrame, start: str) -> DataFrame:
    """Adds bs_year, bs_month, bs_day of a date column; null outside the table."""
    total = F.expr(f"date_add(DATE '{start}', CAST(sum(n_days) OVER (ORDER BY bs_year, bs_month) - n_days AS INT))")
    firsts = months.select("bs_year", "bs_month", "n_days", total.alias("_first"))
    month = lambda c: F.year(c) * 12 + F.month(c)
    last = F.date_add("_first", F.col("n_days") - 1)
    firsts = firsts.withColumn("_month", F.explode(F.sequence(month("_first"), month(last))))  # an equi-join on the months it touches
    inside = (month(column) == F.col("_month")) & F.col(column).between(F.col("_first"), last)
    return rows.join(firsts, inside, "left").withColumn("bs_day", F.datediff(column, "_first") + 1).drop("_first", "n_days", "_month")


def equivalent(a: Column, b: Column, tolerance: int = 0) -> Column:
    days = F.abs(F.datediff(a["ad_date"], b["ad_date"]))
    return (
        F.when(a.isNull() | b.isNull(), "UNREADABLE")
        .when(a["ad_date"].isNull() | b["ad_date"].isNull(), "REVIEW_REQUIRED")
        .when(days <= tolerance, "MATCH").when(days <= 2, "REVIEW_REQUIRED").otherwise("MISMATCH")
    )
