"""Builders of the calendar, user and book dimensions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions import labels, text
from tallybook.functions.dates import date_id
from tallybook.operators.cleaning import null_out

# The default calendar range.
CALENDAR_START = date(2020, 1, 1)
CALENDAR_END = date(2030, 12, 31)


def _calendar(days: DataFrame, style: str, fiscal: str) -> DataFrame:
    d = F.col("full_date")
    base = days.select(
        date_id(d).alias("date_id"),
        d,
        F.year(d).alias("year"),
        F.month(d).alias("month"),
        F.dayofmonth(d).alias("day"),
        F.quarter(d).alias("quarter"),
    )
    names = {
        "day_name": F.date_format(d, "EEEE"),
        "month_name": F.date_format(d, "MMMM"),
        "is_weekend": F.weekday(d) >= 5,
    }
    if style == "sun0":
        return base.withColumns({"day_of_week": F.dayofweek(d) - 1, **names})
    if style != "mon1":
        raise ValueError(f"style must be 'sun0' or 'mon1', got {style!r}")

    before_april = F.col("month") < 4
    if fiscal == "calendar":
        fiscal_quarter = F.when(before_april, F.lit(4)).otherwise(F.col("quarter"))
    elif fiscal == "april":
        fiscal_quarter = F.when(before_april, F.lit(4)).otherwise(F.col("quarter") - 1)
    else:
        raise ValueError(f"fiscal must be 'calendar' or 'april', got {fiscal!r}")
    return base.withColumns(
        {
            "day_of_week": F.weekday(d) + 1,
            **names,
            "is_holiday": F.lit(False),
            "fiscal_year": F.col("year") - before_april.cast("int"),
            "fiscal_quarter": fiscal_quarter.cast("int"),
        }
    )


def dim_date(
    spark: SparkSession,
    start: date = CALENDAR_START,
    end: date = CALENDAR_END,
    style: str = "sun0",
    fiscal: str = "calendar",
) -> DataFrame:
    """One row per day from ``start`` to ``end``.

    ``style="sun0"`` numbers weekdays 0 (Sunday) to 6. ``style="mon1"`` numbers them 1 (Monday) to 7 and
    adds holiday and fiscal columns. With ``fiscal="calendar"`` the fiscal quarter is the calendar quarter
    from April on and 4 before; ``fiscal="april"`` gives the usual 1 to 4 from April.

    ``range`` carries an exact row count, so Spark knows the calendar is small wherever it is joined.
    """
    if end < start:
        raise ValueError("end must not be before start")
    n = (end - start).days + 1
    days = spark.range(0, n, 1, 1).select(
        F.date_add(F.lit(start), F.col("id").cast("int")).alias("full_date")
    )
    return _calendar(days, style, fiscal)


def dim_date_covering(
    df: DataFrame, timestamp_col: str, style: str = "sun0", fiscal: str = "calendar"
) -> DataFrame:
    """The calendar from the first to the last day found in ``df``."""
    bounds = df.agg(
        F.min(timestamp_col).cast("date").alias("first"), F.max(timestamp_col).cast("date").alias("last")
    ).filter(F.col("first").isNotNull())
    days = bounds.select(F.explode(F.sequence("first", "last")).alias("full_date"))
    return _calendar(days, style, fiscal)


def split_location(df: DataFrame, col: str = "location") -> DataFrame:
    """Add ``city`` and ``state`` taken from a ``city, ..., state`` text."""
    return df.withColumns({"city": text.location_city(F.col(col)), "state": text.location_state(F.col(col))})


def dim_users(users: DataFrame, as_of: date | None = None) -> DataFrame:
    """Users with city, state and tenure segment. The personal number is always blanked."""
    shaped = split_location(users).select(
        F.col("id").alias("user_id"),
        "name",
        "email",
        "location",
        "signup_date",
        "social_security_number",
        "state",
        "city",
        labels.tenure_segment(F.col("signup_date"), as_of).alias("user_segment"),
    )
    return null_out(shaped, ["social_security_number"])


def dim_books(books: DataFrame, as_of: date | None = None) -> DataFrame:
    """Books with price tier and age category."""
    return books.select(
        "book_id",
        "title",
        "category",
        "base_price",
        "author",
        "isbn",
        F.col("publication_year").cast("int").alias("publication_year"),
        F.col("pages").cast("int").alias("pages"),
        "publisher",
        labels.price_tier(F.col("base_price")).alias("price_tier"),
        labels.age_category(F.col("publication_year"), as_of).alias("age_category"),
    )
