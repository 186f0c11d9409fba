"""Calendar arithmetic on date columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reporting grains and the ``date_trunc`` unit each one stands for.
GRAIN_UNITS = {
    "daily": "DAY",
    "weekly": "WEEK",
    "monthly": "MONTH",
    "yearly": "YEAR",
}


def day(value: date | Column | None) -> Column:
    """A date argument as a column; ``None`` means today."""
    if value is None:
        return F.current_date()
    return value if isinstance(value, Column) else F.lit(value)


def date_id(col: Column) -> Column:
    """yyyymmdd as an int."""
    return (F.year(col) * 10000 + F.month(col) * 100 + F.dayofmonth(col)).cast("int")


def midnight(col: Column) -> Column:
    """The first instant of a day, without a zone."""
    return col.cast("timestamp_ntz")


def period_start(col: Column, grain: str) -> Column:
    """First day of the day, week (Monday), month or year a date falls in."""
    if grain not in GRAIN_UNITS:
        raise ValueError(f"grain must be one of {sorted(GRAIN_UNITS)}, got {grain!r}")
    return col if grain == "daily" else F.trunc(col, GRAIN_UNITS[grain])


def calendar_days_between(earlier: Column, later: Column) -> Column:
    """Number of midnights crossed: 23:59 to 00:01 of the next day is 1."""
    return F.datediff(later.cast("date"), earlier.cast("date")).cast("bigint")
