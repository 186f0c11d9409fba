"""Row rules for constraint checks: boolean columns that are true when the row is acceptable.

As in SQL CHECK constraints, a rule that evaluates to NULL is met.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions.dates import day

# Limits and the accepted e-mail form (matched without regard to case).
EARLIEST_CALENDAR_DAY = date(2020, 1, 1)
EARLIEST_PUBLICATION_YEAR = 1900
EMAIL_FORM = r"(?i)^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"


def met(rule: Column) -> Column:
    return F.coalesce(rule, F.lit(True))


def valid_calendar_day(col: Column) -> Column:
    return met(col >= F.lit(EARLIEST_CALENDAR_DAY))


def valid_publication_year(col: Column, as_of=None) -> Column:
    return met(col.between(F.lit(EARLIEST_PUBLICATION_YEAR), F.year(day(as_of)) + 1))


def valid_email(col: Column) -> Column:
    return met(col.rlike(EMAIL_FORM))


def not_negative(col: Column) -> Column:
    return met(col >= 0)
