"""Exact money totals and the averages taken from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT_TYPE = "decimal(10,2)"
TOTAL_TYPE = "decimal(18,2)"
STORED_TOTAL_TYPE = "decimal(15,2)"
STORED_AVERAGE_TYPE = "decimal(10,2)"


def total(col: Column | str) -> Column:
    """Exact sum, kept as a decimal."""
    return F.sum(col).cast(TOTAL_TYPE)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Fractional quotient as a double; NULL when there is nothing to divide by."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def stored_average(total_col: Column, count_col: Column) -> Column:
    """Average rounded half-up to cents from the exact total, for summary tables."""
    return F.try_divide(total_col, count_col.cast("decimal(18,0)")).cast(STORED_AVERAGE_TYPE)
