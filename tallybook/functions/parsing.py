"""Non-strict parsing of text columns: a value that does not parse becomes NULL, never an error.

The pattern guards keep out forms that Spark's own casts accept but the feeds do not allow
(surrounding blanks, ``12d``, a date without its time). Leading zeros of date parts may be missing. The
guards also make the result independent of the
session time zone, because timestamps are parsed straight to ``timestamp_ntz``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text forms the feeds use.
INTEGER_FORM = r"^[+-]?[0-9]+$"
NUMBER_FORM = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
DATE_FORM = r"^[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}$"
TIMESTAMP_FORM = r"^[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2} [0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}$"
DATE_FORMAT = "yyyy-MM-dd"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _guarded(col: Column, form: str, type_name: str) -> Column:
    return F.when(col.rlike(form), col.try_cast(type_name))


def _four_digit_year(col: Column) -> Column:
    """Pad the year, which Spark's casts want with four digits."""
    return F.lpad(col, F.length(col) + 5 - F.instr(col, "-"), "0")


def parse_long(col: Column) -> Column:
    """Text to bigint; ``12.7`` and ``abc`` give NULL."""
    return _guarded(col, INTEGER_FORM, "bigint")


def parse_double(col: Column) -> Column:
    """Text to double."""
    return _guarded(col, NUMBER_FORM, "double")


def parse_long_via_double(col: Column) -> Column:
    """Text to bigint by way of double, so ``12.0`` and ``12.7`` both give 12."""
    return parse_double(col).try_cast("bigint")


def parse_date(col: Column) -> Column:
    """``yyyy-MM-dd`` text to date; impossible days give NULL."""
    return F.when(col.rlike(DATE_FORM), _four_digit_year(col).try_cast("date"))


def parse_timestamp(col: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text to a zone-free timestamp."""
    return F.when(col.rlike(TIMESTAMP_FORM), _four_digit_year(col).try_cast("timestamp_ntz"))


def to_number_or_zero(col: Column) -> Column:
    """Any column as double, unparseable and missing values as 0."""
    return F.coalesce(col.try_cast("double"), F.lit(0.0))
