"""Text repair and splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters trimmed from the parts of a location.
BLANKS = " \t\n\r\x0b\x0c"


def _trimmed(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def _location_parts(col: Column) -> Column:
    return F.split(F.coalesce(col, F.lit("")), ",")


def location_city(col: Column) -> Column:
    """Text before the first comma; empty for a missing location."""
    return _trimmed(F.element_at(_location_parts(col), 1))


def location_state(col: Column) -> Column:
    """Text after the last comma, or empty when there is no comma."""
    parts = _location_parts(col)
    return F.when(F.size(parts) > 1, _trimmed(F.element_at(parts, -1))).otherwise(F.lit(""))


def empty_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))
