"""Ordered pages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Page size limits.
MAX_PAGE = 1000
DEFAULT_PAGE = 100


def page(
    df: DataFrame, *order: str, limit: int = DEFAULT_PAGE, offset: int = 0, ascending: bool = True
) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the given order (a top-k plan, not a full sort)."""
    _check(order, limit)
    if offset < 0:
        raise ValueError("offset must not be negative")
    return df.orderBy(*_keys(order, ascending)).offset(offset).limit(limit)


@dataclass(frozen=True)
class Cursor:
    """Where a page ended: the order columns of its last row, and how many rows with just these values were given so far."""

    values: tuple[Any, ...]
    seen: int = 1


def page_after(
    df: DataFrame, *order: str, after: Cursor | None = None, limit: int = DEFAULT_PAGE, ascending: bool = True
) -> DataFrame:
    """The page that follows the one ``after`` is the end of, or the first page.

    The cursor is a filter on the order columns, so the scan skips what lies before it and a late page costs as much as the
    first: at most ``limit`` rows and those equal to the cursor are gathered, never those of the pages before. Rows that the
    order leaves equal are told apart by their number; they come each once if they are equal in all columns or the
    order names a key. Nulls come first in ascending order and last in descending order, as in ``page``.
    """
    _check(order, limit)
    rest = df if after is None else df.filter(_from(order, after.values, ascending))
    return rest.orderBy(*_keys(order, ascending)).offset(0 if after is None else after.seen).limit(limit)


def end_of(rows: DataFrame, *order: str, before: Cursor | None = None, ascending: bool = True) -> Cursor | None:
    """The cursor at the end of a page that began after ``before``; ``before`` itself if the page is empty.

    One aggregate over the page brings its last values and their number to the driver.
    """
    values = F.struct(*[F.col(c) for c in order])
    last = rows.groupBy(values.alias("at")).agg(F.count("*").alias("n")).select("at.*", "n")
    row = last.orderBy(*_keys(order, not ascending)).first()
    if row is None:
        return before
    found = tuple(row[c] for c in order)
    return Cursor(found, row["n"] + (before.seen if before is not None and before.values == found else 0))


def _check(order: Sequence[str], limit: int) -> None:
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be between 1 and {MAX_PAGE}")
    if not order:
        raise ValueError("a page needs an order")


def _keys(order: Sequence[str], ascending: bool) -> list[Column]:
    return [F.col(c).asc() if ascending else F.col(c).desc() for c in order]


def _from(order: Sequence[str], values: Sequence[Any], ascending: bool) -> Column:
    """Rows not before the cursor. The bound on the first column stands alone too: partitions are pruned by it."""
    later = F.lit(True)
    for name, value in reversed(list(zip(order, values, strict=True))):
        col = F.col(name)
        if value is None:
            later = (col.isNotNull() if ascending else F.lit(False)) | (col.isNull() & later)
        elif ascending:
            later = (col > value) | ((col == value) & later)
        else:
            later = (col < value) | col.isNull() | ((col == value) & later)
    first, value = F.col(order[0]), values[0]
    if value is None:
        return later
    return ((first >= value) if ascending else ((first <= value) | first.isNull())) & later
