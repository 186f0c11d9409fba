"""Lookups of books."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.operators.paging import Cursor, page, page_after
from tallybook.star import Star


def _book_columns(star: Star) -> DataFrame:
    return star.books.select(
        "book_id",
        "title",
        "category",
        "base_price",
        "author",
        "isbn",
        "publication_year",
        "pages",
        "publisher",
        "price_tier",
        "age_category",
    )


def books_page(star: Star, limit: int = 100, offset: int = 0, ascending: bool = True) -> DataFrame:
    """A page of books by id."""
    return page(_book_columns(star), "book_id", limit=limit, offset=offset, ascending=ascending)


def books_after(star: Star, after: Cursor | None = None, limit: int = 100, ascending: bool = True) -> DataFrame:
    """The page of books by id that follows a cursor."""
    return page_after(_book_columns(star), "book_id", after=after, limit=limit, ascending=ascending)


def book_by_id(star: Star, book_id: int) -> DataFrame:
    """One book, or no row. The key filter reaches the scan."""
    return _book_columns(star).filter(F.col("book_id") == book_id)
