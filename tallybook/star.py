"""The star: three dimensions, one fact table and, when stored, two summary tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Source = DataFrame | Callable[[], DataFrame]


class Star:
    """DataFrames of the star schema.

    A table may be given as a DataFrame or as a function that builds it, called on first use, so a report
    that touches two tables does not pay for planning the others.

    Dimension keys are unique (``insert_ignore`` keeps the first row per key, ``check_unique`` reports the
    rest). ``sales.date_id`` is the day of ``sales.transaction_timestamp``. The summary tables may be
    absent; readers then derive them from ``sales``.
    """

    def __init__(
        self,
        users: Source,
        books: Source,
        dates: Source,
        sales: Source,
        daily: Source | None = None,
        book_performance: Source | None = None,
    ) -> None:
        self._sources = {
            "users": users,
            "books": books,
            "dates": dates,
            "sales": sales,
            "daily": daily,
            "book_performance": book_performance,
        }

    def _table(self, name: str) -> DataFrame | None:
        source = self._sources[name]
        if callable(source):
            self._sources[name] = source = source()
        return source

    @property
    def users(self) -> DataFrame:
        return self._table("users")

    @property
    def books(self) -> DataFrame:
        return self._table("books")

    @property
    def dates(self) -> DataFrame:
        return self._table("dates")

    @property
    def sales(self) -> DataFrame:
        return self._table("sales")

    @property
    def daily(self) -> DataFrame | None:
        return self._table("daily")

    @property
    def book_performance(self) -> DataFrame | None:
        return self._table("book_performance")

    def replace(self, **tables: Source | None) -> Star:
        """The same star with some tables exchanged."""
        return Star(**{**self._sources, **tables})

    def tables(self) -> dict[str, DataFrame]:
        """The tables by stored name, without the absent ones."""
        named = {
            "dim_users": self.users,
            "dim_books": self.books,
            "dim_date": self.dates,
            "fact_sales": self.sales,
            "fact_daily_sales_summary": self.daily,
            "fact_book_performance": self.book_performance,
        }
        return {name: df for name, df in named.items() if df is not None}
