"""Builder of the sales fact and the date filters that read it."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.dates import date_id, midnight
from tallybook.functions.money import AMOUNT_TYPE
from tallybook.operators.cleaning import drop_negative


def fact_sales(transactions: DataFrame) -> DataFrame:
    """Cleaned transactions as fact rows: negative amounts dropped, one copy per sale, no discount."""
    return drop_negative(transactions).select(
        "transaction_id",
        "user_id",
        "book_id",
        date_id(F.col("timestamp")).alias("date_id"),
        F.col("amount").cast(AMOUNT_TYPE).alias("amount"),
        F.lit(1).alias("quantity"),
        F.lit(0).cast(AMOUNT_TYPE).alias("discount_amount"),
        F.col("timestamp").alias("transaction_timestamp"),
    )


def check_range(start: date | None, end: date | None) -> None:
    """Reject a range that ends before it starts; either end may be open."""
    if start is not None and end is not None and end < start:
        raise ValueError("end must not be before start")


def date_range(
    df: DataFrame, start: date | None = None, end: date | None = None, col: str = "full_date"
) -> DataFrame:
    """Rows whose date lies in [start, end]; a missing bound is open."""
    check_range(start, end)
    if start is not None:
        df = df.filter(F.col(col) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(col) <= F.lit(end))
    return df


def sales_between(
    sales: DataFrame, start: date | Column | None = None, end: date | Column | None = None
) -> DataFrame:
    """Sales of the days [start, end].

    Filters ``date_id``, which prunes partitions of the stored fact, and the timestamp it is derived from,
    which reaches the scan as a pushed filter when the fact is read straight from an event table.
    """
    if isinstance(start, date) and isinstance(end, date):
        check_range(start, end)
    if start is not None:
        first = F.lit(start) if isinstance(start, date) else start
        sales = sales.filter(
            (F.col("date_id") >= date_id(first)) & (F.col("transaction_timestamp") >= midnight(first))
        )
    if end is not None:
        last = F.lit(end) if isinstance(end, date) else end
        after = F.lit(end + timedelta(days=1)) if isinstance(end, date) else F.date_add(last, 1)
        sales = sales.filter(
            (F.col("date_id") <= date_id(last)) & (F.col("transaction_timestamp") < midnight(after))
        )
    return sales
