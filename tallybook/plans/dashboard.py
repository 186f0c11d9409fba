"""Figures shown on the dashboard, computed from the reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.money import ratio
from tallybook.functions.parsing import to_number_or_zero

# The names a figure may come under in a report, in order of preference.
TRANSACTIONS = ("transaction_count", "total_transactions")
CUSTOMERS = ("unique_customers", "total_customers")
ORDER_VALUE = ("average_order_value", "avg_spent")


def coerce_numeric(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Columns as double, with 0 for what is missing or not a number."""
    return df.withColumns({c: to_number_or_zero(F.col(c)) for c in cols})


def first_present(df: DataFrame, names: Sequence[str], default: float = 0) -> Column:
    """The first of the named columns the report has, as a number; else the default."""
    for name in names:
        if name in df.columns:
            return to_number_or_zero(F.col(name))
    return F.lit(float(default))


def revenue_kpis(daily: DataFrame) -> DataFrame:
    """One row: revenue, transactions, revenue per transaction, days with sales. Zeros for no rows."""
    figures = daily.select(
        to_number_or_zero(F.col("total_revenue")).alias("revenue"),
        first_present(daily, TRANSACTIONS).alias("transactions"),
    )
    revenue = F.coalesce(F.sum("revenue"), F.lit(0.0))
    transactions = F.coalesce(F.sum("transactions"), F.lit(0.0))
    return figures.agg(
        revenue.alias("total_revenue"),
        transactions.alias("total_transactions"),
        F.coalesce(ratio(revenue, transactions), F.lit(0.0)).alias("avg_transaction_value"),
        F.count_if(F.col("transactions") > 0).alias("days_with_sales"),
    )


def active_user_kpis(daily: DataFrame) -> DataFrame:
    """One row: mean and peak of daily customers. Zeros for no rows."""
    users = daily.select(first_present(daily, CUSTOMERS).alias("users"))
    return users.agg(
        F.coalesce(F.avg("users"), F.lit(0.0)).alias("avg_daily_users"),
        F.coalesce(F.max("users"), F.lit(0.0)).alias("max_daily_users"),
    )


def revenue_trend(daily: DataFrame) -> DataFrame:
    """Revenue and transactions per day."""
    return daily.select(
        F.col("date").cast("date").alias("date"),
        to_number_or_zero(F.col("total_revenue")).alias("total_revenue"),
        first_present(daily, TRANSACTIONS).alias("transaction_count"),
    )


def active_users(daily: DataFrame) -> DataFrame:
    """Customers and transactions per day."""
    return daily.select(
        F.col("date").cast("date").alias("date"),
        first_present(daily, CUSTOMERS).alias("unique_customers"),
        first_present(daily, TRANSACTIONS).alias("transaction_count"),
    )


def market_share(categories: DataFrame) -> DataFrame:
    """Each category's percentage of all revenue.

    The total is a scalar subquery over the same report, so categories are never gathered in one task.
    """
    revenue = to_number_or_zero(F.col("total_revenue"))
    everything = categories.agg(F.sum(revenue).alias("everything")).scalar()
    return categories.select(
        "category",
        revenue.alias("total_revenue"),
        F.try_divide(revenue * 100, everything).alias("market_share"),
    )


def segment_series(segments: DataFrame) -> DataFrame:
    """Customers, revenue and order value per segment."""
    return segments.select(
        "segment",
        to_number_or_zero(F.col("customer_count")).alias("customer_count"),
        to_number_or_zero(F.col("total_revenue")).alias("total_revenue"),
        first_present(segments, ORDER_VALUE).alias("average_order_value"),
    )


def top_books_series(books: DataFrame) -> DataFrame:
    """Revenue, sales and customers per book title."""
    return books.select(
        "title",
        to_number_or_zero(F.col("total_revenue")).alias("total_revenue"),
        to_number_or_zero(F.col("total_sales")).alias("total_sales"),
        first_present(books, CUSTOMERS).alias("unique_customers"),
    )
