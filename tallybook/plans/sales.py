"""Sales over time.

The fact is grouped by its own ``date_id`` first and meets the calendar afterwards, when one row per day is
left. Date windows are applied to the fact before that, where they prune the scan.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.dates import date_id, day, midnight, period_start
from tallybook.functions.money import ratio, total
from tallybook.operators.combining import beside, grouped
from tallybook.operators.facts import check_range, sales_between
from tallybook.star import Star


def _per_day(star: Star, sales: DataFrame) -> DataFrame:
    measures = grouped(
        sales,
        ["date_id"],
        [
            F.count("transaction_id").alias("total_transactions"),
            total("amount").alias("total_revenue"),
            F.count("amount").alias("_amounts"),
            F.sum("quantity").cast("bigint").alias("total_books_sold"),
        ],
        {"unique_customers": "user_id"},
    )
    return (
        measures.join(star.dates, "date_id")
        .select(
            F.col("full_date").alias("date"),
            "year",
            "month",
            "day_name",
            "total_transactions",
            "total_revenue",
            ratio(F.col("total_revenue"), F.col("_amounts")).alias("avg_transaction_value"),
            "unique_customers",
            "total_books_sold",
        )
        .orderBy(F.col("date").desc())
    )


def latest_sale_day(star: Star) -> DataFrame:
    """One row: the last calendar day with a sale, as ``latest``."""
    # Days are made distinct in the map tasks; a few of them meet the calendar, not every sale.
    days = star.sales.select("date_id").distinct()
    return days.join(star.dates.select("date_id", "full_date"), "date_id").agg(F.max("full_date").alias("latest"))


def daily_sales_trends(star: Star, days: int = 30) -> DataFrame:
    """Sales per day of the last ``days`` days of data, counted back from the last day with a sale.

    Both ends are included, so ``days=30`` covers 31 calendar days. The bounds are scalar subqueries over
    one anchor: they are evaluated first and reach the scan as filter values.
    """
    latest = F.col("latest")
    anchor = latest_sale_day(star)

    def bound(value: Column) -> Column:
        return anchor.select(value.alias("bound")).scalar()

    window = star.sales.filter(
        F.col("date_id").between(bound(date_id(F.date_sub(latest, days))), bound(date_id(latest)))
        & (F.col("transaction_timestamp") >= bound(midnight(F.date_sub(latest, days))))
        & (F.col("transaction_timestamp") < bound(midnight(F.date_add(latest, 1))))
    )
    return _per_day(star, window)


def daily_sales_by_range(star: Star, start: date, end: date) -> DataFrame:
    """Sales per day from ``start`` to ``end``, both included."""
    check_range(start, end)
    return _per_day(star, sales_between(star.sales, start, end))


def daily_sales(star: Star, start: date | None = None, end: date | None = None) -> DataFrame:
    """Sales per day of a range if both ends are given, else of the last 30 days of data."""
    if start is not None and end is not None:
        return daily_sales_by_range(star, start, end)
    return daily_sales_trends(star, 30)


def monthly_trends(star: Star, months: int = 12, as_of: date | None = None) -> DataFrame:
    """Sales per month since ``months`` months before ``as_of``; ``days_in_month`` counts days with sales."""
    sales = sales_between(star.sales, start=F.add_months(day(as_of), -months))
    keys = ["year", "month", "month_name"]
    calendar = star.dates.select("date_id", "full_date", *keys)
    per_day = sales.groupBy("date_id").agg(
        F.count("transaction_id").alias("_n"),
        F.count("amount").alias("_amounts"),
        total("amount").alias("_revenue"),
    )
    measures = (
        per_day.join(calendar, "date_id")
        .groupBy(*keys)
        .agg(
            F.countDistinct("full_date").alias("days_in_month"),
            F.sum("_n").alias("total_transactions"),
            total("_revenue").alias("total_revenue"),
            F.sum("_amounts").alias("_amounts"),
        )
    )

    def distinct(col: str, name: str) -> DataFrame:
        dated = sales.select("date_id", col).join(calendar, "date_id")
        return dated.groupBy(*keys).agg(F.countDistinct(col).alias(name))

    together = beside(
        measures, distinct("user_id", "unique_customers"), distinct("book_id", "unique_books"), on=keys
    )
    return together.select(
        *keys,
        "days_in_month",
        "total_transactions",
        "total_revenue",
        ratio(F.col("total_revenue"), F.col("_amounts")).alias("avg_transaction_value"),
        "unique_customers",
        "unique_books",
    ).orderBy("year", "month")


def sales_by_grain(star: Star, grain: str = "monthly") -> DataFrame:
    """Sales per day, week, month or year."""
    period = period_start(F.col("full_date"), grain)
    calendar = star.dates.select("date_id", period.alias("period_start"))
    return grouped(
        star.sales.join(calendar, "date_id"),
        ["period_start"],
        [
            total("amount").alias("total_revenue"),
            F.count("transaction_id").alias("transaction_count"),
            ratio(total("amount"), F.count("amount")).alias("average_transaction_value"),
            F.sum("quantity").cast("bigint").alias("total_books_sold"),
        ],
        {"unique_customers": "user_id"},
    ).orderBy("period_start")


def recent_sales(star: Star, days: int = 30, limit: int = 10, as_of: date | None = None) -> DataFrame:
    """Transactions and revenue of the latest days with sales since ``days`` days before ``as_of``."""
    sales = sales_between(star.sales, start=F.date_sub(day(as_of), days))
    per_day = sales.groupBy("date_id").agg(
        F.count("transaction_id").alias("transactions"), total("amount").alias("revenue")
    )
    return (
        per_day.join(star.dates.select("date_id", "full_date"), "date_id")
        .select("full_date", "transactions", "revenue")
        .orderBy(F.col("full_date").desc())
        .limit(limit)
    )


def hourly_pattern(star: Star) -> DataFrame:
    """Transactions per hour of the day."""
    hour = F.hour("transaction_timestamp").cast("bigint")
    return (
        star.sales.groupBy(hour.alias("hour")).agg(F.count("*").alias("transaction_count")).orderBy("hour")
    )
