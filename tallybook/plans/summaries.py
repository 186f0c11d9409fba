"""Pre-aggregated tables, the jobs that refresh them, and the queries that read them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.dates import date_id, day
from tallybook.functions.money import STORED_TOTAL_TYPE, ratio, stored_average, total
from tallybook.operators.combining import beside, grouped
from tallybook.operators.facts import check_range, sales_between
from tallybook.plans.books import sales_per_book
from tallybook.schemas import STAR_SCHEMAS
from tallybook.sources.tables import materialize, refresh, upsert_table
from tallybook.star import Star

# Names of the stored aggregates.
DAILY = "fact_daily_sales_summary"
BOOKS = "fact_book_performance"
MONTHLY_VIEW = "mv_monthly_sales_summary"
CATEGORY_VIEW = "mv_category_performance"


def daily_sales_summary(sales: DataFrame) -> DataFrame:
    """Revenue, transactions, users and copies per day, with money stored to the cent."""
    exact = total("amount")
    summary = grouped(
        sales,
        ["date_id"],
        [
            exact.cast(STORED_TOTAL_TYPE).alias("total_revenue"),
            F.count("transaction_id").alias("transaction_count"),
            stored_average(exact, F.count("amount")).alias("average_transaction_value"),
            F.sum("quantity").cast("bigint").alias("total_quantity"),
        ],
        {"unique_users": "user_id"},
    )
    return summary.select(*STAR_SCHEMAS[DAILY].names)


def book_performance(sales: DataFrame, dates: DataFrame) -> DataFrame:
    """Sales, revenue, customers and first and last sale day per book."""
    exact = total("amount")
    performance = grouped(
        sales.join(dates.select("date_id", "full_date"), "date_id"),
        ["book_id"],
        [
            F.count("transaction_id").alias("total_sales"),
            exact.cast(STORED_TOTAL_TYPE).alias("total_revenue"),
            stored_average(exact, F.count("amount")).alias("average_price"),
            F.min("full_date").alias("first_sale_date"),
            F.max("full_date").alias("last_sale_date"),
        ],
        {"unique_customers": "user_id"},
    )
    return performance.select(*STAR_SCHEMAS[BOOKS].names)


def daily_of(star: Star) -> DataFrame:
    """The stored daily summary, or the same derived from the sales."""
    return star.daily if star.daily is not None else daily_sales_summary(star.sales)


def book_performance_of(star: Star) -> DataFrame:
    """The stored book summary, or the same derived from the sales."""
    if star.book_performance is not None:
        return star.book_performance
    return book_performance(star.sales, star.dates)


def monthly_sales_summary(star: Star) -> DataFrame:
    """Transactions, revenue, customers and books per month."""
    keys = ["year", "month"]
    calendar = star.dates.select("date_id", *keys)
    per_day = star.sales.groupBy("date_id").agg(
        F.count("transaction_id").alias("_n"), total("amount").alias("_revenue")
    )
    measures = (
        per_day.join(calendar, "date_id")
        .groupBy(*keys)
        .agg(F.sum("_n").alias("total_transactions"), total("_revenue").alias("total_revenue"))
    )

    def distinct(col: str, name: str) -> DataFrame:
        dated = star.sales.select("date_id", col).join(calendar, "date_id")
        return dated.groupBy(*keys).agg(F.countDistinct(col).alias(name))

    return beside(
        measures, distinct("user_id", "unique_customers"), distinct("book_id", "unique_books_sold"), on=keys
    ).orderBy(*keys)


def category_summary(star: Star) -> DataFrame:
    """Sales, revenue and customers per category."""
    categories = star.books.select("book_id", "category")
    measures = (
        sales_per_book(star.sales)
        .join(categories, "book_id")
        .groupBy("category")
        .agg(
            F.sum("total_sales").alias("total_sales"),
            total("total_revenue").alias("total_revenue"),
            ratio(total("total_revenue"), F.sum("_amounts")).alias("avg_price"),
        )
    )
    customers = (
        star.sales.select("book_id", "user_id")
        .join(categories, "book_id")
        .groupBy("category")
        .agg(F.countDistinct("user_id").alias("unique_customers"))
    )
    return beside(measures, customers, on=["category"]).orderBy(F.col("total_revenue").desc(), "category")


def refresh_summaries(
    star: Star,
    root: str,
    changed: DataFrame | None = None,
    now: Column | None = None,
    prefix: str = "",
) -> dict[str, DataFrame]:
    """Bring the stored daily and book summaries up to date with the sales.

    With ``changed`` (the sales added or corrected since the last run, at least ``date_id`` and
    ``book_id``) only the days and books they touch are recomputed from the fact; the upsert leaves the
    other rows alone. A summary that is not stored yet is computed whole. ``prefix`` goes before the table
    names, a database for instance.
    """
    spark = star.sales.sparkSession

    def touched(name: str, key: str) -> DataFrame:
        if changed is None or not spark.catalog.tableExists(prefix + name):
            return star.sales
        return star.sales.join(changed.select(key).distinct(), key, "left_semi")

    daily = daily_sales_summary(touched(DAILY, "date_id"))
    books = book_performance(touched(BOOKS, "book_id"), star.dates)
    return {
        DAILY: upsert_table(daily, prefix + DAILY, "date_id", root, now),
        BOOKS: upsert_table(books, prefix + BOOKS, "book_id", root, now),
    }


def create_materialized(star: Star, root: str, prefix: str = "") -> dict[str, DataFrame]:
    """Store the monthly and category aggregates unless they are stored already."""
    return {
        MONTHLY_VIEW: materialize(monthly_sales_summary(star), prefix + MONTHLY_VIEW, root),
        CATEGORY_VIEW: materialize(category_summary(star), prefix + CATEGORY_VIEW, root),
    }


def refresh_materialized(star: Star, root: str, prefix: str = "") -> dict[str, DataFrame]:
    """Recompute the monthly and category aggregates; readers keep the old version meanwhile."""
    return {
        MONTHLY_VIEW: refresh(monthly_sales_summary(star), prefix + MONTHLY_VIEW, root),
        CATEGORY_VIEW: refresh(category_summary(star), prefix + CATEGORY_VIEW, root),
    }


def _daily_between(star: Star, start: Column | None, end: Column | None) -> DataFrame:
    """Daily summary rows of a range. A summary derived on the fly reads only the sales of the range: the bounds are
    on the stored day and on the timestamp, which reaches the scan of a fact that stores no day."""
    if star.daily is not None:
        daily = star.daily
        if start is not None:
            daily = daily.filter(F.col("date_id") >= date_id(start))
        if end is not None:
            daily = daily.filter(F.col("date_id") <= date_id(end))
    else:
        daily = daily_sales_summary(sales_between(star.sales, start, end))
    return daily.join(star.dates.select("date_id", "full_date"), "date_id")


def daily_summary(
    star: Star, start: date | None = None, end: date | None = None, limit: int = 100
) -> DataFrame:
    """Stored daily figures of an optional range, latest first."""
    check_range(start, end)
    first = None if start is None else F.lit(start)
    last = None if end is None else F.lit(end)
    return (
        _daily_between(star, first, last)
        .select(
            "full_date",
            "total_revenue",
            "transaction_count",
            "unique_users",
            "average_transaction_value",
            "total_quantity",
        )
        .orderBy(F.col("full_date").desc())
        .limit(limit)
    )


def sales_trends(star: Star, days: int = 30, as_of: date | None = None) -> DataFrame:
    """Stored daily figures since ``days`` days before ``as_of``, latest first."""
    return (
        _daily_between(star, F.date_sub(day(as_of), days), None)
        .select(
            "full_date", "total_revenue", "transaction_count", "unique_users", "average_transaction_value"
        )
        .orderBy(F.col("full_date").desc())
    )


def top_books_from_summary(star: Star, limit: int = 50) -> DataFrame:
    """Books by stored revenue."""
    return (
        book_performance_of(star)
        .join(star.books.select("book_id", "title", "category", "author"), "book_id")
        .select(
            "book_id",
            "title",
            "category",
            "author",
            "total_sales",
            "total_revenue",
            "average_price",
            "unique_customers",
            "first_sale_date",
            "last_sale_date",
        )
        .orderBy(F.col("total_revenue").desc(), "book_id")
        .limit(limit)
    )


def books_by_category(star: Star, category: str, limit: int = 100) -> DataFrame:
    """Books of a category by stored revenue; books without sales come last."""
    books = star.books.filter(F.col("category") == category)
    performance = book_performance_of(star)
    return (
        books.join(
            performance.select("book_id", "total_sales", "total_revenue", "average_price"), "book_id", "left"
        )
        .select(
            "book_id",
            "title",
            "category",
            "base_price",
            "author",
            "total_sales",
            "total_revenue",
            "average_price",
        )
        .orderBy(F.col("total_revenue").desc_nulls_last(), "book_id")
        .limit(limit)
    )
