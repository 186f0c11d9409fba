"""The three published views."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.money import ratio, total
from tallybook.operators.facts import date_range, sales_between
from tallybook.operators.paging import page
from tallybook.operators.ranking import global_ranks
from tallybook.plans.summaries import book_performance_of
from tallybook.star import Star


def v_sales_with_dimensions(star: Star) -> DataFrame:
    """Every sale with its user, book and day."""
    users = star.users.select(
        "user_id",
        F.col("name").alias("user_name"),
        F.col("email").alias("user_email"),
        F.col("location").alias("user_location"),
        "user_segment",
    )
    books = star.books.select(
        "book_id",
        F.col("title").alias("book_title"),
        F.col("category").alias("book_category"),
        F.col("author").alias("book_author"),
        "base_price",
    )
    dates = star.dates.select("date_id", "full_date", "year", "month", "quarter", "day_name")
    return (
        star.sales.select(
            "transaction_id", "amount", "quantity", "transaction_timestamp", "user_id", "book_id", "date_id"
        )
        .join(dates, "date_id")
        .join(books, "book_id")
        .join(users, "user_id")
        .drop("date_id", "book_id", "user_id")
        .select(
            "transaction_id",
            "amount",
            "quantity",
            "transaction_timestamp",
            "user_name",
            "user_email",
            "user_location",
            "user_segment",
            "book_title",
            "book_category",
            "book_author",
            "base_price",
            "full_date",
            "year",
            "month",
            "quarter",
            "day_name",
        )
    )


def v_top_books(star: Star, slices: int | None = None) -> DataFrame:
    """Every sold book with its rank by revenue and by number of sales; ties share a rank.

    Meant to run on the stored book summary: the ranks read it more than once.
    """
    sold = star.books.select("book_id", "title", "category", "author").join(
        book_performance_of(star).select(
            "book_id", "total_sales", "total_revenue", "average_price", "unique_customers"
        ),
        "book_id",
    )
    return global_ranks(sold, {"total_revenue": "revenue_rank", "total_sales": "sales_rank"}, slices)


def v_user_behavior(star: Star) -> DataFrame:
    """Every user, with or without sales: transactions, spend, first and last purchase, variety.

    Additive measures, distinct transactions and distinct books and categories have their own aggregates.
    All end up hashed by ``user_id``, as the user join needs them.
    """
    transactions = star.sales.groupBy("user_id").agg(
        F.countDistinct("transaction_id").alias("_transactions")
    )
    purchases = star.sales.groupBy("user_id").agg(
        total("amount").alias("total_spent"),
        F.count("amount").alias("_amounts"),
        F.min("transaction_timestamp").alias("first_purchase"),
        F.max("transaction_timestamp").alias("last_purchase"),
    )
    bought = star.sales.select("user_id", "book_id").distinct()
    variety = (
        bought.join(star.books.select("book_id", "category"), "book_id", "left")
        .groupBy("user_id")
        .agg(
            F.count("book_id").alias("_books"),
            F.countDistinct("category").alias("_categories"),
        )
    )
    return (
        star.users.select("user_id", "name", "user_segment", "signup_date")
        .join(transactions, "user_id", "left")
        .join(purchases, "user_id", "left")
        .join(variety, "user_id", "left")
        .select(
            "user_id",
            "name",
            "user_segment",
            "signup_date",
            F.coalesce("_transactions", F.lit(0)).alias("total_transactions"),
            "total_spent",
            ratio(F.col("total_spent"), F.col("_amounts")).alias("avg_transaction_value"),
            "first_purchase",
            "last_purchase",
            F.coalesce("_books", F.lit(0)).alias("unique_books_purchased"),
            F.coalesce("_categories", F.lit(0)).alias("unique_categories"),
        )
    )


def published_views(star: Star) -> dict[str, DataFrame]:
    """The views under the names they are registered with."""
    return {
        "v_sales_with_dimensions": v_sales_with_dimensions(star),
        "v_top_books": v_top_books(star),
        "v_user_behavior": v_user_behavior(star),
    }


def _matching_sales(
    star: Star,
    category: str | None,
    user_segment: str | None,
    start: date | None,
    end: date | None,
) -> DataFrame:
    # The range is filtered on the fact, before it meets the dimensions, and again on the calendar day.
    within = star.replace(sales=sales_between(star.sales, start, end))
    sales = date_range(v_sales_with_dimensions(within), start, end)
    if category is not None:
        sales = sales.filter(F.col("book_category") == category)
    if user_segment is not None:
        sales = sales.filter(F.col("user_segment") == user_segment)
    return sales


def sales_filtered(
    star: Star,
    category: str | None = None,
    user_segment: str | None = None,
    start: date | None = None,
    end: date | None = None,
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """A page of sales, latest first, that match every given filter."""
    matching = _matching_sales(star, category, user_segment, start, end)
    return page(
        matching, "transaction_timestamp", "transaction_id", limit=limit, offset=offset, ascending=False
    )


def sales_filtered_total(
    star: Star,
    category: str | None = None,
    user_segment: str | None = None,
    start: date | None = None,
    end: date | None = None,
) -> DataFrame:
    """One row over all sales that match: number of records, revenue and average."""
    matching = _matching_sales(star, category, user_segment, start, end)
    return matching.agg(
        F.count("*").alias("total_records"),
        total("amount").alias("total_revenue"),
        ratio(total("amount"), F.count("amount")).alias("average_transaction_value"),
    )
