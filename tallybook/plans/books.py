"""Books, categories and authors.

Money and counts are summed per ``book_id`` before the books are joined: that aggregate is combined in the
map tasks, so the whole fact is never shuffled to meet a large dimension. Distinct customers cannot be
combined that way; a report that keeps ``limit`` rows counts them only for the rows it keeps.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.dates import day, period_start
from tallybook.functions.money import ratio, total
from tallybook.operators.combining import beside
from tallybook.operators.facts import sales_between
from tallybook.operators.ranking import top_rank
from tallybook.star import Star

# What each ranking metric orders by.
METRIC_COLUMNS = {
    "revenue": "total_revenue",
    "sales_count": "total_sales",
    "customers": "unique_customers",
    "books_sold": "total_quantity",
}


def sales_per_book(sales: DataFrame, *extra: Column) -> DataFrame:
    """Additive measures of each book: one small row per book out of every map task."""
    return sales.groupBy("book_id").agg(
        F.count("transaction_id").alias("total_sales"),
        F.count("amount").alias("_amounts"),
        total("amount").alias("total_revenue"),
        *extra,
    )


def _customers_of(sales: DataFrame, kept: DataFrame, key: str, counted: str, name: str) -> DataFrame:
    """Distinct ``counted`` values of each kept row.

    ``kept`` comes out of a limit, so Spark sees its size and broadcasts it when it is small; only the
    matching sales are shuffled. ``kept`` rides along as grouping columns and is computed once.
    """
    matching = sales.select(key, counted).join(kept, key)
    return matching.groupBy(*kept.columns).agg(F.countDistinct(counted).alias(name))


def top_books(star: Star, limit: int = 10) -> DataFrame:
    """Books by revenue, with the timestamps of their first and last sale."""
    per_book = sales_per_book(
        star.sales,
        F.min("transaction_timestamp").alias("first_sale_date"),
        F.max("transaction_timestamp").alias("last_sale_date"),
    )
    kept = (
        per_book.join(star.books.select("book_id", "title", "author", "category"), "book_id")
        .orderBy(F.col("total_revenue").desc(), "book_id")
        .limit(limit)
    )
    counted = _customers_of(star.sales, kept, "book_id", "user_id", "unique_customers")
    return counted.select(
        "book_id",
        "title",
        "author",
        "category",
        "total_sales",
        "total_revenue",
        ratio(F.col("total_revenue"), F.col("_amounts")).alias("avg_price"),
        "unique_customers",
        "first_sale_date",
        "last_sale_date",
    ).orderBy(F.col("total_revenue").desc(), "book_id")


def _by_category(star: Star, sales: DataFrame) -> DataFrame:
    """Measures of each category: sales, revenue, distinct books and distinct customers."""
    categories = star.books.select("book_id", "category")
    measures = (
        sales_per_book(sales)
        .join(categories, "book_id")
        .groupBy("category")
        .agg(
            F.sum("total_sales").alias("total_sales"),
            F.sum("_amounts").alias("_amounts"),
            total("total_revenue").alias("total_revenue"),
            F.countDistinct("book_id").alias("unique_books"),
        )
    )
    customers = (
        sales.select("book_id", "user_id")
        .join(categories, "book_id")
        .groupBy("category")
        .agg(F.countDistinct("user_id").alias("unique_customers"))
    )
    average = ratio(F.col("total_revenue"), F.col("_amounts"))
    return beside(measures, customers, on=["category"]).withColumn("avg_price", average)


def category_performance(star: Star) -> DataFrame:
    """Sales, revenue, customers and books of each category."""
    return (
        _by_category(star, star.sales)
        .select("category", "total_sales", "total_revenue", "avg_price", "unique_customers", "unique_books")
        .orderBy(F.col("total_revenue").desc(), "category")
    )


def sales_by_category(star: Star, start: date | None = None, end: date | None = None) -> DataFrame:
    """Transactions, revenue and customers of each category in an optional date range."""
    dated = sales_between(star.sales, start, end)
    sales = dated.join(star.dates.select("date_id"), "date_id", "left_semi")
    return (
        _by_category(star, sales)
        .select(
            "category",
            F.col("total_sales").alias("total_transactions"),
            "total_revenue",
            F.col("avg_price").alias("average_transaction_value"),
            "unique_customers",
        )
        .orderBy(F.col("total_revenue").desc(), "category")
    )


def author_performance(star: Star, limit: int = 20) -> DataFrame:
    """Authors by revenue; ``books_written`` counts the books that sold."""
    by_author = star.books.select("book_id", "author")
    kept = (
        sales_per_book(star.sales)
        .join(by_author, "book_id")
        .groupBy("author")
        .agg(
            F.countDistinct("book_id").alias("books_written"),
            F.sum("total_sales").alias("total_sales"),
            F.sum("_amounts").alias("_amounts"),
            total("total_revenue").alias("total_revenue"),
        )
        .orderBy(F.col("total_revenue").desc(), "author")
        .limit(limit)
    )
    their_books = by_author.join(
        kept.withColumnRenamed("author", "_author"), F.col("author").eqNullSafe(F.col("_author"))
    ).drop("_author")
    matching = star.sales.select("book_id", "user_id").join(their_books, "book_id")
    counted = matching.groupBy(*kept.columns).agg(F.countDistinct("user_id").alias("unique_customers"))
    return counted.select(
        "author",
        "books_written",
        "total_sales",
        "total_revenue",
        ratio(F.col("total_revenue"), F.col("_amounts")).alias("avg_price"),
        "unique_customers",
    ).orderBy(F.col("total_revenue").desc(), "author")


def top_books_by_metric(
    star: Star,
    metric: str = "revenue",
    category: str | None = None,
    grain: str | None = None,
    limit: int = 5,
    as_of: date | None = None,
) -> DataFrame:
    """Books ranked by a chosen metric, optionally within a category and the current period.

    ``grain`` keeps the sales of the day, week, month or year that ``as_of`` falls in, up to ``as_of``.
    """
    if metric not in METRIC_COLUMNS:
        raise ValueError(f"metric must be one of {sorted(METRIC_COLUMNS)}, got {metric!r}")
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    measure = METRIC_COLUMNS[metric]
    sales = star.sales
    if grain is not None:
        sales = sales_between(sales, period_start(day(as_of), grain), day(as_of))
    books = star.books.select("book_id", "title", "author", "category")
    if category is not None:
        books = books.filter(F.col("category") == category)

    quantity = F.sum("quantity").cast("bigint").alias("total_quantity")
    if metric == "customers":
        # Here the distinct count decides the order, so it is needed for every book.
        customers = sales.groupBy("book_id").agg(F.countDistinct("user_id").alias("unique_customers"))
        per_book = beside(sales_per_book(sales, quantity), customers, on=["book_id"])
        ranked = top_rank(per_book.join(books, "book_id"), measure, "book_id", limit)
    else:
        per_book = sales_per_book(sales, quantity)
        kept = top_rank(per_book.join(books, "book_id"), measure, "book_id", limit)
        ranked = _customers_of(sales, kept, "book_id", "user_id", "unique_customers")
    return ranked.select(
        "book_id",
        "title",
        "author",
        "category",
        "total_revenue",
        "total_sales",
        ratio(F.col("total_revenue"), F.col("_amounts")).alias("average_price"),
        "unique_customers",
        "total_quantity",
        "rank",
    ).orderBy("rank", "book_id")
