"""Whole-table figures: totals, table counts, data status, table statistics."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.dates import day
from tallybook.functions.money import ratio, total
from tallybook.operators.combining import one_row
from tallybook.plans.books import sales_per_book
from tallybook.plans.customers import (
    geographic_distribution,
    retention_metrics,
    user_segment_counts,
)
from tallybook.plans.sales import hourly_pattern, recent_sales
from tallybook.star import Star


# Fixed value: standard error of a sketched distinct count. Several standard errors stay well below 15 percent.
SKETCH_ERROR = 0.02


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def sales_summary(star: Star) -> DataFrame:
    """One row over all sales: totals, averages, distinct counts, first and last sale.

    One aggregate per distinct column, each reading its own column only.
    """
    calendar = star.dates.select("date_id", "full_date")
    sales = star.sales.join(calendar, "date_id")
    totals = sales.agg(
        total("amount").alias("total_revenue"),
        ratio(total("amount"), F.count("amount")).alias("avg_transaction_value"),
        F.min("transaction_timestamp").alias("first_sale_date"),
        F.max("transaction_timestamp").alias("last_sale_date"),
    )
    distinct = {
        "total_transactions": "transaction_id",
        "total_customers": "user_id",
        "total_books": "book_id",
        "days_with_sales": "full_date",
    }
    counts = [sales.agg(F.countDistinct(col).alias(name)) for name, col in distinct.items()]
    return one_row(totals, *counts).select(
        "total_transactions",
        "total_revenue",
        "avg_transaction_value",
        "total_customers",
        "total_books",
        "first_sale_date",
        "last_sale_date",
        "days_with_sales",
    )


def analytics_overview(star: Star) -> DataFrame:
    """One row: users, transactions, revenue, books, average, best category, most active user.

    Equal leaders are decided by the smaller key.
    """
    sales = star.sales.agg(
        F.count("*").alias("total_transactions"),
        total("amount").alias("total_revenue"),
        ratio(total("amount"), F.count("amount")).alias("average_transaction_value"),
    )
    best_category = (
        sales_per_book(star.sales)
        .join(star.books.select("book_id", "category"), "book_id")
        .groupBy("category")
        .agg(total("total_revenue").alias("_revenue"))
        .orderBy(F.col("_revenue").desc(), "category")
        .limit(1)
        .select(F.col("category").alias("top_category"))
    )
    busiest_user = (
        star.sales.groupBy("user_id")
        .agg(F.count("*").alias("_n"))
        .orderBy(F.col("_n").desc(), "user_id")
        .limit(1)
        .select(F.col("user_id").alias("most_active_user"))
    )
    return one_row(
        star.users.agg(F.count("*").alias("total_users")),
        sales,
        star.books.agg(F.count("*").alias("total_books")),
        best_category,
        busiest_user,
    ).select(
        "total_users",
        "total_transactions",
        "total_revenue",
        "total_books",
        "average_transaction_value",
        "top_category",
        "most_active_user",
    )


def table_counts(star: Star) -> DataFrame:
    """Row count of the fact and of each dimension."""
    named = {
        "fact_sales": star.sales,
        "dim_date": star.dates,
        "dim_books": star.books,
        "dim_users": star.users,
    }
    return _stack(
        [
            df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
            for name, df in named.items()
        ]
    )


def fact_date_range(star: Star) -> DataFrame:
    """First day, last day and number of days with sales. Days are made distinct in the map tasks."""
    dated = star.sales.select("date_id").join(star.dates.select("date_id", "full_date"), "date_id")
    return dated.agg(
        F.min("full_date").alias("earliest_date"),
        F.max("full_date").alias("latest_date"),
        F.countDistinct("full_date").alias("unique_dates"),
    )


def status_probes(star: Star, as_of: date | None = None) -> dict[str, Callable[[], DataFrame]]:
    """The probes of ``data_status`` by name."""
    today = day(as_of)
    return {
        "table_counts": lambda: table_counts(star),
        "fact_sales_date_range": lambda: fact_date_range(star),
        "current_date": lambda: star.dates.sparkSession.range(1).select(today.alias("current_date")),
        "recent_sales": lambda: recent_sales(star, 30, 10, as_of),
    }


def data_status(star: Star, as_of: date | None = None) -> dict[str, dict]:
    """Run every probe; a probe that fails reports its error and does not stop the others.

    Each probe returns a handful of rows.
    """
    results: dict[str, dict] = {}
    for name, probe in status_probes(star, as_of).items():
        try:
            results[name] = {"data": [row.asDict() for row in probe().collect()]}
        except PySparkException as error:
            results[name] = {"error": str(error)}
    return results


def data_status_report(star: Star, as_of: date | None = None) -> DataFrame:
    """The same probes as rows ``(probe, item, value)`` in one lazy plan.

    Each probe is planned on its own: one that names a missing table or column becomes a row ``(probe, "error",
    error class)`` and the others answer.
    """

    def rows(df: DataFrame, item: Column, value: Column) -> DataFrame:
        return df.select(item.cast("string").alias("item"), value.cast("string").alias("value"))

    def span(df: DataFrame) -> DataFrame:
        names = ("earliest_date", "latest_date", "unique_dates")
        each = [F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("value")) for c in names]
        return df.select(F.inline(F.array(*each)))

    both = F.concat_ws(" / ", F.col("transactions").cast("string"), F.col("revenue").cast("string"))
    shapes = {
        "table_counts": lambda df: rows(df, F.col("table_name"), F.col("row_count")),
        "fact_sales_date_range": span,
        "current_date": lambda df: rows(df, F.lit("current_date"), F.col("current_date")),
        "recent_sales": lambda df: rows(df, F.col("full_date"), both),
    }
    spark = star.dates.sparkSession
    parts = []
    for name, probe in status_probes(star, as_of).items():
        try:
            part = shapes[name](probe())
        except PySparkException as error:
            kind = F.lit(error.getCondition())
            part = spark.range(1).select(F.lit("error").alias("item"), kind.alias("value"))
        parts.append(part.select(F.lit(name).alias("probe"), "item", "value"))
    return _stack(parts)


def user_behavior_rows(star: Star) -> DataFrame:
    """Segments, hours, retention and states as rows ``(section, item, value)``."""
    parts = {
        "user_segments": (user_segment_counts(star), "user_segment", "user_count"),
        "hourly_distribution": (hourly_pattern(star), "hour", "transaction_count"),
        "retention_metrics": (retention_metrics(star), "metric", "retention_rate"),
        "geographic_distribution": (geographic_distribution(star, 10), "state", "user_count"),
    }
    return _stack(
        [
            df.select(
                F.lit(section).alias("section"),
                F.col(item).cast("string").alias("item"),
                F.col(value).cast("double").alias("value"),
            )
            for section, (df, item, value) in parts.items()
        ]
    )


def user_behavior_analytics(star: Star) -> DataFrame:
    """The same as one row of maps. Every map has as many entries as there are segments, hours, period
    lengths or listed states."""

    def as_map(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
        kept = df.filter(F.col(key).isNotNull())
        return kept.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))

    segments = as_map(user_segment_counts(star), "user_segment", "user_count", "user_segments")
    hours = hourly_pattern(star).agg(
        F.array_sort(F.collect_list(F.struct("hour", "transaction_count"))).alias("hourly_distribution")
    )
    rates = as_map(retention_metrics(star), "metric", "retention_rate", "retention_metrics")
    states = as_map(
        geographic_distribution(star, 10), "state", "user_count", "geographic_distribution"
    )
    parts = (segments, hours, rates, states)
    names = [c for part in parts for c in part.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.any_value(c, F.lit(True)).alias(c) for c in names])


def table_stats(star: Star, distinct: str = "exact") -> DataFrame:
    """Rows, missing values and distinct values of every column of the star.

    ``distinct="approx"`` sketches the distinct counts in one pass without a shuffle of values; ``"exact"``
    shuffles each column's distinct values once, spread over all tasks by value.
    """
    if distinct not in ("exact", "approx"):
        raise ValueError(f"distinct must be 'exact' or 'approx', got {distinct!r}")
    measure = _exact_column_stats if distinct == "exact" else _approx_column_stats
    tables = {"fact_sales": star.sales, "dim_users": star.users, "dim_books": star.books, "dim_date": star.dates}
    return _stack(
        [
            measure(df).select(
                F.lit(name).alias("table_name"), "column_name", "row_count", "null_count", "distinct_count"
            )
            for name, df in tables.items()
        ]
    )


def _approx_column_stats(df: DataFrame) -> DataFrame:
    per_column = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count("*").alias("row_count"),
            F.count_if(F.col(c).isNull()).alias("null_count"),
            F.approx_count_distinct(c, SKETCH_ERROR).alias("distinct_count"),
        )
        for c in df.columns
    ]
    return df.agg(F.array(*per_column).alias("stats")).select(F.inline("stats"))


def _exact_column_stats(df: DataFrame) -> DataFrame:
    """One narrow aggregate per column on its own type: values are counted in the map tasks and only distinct ones
    are shuffled; rows are never multiplied."""

    def one(c: str) -> DataFrame:
        values = df.groupBy(F.col(c).alias("cell")).agg(F.count("*").alias("_n"))
        return values.agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
            F.coalesce(F.sum(F.when(F.col("cell").isNull(), F.col("_n"))), F.lit(0)).alias("null_count"),
            F.count("cell").alias("distinct_count"),
        ).select(F.lit(c).alias("column_name"), "row_count", "null_count", "distinct_count")

    return _stack([one(c) for c in df.columns])
