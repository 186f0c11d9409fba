"""Trends and the combined report."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.labels import SPEND_BANDS, SPEND_OTHERWISE
from tallybook.plans.books import category_performance, top_books
from tallybook.plans.customers import customer_segments, top_customers
from tallybook.plans.overview import analytics_overview
from tallybook.plans.sales import daily_sales_trends
from tallybook.star import Star

# Fixed value: changes of at most this many percent count as stable.
STABLE_WITHIN = 1.0


def trend_points(series: DataFrame, metric: str) -> DataFrame:
    """A daily report as points ``(date, value, label)``."""
    return series.select(
        F.col("date"), F.col(metric).cast("double").alias("value"), F.lit(metric).alias("label")
    )


def trend_analysis(series: DataFrame, metric: str = "total_revenue", grain: str = "daily") -> DataFrame:
    """One row: direction and percentage change from the first to the last day, and how well a line fits.

    ``confidence_level`` is the R² of the value against the day; it is 0 where a line cannot be fitted.
    """
    points = trend_points(series, metric).filter(F.col("value").isNotNull())
    day_index = F.datediff(F.col("date"), F.lit(date(1970, 1, 1))).cast("double")
    ends = points.agg(
        F.min_by("value", "date").alias("_first"),
        F.max_by("value", "date").alias("_last"),
        F.count("*").alias("data_points"),
        F.regr_r2(F.col("value"), day_index).alias("_r2"),
    )
    change = F.try_divide((F.col("_last") - F.col("_first")) * 100, F.abs("_first"))
    direction = (
        F.when(F.col("percentage_change") > STABLE_WITHIN, F.lit("up"))
        .when(F.col("percentage_change") < -STABLE_WITHIN, F.lit("down"))
        .otherwise(F.lit("stable"))
    )
    return ends.withColumn("percentage_change", F.round(change, 4)).select(
        F.lit(metric).alias("metric"),
        F.lit(grain).alias("time_range"),
        "data_points",
        direction.alias("trend_direction"),
        "percentage_change",
        F.round(F.coalesce("_r2", F.lit(0.0)), 6).alias("confidence_level"),
    )


def comprehensive(
    star: Star, days: int = 30, limit: int = 5, bands=SPEND_BANDS, otherwise: str = SPEND_OTHERWISE
) -> dict[str, DataFrame]:
    """Every part of the combined report, each a lazy DataFrame."""
    daily = daily_sales_trends(star, days)
    metrics = ("total_revenue", "total_transactions", "unique_customers")
    trends = [trend_analysis(daily, metric) for metric in metrics]
    return {
        "overview": analytics_overview(star),
        "category_performance": category_performance(star),
        "customer_segments": customer_segments(star, bands, otherwise),
        "trends": trends[0].unionByName(trends[1]).unionByName(trends[2]),
        "top_books": top_books(star, limit),
        "top_customers": top_customers(star, limit),
    }
