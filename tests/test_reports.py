from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import AS_OF, rows
from pyspark.sql import functions as F

from tallybook.operators.dimensions import dim_date
from tallybook.operators.facts import fact_sales
from tallybook.plans import books, customers, dashboard, insights, overview, sales, summaries, views
from tallybook.star import Star


@pytest.fixture(scope="module")
def small(spark):
    """Three users, three books, five sales; one user and one book without sales."""
    users = spark.createDataFrame(
        [(1, "Ann", "High Value"), (2, "Bob", "Low Value"), (3, "Cy", "Low Value")],
        "user_id bigint, name string, user_segment string",
    ).select(
        "*", F.lit("a@b.cd").alias("email"), F.lit("X, Y").alias("location"), F.lit("Y").alias("state"),
        F.lit("X").alias("city"), F.lit(date(2023, 1, 1)).alias("signup_date"),
        F.lit(None).cast("string").alias("social_security_number"),
    )
    all_books = spark.createDataFrame(
        [(1, "A", "Fiction", "P"), (2, "B", "Fiction", "Q"), (3, "C", "Poetry", "P")],
        "book_id bigint, title string, category string, author string",
    ).select("*", F.lit(Decimal("9.99")).cast("decimal(10,2)").alias("base_price"))
    moments = [
        (1, 1, 1, "5.00", datetime(2024, 1, 1, 23, 59)),
        (2, 1, 1, "5.00", datetime(2024, 1, 2, 0, 1)),
        (3, 1, 2, "10.00", datetime(2024, 2, 1, 9)),
        (4, 2, 1, "1.00", datetime(2024, 2, 1, 9)),
        (5, 2, 9, "7.00", datetime(2024, 3, 1, 9)),
    ]
    tx = spark.createDataFrame(
        [(t, u, b, Decimal(a), m) for t, u, b, a, m in moments],
        "transaction_id bigint, user_id bigint, book_id bigint, amount decimal(10,2), timestamp timestamp_ntz",
    )
    return Star(users, all_books, dim_date(spark), fact_sales(tx))


def test_window_includes_both_ends(small):
    got = rows(sales.daily_sales_trends(small, 29), "date", "total_transactions", "unique_customers")
    assert got == [(date(2024, 2, 1), 2, 2), (date(2024, 3, 1), 1, 1)]
    assert sales.daily_sales_trends(small, 28).count() == 1
    assert sales.daily_sales(small).count() == 2
    assert sales.daily_sales(small, date(2024, 1, 1), date(2024, 1, 2)).count() == 2


def test_days_covered(events):
    assert sales.daily_sales_trends(events, 7).count() == 8


def test_range_checked(events):
    with pytest.raises(ValueError):
        sales.daily_sales_by_range(events, date(2024, 1, 2), date(2024, 1, 1))


def test_books_without_dimension_row_are_left_out(small):
    assert rows(books.top_books(small), "book_id", "total_revenue", "unique_customers") == [
        (1, Decimal("11.00"), 2), (2, Decimal("10.00"), 1),
    ]
    assert rows(books.category_performance(small), "category", "total_sales", "unique_books", "unique_customers") == [
        ("Fiction", 4, 2, 2)
    ]
    assert rows(books.author_performance(small), "author", "books_written") == [("P", 1), ("Q", 1)]


def test_lifespan(small):
    got = {r.user_id: r.customer_lifespan_days for r in customers.user_analytics(small).collect()}
    assert got == {1: 31, 2: 29}


def test_view_keeps_users_without_sales(small):
    got = {r.user_id: r for r in views.v_user_behavior(small).collect()}
    assert (got[3].total_transactions, got[3].total_spent, got[3].unique_categories) == (0, None, 0)
    assert (got[1].total_transactions, got[1].unique_books_purchased, got[1].unique_categories) == (3, 2, 1)
    # A book missing from the dimension still counts as a book bought, not as a category.
    assert (got[2].unique_books_purchased, got[2].unique_categories) == (2, 1)


def test_book_without_sales_comes_last(small):
    got = summaries.books_by_category(small, "Fiction").collect()
    assert [r.book_id for r in got] == [1, 2]
    assert [r.total_sales for r in summaries.books_by_category(small, "Poetry").collect()] == [None]


def test_retention(small):
    got = [tuple(r) for r in customers.retention(small).collect()]
    assert got == [
        (date(2024, 1, 1), 1, 1, 1.0), (date(2024, 2, 1), 2, 1, 0.5), (date(2024, 3, 1), 1, None, None),
    ]
    rates = {r.metric: r.retention_rate for r in customers.retention_metrics(small).collect()}
    assert rates == {"monthly_retention": 2 / 3, "quarterly_retention": None, "annual_retention": None}
    with pytest.raises(ValueError):
        customers.retention(small, "daily")


def test_user_history(small):
    history = customers.user_history(small, 1, limit=2)
    assert [r.transaction_id for r in history["purchases"].collect()] == [3, 2]
    assert tuple(history["pagination"].first()) == (3, 2, 0)
    analytics = history["analytics"].first()
    assert (analytics.total_transactions, analytics.total_spent) == (3, Decimal("20.00"))
    assert analytics.favorite_category == "Fiction" and analytics.user_segment == "High Value"
    nobody = customers.user_history(small, 3)["analytics"].first()
    assert (nobody.total_transactions, nobody.total_spent, nobody.favorite_category) == (0, None, None)
    ranged = customers.user_history(small, 1, start=date(2024, 2, 1), include_analytics=False)
    assert "analytics" not in ranged and ranged["purchases"].count() == 1
    assert customers.user_transactions(small, 1, limit=1).first().transaction_id == 3


def test_kpis(spark, small):
    daily = sales.daily_sales_trends(small, 90)
    kpis = dashboard.revenue_kpis(daily).first()
    assert (kpis.total_revenue, kpis.total_transactions, kpis.days_with_sales) == (28.0, 5.0, 4)
    assert kpis.avg_transaction_value == pytest.approx(5.6)
    users = dashboard.active_user_kpis(daily).first()
    assert (users.avg_daily_users, users.max_daily_users) == (1.25, 2.0)
    assert tuple(dashboard.revenue_kpis(daily.limit(0)).first()) == (0.0, 0.0, 0.0, 0)
    assert tuple(dashboard.active_user_kpis(daily.limit(0)).first()) == (0.0, 0.0)
    text = spark.createDataFrame([("12.5",), ("x",), (None,)], "v string")
    assert [r.v for r in dashboard.coerce_numeric(text, ["v"]).collect()] == [12.5, 0.0, 0.0]


def test_column_fallbacks(spark):
    a = spark.createDataFrame([("2024-01-01", "5", 3, 2)], "date string, total_revenue string, total_transactions int, total_customers int")
    assert rows(dashboard.revenue_trend(a)) == [(date(2024, 1, 1), 5.0, 3.0)]
    assert rows(dashboard.active_users(a)) == [(date(2024, 1, 1), 2.0, 3.0)]
    b = a.withColumn("transaction_count", F.lit(9)).drop("total_customers")
    assert rows(dashboard.active_users(b)) == [(date(2024, 1, 1), 0.0, 9.0)]
    s = spark.createDataFrame([("High", 2, 10.0)], "segment string, customer_count int, total_revenue double")
    assert rows(dashboard.segment_series(s)) == [("High", 2.0, 10.0, 0.0)]


def test_market_share_sums_to_hundred(events):
    shares = dashboard.market_share(books.category_performance(events))
    assert shares.agg(F.sum("market_share")).first()[0] == pytest.approx(100)


@pytest.mark.parametrize(
    "values, direction, change, fit",
    [((1, 2, 3), "up", 200.0, 1.0), ((4, 2), "down", -50.0, 1.0), ((5, 9, 5), "stable", 0.0, 0.0), ((5,), "stable", 0.0, 0.0)],
)
def test_trend(spark, values, direction, change, fit):
    series = spark.createDataFrame([(date(2024, 1, i + 1), float(v)) for i, v in enumerate(values)], "date date, total_revenue double")
    got = insights.trend_analysis(series).first()
    assert (got.trend_direction, got.percentage_change, got.confidence_level) == (direction, change, fit)
    assert got.data_points == len(values)


def test_ranking_arguments(events):
    for bad in ({"metric": "other"}, {"limit": 0}, {"limit": 101}, {"grain": "hourly"}):
        with pytest.raises(ValueError):
            books.top_books_by_metric(events, **bad)
    today = books.top_books_by_metric(events, "sales_count", grain="daily", as_of=AS_OF, limit=100)
    assert today.agg(F.sum("total_sales")).first()[0] == events.sales.filter("date_id = 20240130").count()


def test_known_totals(events):
    summary = overview.sales_summary(events).first()
    assert (summary.total_transactions, summary.total_revenue) == (1981, Decimal("95455.77"))
    assert (summary.total_customers, summary.total_books, summary.days_with_sales) == (150, 100, 30)
    segments = {r.segment: (r.customer_count, r.total_revenue) for r in customers.customer_segments(events).collect()}
    assert segments == {
        "Medium Value": (98, Decimal("66385.21")), "Low Value": (41, Decimal("16407.85")), "High Value": (11, Decimal("12662.71")),
    }
    assert overview.analytics_overview(events).first().most_active_user == 41
    states = {r.state: r.user_count for r in customers.geographic_distribution(events).collect()}
    assert states == {"ASIA": 312, "EUROPE": 305, "AMERICA": 302, "MIDDLE EAST": 295, "AFRICA": 286}


def test_totals_agree(events):
    revenue = events.sales.agg(F.sum("amount")).first()[0]
    daily = sales.daily_sales_by_range(events, date(2024, 1, 1), date(2024, 1, 31))
    assert daily.agg(F.sum("total_revenue")).first()[0] == revenue
    stored = summaries.daily_summary(events)
    assert rows(stored, "full_date", "total_revenue", "transaction_count", "unique_users") == rows(
        daily, "date", F.col("total_revenue").cast("decimal(15,2)"), "total_transactions", "unique_customers"
    )
    for grain in ("daily", "weekly", "monthly", "yearly"):
        assert sales.sales_by_grain(events, grain).agg(F.sum("total_revenue")).first()[0] == revenue
    buyers = events.sales.select("user_id").distinct().count()
    assert customers.customer_segments(events).agg(F.sum("customer_count")).first()[0] == buyers
    total = views.sales_filtered_total(events).first()
    assert (total.total_records, total.total_revenue) == (events.sales.count(), revenue)


def test_maps(events):
    maps = overview.user_behavior_analytics(events).first()
    assert maps.user_segments == {"High Value": 748, "Medium Value": 564, "Low Value": 188}
    assert [h.hour for h in maps.hourly_distribution] == list(range(24))
    assert sum(h.transaction_count for h in maps.hourly_distribution) == 1981
    assert set(maps.retention_metrics) == {"monthly_retention", "quarterly_retention", "annual_retention"}
    assert maps.geographic_distribution["ASIA"] == 312


def test_table_stats(events):
    exact = {(r.table_name, r.column_name): r for r in overview.table_stats(events).collect()}
    approx = {(r.table_name, r.column_name): r for r in overview.table_stats(events, "approx").collect()}
    assert exact.keys() == approx.keys()
    for key, row in exact.items():
        other = approx[key]
        assert (row.row_count, row.null_count) == (other.row_count, other.null_count)
        assert other.distinct_count == pytest.approx(row.distinct_count, rel=0.2, abs=1)
    with pytest.raises(ValueError):
        overview.table_stats(events, "other")


def test_sketched_counts_of_unlucky_ids(spark, events):
    """Sketches of a standard error of 0.05 count these ids 18 percent too high."""
    ids = spark.range(3_435_000, 3_440_000).select(F.col("id").alias("transaction_id"))
    stats = overview.table_stats(events.replace(sales=ids), "approx").filter("table_name = 'fact_sales'").first()
    assert stats.distinct_count == pytest.approx(5_000, rel=0.15)


def test_empty_sales(events):
    nothing = events.replace(sales=events.sales.filter("date_id < 0"))
    assert sales.daily_sales_trends(nothing).count() == 0
    assert books.top_books(nothing).count() == 0
    assert customers.customer_segments(nothing).count() == 0
    summary = overview.sales_summary(nothing).first()
    assert (summary.total_transactions, summary.total_revenue) == (0, None)
    one = overview.analytics_overview(nothing).first()
    assert (one.total_users, one.total_transactions, one.top_category) == (1500, 0, None)
    assert views.v_user_behavior(nothing).count() == 1500


def test_comprehensive(events):
    report = insights.comprehensive(events)
    assert set(report) == {
        "overview", "category_performance", "customer_segments", "trends", "top_books", "top_customers",
    }
    assert report["trends"].count() == 3 and report["top_books"].count() == 5
