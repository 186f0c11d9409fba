from __future__ import annotations

from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from conftest import AS_OF, rows
from pyspark.sql import functions as F

from tallybook.functions import labels
from tallybook.functions.dates import calendar_days_between, period_start
from tallybook.operators import dimensions


def _day(df, day):
    return df.filter(F.col("full_date") == day).first()


def test_calendar(spark):
    df = dimensions.dim_date(spark)
    assert df.count() == 4018
    sunday = _day(df, date(2024, 1, 7))
    assert (sunday.date_id, sunday.day_of_week, sunday.is_weekend) == (20240107, 0, True)
    assert (sunday.day_name, sunday.month_name, sunday.quarter) == ("Sunday", "January", 1)
    saturday = _day(df, date(2024, 1, 6))
    assert (saturday.day_of_week, saturday.is_weekend) == (6, True)


def test_loader_calendar(spark):
    df = dimensions.dim_date(spark, style="mon1")
    sunday = _day(df, date(2024, 1, 7))
    assert (sunday.day_of_week, sunday.is_weekend, sunday.is_holiday) == (7, True, False)
    assert (sunday.fiscal_year, sunday.fiscal_quarter) == (2023, 4)
    april = _day(df, date(2024, 4, 1))
    assert (april.fiscal_year, april.fiscal_quarter) == (2024, 2)
    assert _day(dimensions.dim_date(spark, style="mon1", fiscal="april"), date(2024, 4, 1)).fiscal_quarter == 1
    assert {r.fiscal_quarter for r in df.select("fiscal_quarter").distinct().collect()} == {2, 3, 4}


def test_calendar_arguments(spark):
    with pytest.raises(ValueError):
        dimensions.dim_date(spark, date(2024, 1, 2), date(2024, 1, 1))
    with pytest.raises(ValueError):
        dimensions.dim_date(spark, style="other")
    with pytest.raises(ValueError):
        dimensions.dim_date(spark, style="mon1", fiscal="other")


def test_calendar_covering_data(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 2, 28, 5),), (datetime(2024, 3, 1, 23),)], "ts timestamp_ntz"
    )
    assert rows(dimensions.dim_date_covering(df, "ts"), "date_id") == [(20240228,), (20240229,), (20240301,)]
    assert dimensions.dim_date_covering(df.limit(0), "ts").count() == 0


@pytest.mark.parametrize(
    "location, city, state",
    [
        ("Austin, TX", "Austin", "TX"),
        ("Paris", "Paris", ""),
        ("a, b ,c", "a", "c"),
        ("", "", ""),
        (None, "", ""),
        ("Reno,", "Reno", ""),
        (" Rome\t", "Rome", ""),
    ],
)
def test_location(spark, location, city, state):
    df = spark.createDataFrame([(location,)], "location string")
    assert rows(dimensions.split_location(df), "city", "state") == [(city, state)]


@pytest.mark.parametrize("days, label", [(90, "Low Value"), (91, "Medium Value"), (365, "Medium Value"), (366, "High Value")])
def test_tenure(spark, days, label):
    df = spark.createDataFrame([(AS_OF - timedelta(days=days),)], "d date")
    assert df.select(labels.tenure_segment(F.col("d"), AS_OF)).first()[0] == label


@pytest.mark.parametrize(
    "price, label", [("9.99", "Low"), ("10", "Medium"), ("24.99", "Medium"), ("25", "High"), (None, None)]
)
def test_price_tier(spark, price, label):
    df = spark.createDataFrame([(price and Decimal(price),)], "p decimal(10,2)")
    assert df.select(labels.price_tier(F.col("p"))).first()[0] == label


@pytest.mark.parametrize("year, label", [(2019, "Recent"), (2018, "Classic"), (2004, "Classic"), (2003, "Vintage"), (None, None)])
def test_age_category(spark, year, label):
    df = spark.createDataFrame([(year,)], "y int")
    assert df.select(labels.age_category(F.col("y"), AS_OF)).first()[0] == label


@pytest.mark.parametrize(
    "spent, label",
    [
        ("1000", "High Value"), ("999.99", "Medium Value"), ("500", "Medium Value"), ("499.99", "Low Value"),
        ("100", "Low Value"), ("99.99", "New Customer"), (None, "New Customer"),
    ],
)
def test_spend_segment(spark, spent, label):
    df = spark.createDataFrame([(spent and Decimal(spent),)], "s decimal(18,2)")
    assert df.select(labels.spend_segment(F.col("s"))).first()[0] == label


def test_personal_number_blanked(events):
    assert events.users.filter(F.col("social_security_number").isNotNull()).count() == 0


def test_lifespan_counts_calendar_days(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 1, 23, 59), datetime(2024, 1, 2, 0, 1))], "a timestamp_ntz, b timestamp_ntz"
    )
    assert df.select(calendar_days_between(F.col("a"), F.col("b"))).first()[0] == 1


def test_grains(spark):
    df = spark.createDataFrame([(date(2024, 5, 15),)], "d date")
    starts = {g: df.select(period_start(F.col("d"), g)).first()[0] for g in ("daily", "weekly", "monthly", "yearly")}
    assert starts == {
        "daily": date(2024, 5, 15), "weekly": date(2024, 5, 13), "monthly": date(2024, 5, 1), "yearly": date(2024, 1, 1),
    }
    with pytest.raises(ValueError):
        period_start(F.col("d"), "hourly")


def test_known_label_counts(events):
    def counts(df, col):
        return {r[0]: r[1] for r in df.groupBy(col).count().collect()}

    assert counts(events.books, "price_tier") == {"Low": 200, "Medium": 300, "High": 1500}
    assert counts(events.books, "age_category") == {"Vintage": 1159, "Classic": 582, "Recent": 259}
    assert counts(events.users, "user_segment") == {"High Value": 748, "Medium Value": 564, "Low Value": 188}
