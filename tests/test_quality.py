from __future__ import annotations

from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallybook.functions import rules
from tallybook.operators import quality
from tallybook.operators.facts import date_range, sales_between
from tallybook.operators.paging import page


def test_split_is_complete_and_names_reasons(spark):
    df = spark.createDataFrame([(1, 5), (2, -5), (None, -1), (None, 3), (4, None)], "k int, v int")
    checks = {"k missing": F.col("k").isNotNull(), "v negative": rules.not_negative(F.col("v"))}
    ok, rejected = quality.split_rejects(df, checks)
    assert ok.count() + rejected.count() == df.count()
    assert rows(ok) == [(1, 5), (4, None)]
    assert rows(quality.reject_counts(rejected)) == [("k missing", 2), ("v negative", 2)]


def test_unique_and_foreign_key(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,)], "k int")
    assert rows(quality.check_unique(df, "k")) == [(1, 2)]
    assert rows(quality.check_foreign_key(df, parent, "k")) == [(2,)]
    assert rows(quality.check_not_null(df, ["k"]), "k") == [(None,)]


@pytest.mark.parametrize(
    "email, fine", [(None, True), ("a@b", False), ("A.b+c@Ex-ample.ORG", True), ("a b@c.de", False), ("a@b.c", False)]
)
def test_email(spark, email, fine):
    df = spark.createDataFrame([(email,)], "e string")
    assert df.select(rules.valid_email(F.col("e"))).first()[0] is fine


@pytest.mark.parametrize("year, fine", [(1899, False), (1900, True), (2025, True), (2026, False), (None, True)])
def test_publication_year(spark, year, fine):
    df = spark.createDataFrame([(year,)], "y int")
    assert df.select(rules.valid_publication_year(F.col("y"), date(2024, 6, 1))).first()[0] is fine


def test_calendar_rule(spark):
    df = spark.createDataFrame([(date(2019, 12, 31),), (date(2020, 1, 1),)], "d date")
    broken = quality.check_rules(df, {"too early": rules.valid_calendar_day(F.col("d"))})
    assert rows(broken) == [(date(2019, 12, 31), ["too early"])]


def test_page(spark):
    df = spark.range(10)
    assert [r.id for r in page(df, "id", limit=3, offset=4).collect()] == [4, 5, 6]
    assert [r.id for r in page(df, "id", limit=2, ascending=False).collect()] == [9, 8]
    for bad in ({"limit": 0}, {"limit": 1001}, {"offset": -1}):
        with pytest.raises(ValueError):
            page(df, "id", **bad)
    with pytest.raises(ValueError):
        page(df)


def test_ranges(spark, events):
    days = spark.createDataFrame([(date(2024, 1, d),) for d in (1, 2, 3)], "full_date date")
    assert date_range(days).count() == 3
    assert date_range(days, start=date(2024, 1, 2)).count() == 2
    assert date_range(days, end=date(2024, 1, 2)).count() == 2
    with pytest.raises(ValueError):
        date_range(days, date(2024, 1, 2), date(2024, 1, 1))
    with pytest.raises(ValueError):
        sales_between(events.sales, date(2024, 1, 2), date(2024, 1, 1))
    window = sales_between(events.sales, date(2024, 1, 8), date(2024, 1, 21))
    assert window.count() == events.sales.filter("date_id between 20240108 and 20240121").count()
