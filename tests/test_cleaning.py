from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallybook.functions import parsing
from tallybook.operators import cleaning
from tallybook.operators.facts import fact_sales
from tallybook.operators.merging import insert_ignore
from tallybook.operators.quality import not_null_rules, split_rejects

TRANSACTIONS = [
    ("1", "10", "100.0", "19.99", "2024-01-05 10:00:00"),
    ("2", "10", "101", "0", "2024-01-05 23:59:59"),
    ("3", "11", "100", "10000", "2024-01-06 00:00:00"),
    ("4", "11", "100", "10000.01", "2024-01-06 00:00:00"),
    ("5", "11", "100", "-0.01", "2024-01-06 00:00:00"),
    ("6", "abc", "100", "5", "2024-01-06 00:00:00"),
    ("7", "10", "12.7", "5", "2024-01-06 00:00:00"),
    ("8", "10", "100", "5", "2024-02-30 00:00:00"),
    ("9", "10", "100", "5", "2024-01-06"),
    (None, "10", "100", "5", "2024-01-06 01:00:00"),
    ("11", "99", "100", "5", "2024-01-06 01:00:00"),
    ("1", "10", "100", "7", "2024-01-07 00:00:00"),
    ("12", "10", "", "5", "2024-01-07 00:00:00"),
]


@pytest.fixture(scope="module")
def transactions(spark):
    return spark.createDataFrame(
        TRANSACTIONS, "transaction_id string, user_id string, book_id string, amount string, timestamp string"
    )


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(10,), (11,)], "id bigint")


@pytest.fixture(scope="module")
def books(spark):
    return spark.createDataFrame([(100,), (101,)], "book_id bigint")


def test_transactions_cleaned(transactions):
    kept = rows(cleaning.clean_transactions(transactions), "transaction_id", "book_id", "amount")
    assert kept == sorted(
        [
            (1, 100, Decimal("19.99")),
            (2, 101, Decimal("0.00")),
            (3, 100, Decimal("10000.00")),
            (7, 12, Decimal("5.00")),
            (None, 100, Decimal("5.00")),
            (11, 100, Decimal("5.00")),
            (1, 100, Decimal("7.00")),
        ],
        key=str,
    )


def test_bounds_apply_before_rounding(spark):
    df = spark.createDataFrame(
        [("1", "1", "1", "10000.004", "2024-01-06 00:00:00")],
        "transaction_id string, user_id string, book_id string, amount string, timestamp string",
    )
    assert cleaning.clean_transactions(df).count() == 0
    assert cleaning.clean_transactions(df, hi=20000).count() == 1


def test_references(transactions, users, books):
    clean = cleaning.clean_transactions(transactions)
    kept = cleaning.referential_filter(clean, users, books)
    removed = cleaning.referential_rejects(clean, users, books)
    assert kept.count() == 5
    assert rows(removed, "transaction_id") == [(11,), (7,)]
    assert set(kept.columns) == set(removed.columns) == set(clean.columns)


def test_fact_keeps_first_row_per_transaction(transactions, users, books):
    kept = cleaning.referential_filter(cleaning.clean_transactions(transactions), users, books)
    fact = fact_sales(kept)
    ok, rejected = split_rejects(fact, not_null_rules(["transaction_id"]))
    assert rows(rejected, "reject_reasons") == [(["transaction_id is null"],)]
    stored = insert_ignore(ok, "transaction_id", "transaction_timestamp")
    assert rows(stored, "transaction_id", "amount", "date_id", "quantity") == [
        (1, Decimal("19.99"), 20240105, 1),
        (2, Decimal("0.00"), 20240105, 1),
        (3, Decimal("10000.00"), 20240106, 1),
    ]


def test_users_cleaned(spark):
    df = spark.createDataFrame(
        [("10", "2023-01-01"), ("11", "2024-01-10"), ("x", "2024-01-01"), ("13", "01/02/2024"), ("14", None)],
        "id string, signup_date string",
    )
    assert rows(cleaning.clean_users(df)) == [(10, date(2023, 1, 1)), (11, date(2024, 1, 10))]


def test_books_cleaned(spark):
    df = spark.createDataFrame(
        [("1", "1999", "x", "9.995"), (None, "2000", "10", "5"), ("2.0", "2000", "10", "5"), ("3", "", "7", "n/a")],
        "book_id string, publication_year string, pages string, base_price string",
    )
    assert rows(cleaning.clean_books(df)) == [
        (1, 1999, None, Decimal("10.00")),
        (3, None, 7, None),
    ]


@pytest.mark.parametrize(
    "text, whole, via_double, number",
    [
        ("12", 12, 12, 12.0),
        ("+5", 5, 5, 5.0),
        ("0012", 12, 12, 12.0),
        (" 12", None, None, None),
        ("12 ", None, None, None),
        ("12.7", None, 12, 12.7),
        ("-12.7", None, -12, -12.7),
        ("1e3", None, 1000, 1000.0),
        ("12d", None, None, None),
        ("1_0", None, None, None),
        ("", None, None, None),
        ("1e30", None, None, 1e30),
        (None, None, None, None),
    ],
)
def test_number_forms(spark, text, whole, via_double, number):
    c = F.col("v")
    df = spark.createDataFrame([(text,)], "v string").select(
        parsing.parse_long(c), parsing.parse_long_via_double(c), parsing.parse_double(c)
    )
    assert tuple(df.first()) == (whole, via_double, number)


@pytest.mark.parametrize(
    "text, day, moment",
    [
        ("2024-01-05", date(2024, 1, 5), None),
        ("2024-1-5", date(2024, 1, 5), None),
        ("2024-02-30", None, None),
        ("2024-01-05 ", None, None),
        ("2024-01-05x", None, None),
        ("2024-01-05 10:00:00", None, datetime(2024, 1, 5, 10)),
        ("2024-01-05 1:2:3", None, datetime(2024, 1, 5, 1, 2, 3)),
        ("2024-01-05T10:00:00", None, None),
        ("2024-01-05 10:00:00.5", None, None),
        ("2024-01-05 25:00:00", None, None),
        ("2024-03-10 02:30:00", None, datetime(2024, 3, 10, 2, 30)),
    ],
)
def test_date_forms(spark, text, day, moment):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        c = F.col("v")
        df = spark.createDataFrame([(text,)], "v string")
        got = df.select(parsing.parse_date(c), parsing.parse_timestamp(c)).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert tuple(got) == (day, moment)


def test_projections(spark, transactions):
    users = spark.createDataFrame(
        [(1, "A", "a@b.cd", "X, Y", date(2024, 1, 2), "123")],
        "id bigint, name string, email string, location string, signup_date date, social_security_number string",
    )
    projected = cleaning.users_projection(users)
    assert projected.columns == [
        "user_id", "name", "email", "location", "signup_date", "social_security_number",
    ]
    assert rows(projected) == [(1, "A", "a@b.cd", "X, Y", "2024-01-02", None)]
    sales = cleaning.sales_projection(cleaning.clean_transactions(transactions).filter("transaction_id = 2"))
    assert rows(sales) == [(2, 10, 101, 20240105, Decimal("0.00"), 1, 0.0, "2024-01-05 23:59:59")]


def test_text_repairs(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "abcdef")], "id int, t string")
    assert rows(cleaning.fill_null_text(df)) == [(1, ""), (2, ""), (3, "abcdef")]
    assert rows(cleaning.null_empty_text(df)) == [(1, None), (2, None), (3, "abcdef")]
    assert rows(cleaning.truncate_text(df, {"t": 3, "absent": 1})) == [(1, None), (2, ""), (3, "abc")]
    broken = spark.createDataFrame([(bytearray(b"a\xffb"),)], "b binary").select(F.col("b").cast("string").alias("t"))
    assert rows(cleaning.repair_utf8(broken)) == [("a�b",)]
    blank = cleaning.null_out(df, ["t"])
    assert blank.schema == df.schema and rows(blank, "t") == [(None,)] * 3


def test_negative_amounts_dropped(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-0.01,), (None,)], "amount double")
    assert rows(cleaning.drop_negative(df)) == [(0.0,), (1.0,)]
