"""One book and one user hold a third of all sales each, and nothing is small enough to broadcast."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallybook.operators.cleaning import referential_filter
from tallybook.operators.dimensions import dim_date
from tallybook.operators.merging import insert_ignore
from tallybook.operators.ranking import global_ranks
from tallybook.plans import books, customers, summaries, views
from tallybook.star import Star

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
}


@pytest.fixture(scope="module")
def skewed(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    i = F.col("id")
    sales = spark.range(0, 30000, 1, 8).select(
        F.when(i % 3 == 0, F.lit(5)).otherwise(i % 4000).alias("transaction_id"),
        F.when(i % 3 == 1, F.lit(7)).otherwise(i % 301).alias("user_id"),
        F.when(i % 3 == 2, F.lit(11)).otherwise(i % 97).alias("book_id"),
        (F.lit(20240101) + (i % 28).cast("int")).alias("date_id"),
        (i % 1000 / 100).cast("decimal(10,2)").alias("amount"),
        F.lit(1).alias("quantity"),
        F.timestamp_seconds(F.lit(1704067200) + i % 28 * 86400).cast("timestamp_ntz").alias("transaction_timestamp"),
    )
    users = spark.range(301).select(
        i.alias("user_id"), F.concat(F.lit("u"), i).alias("name"), F.lit("s").alias("user_segment"),
        F.current_date().alias("signup_date"),
    )
    all_books = spark.range(97).select(
        i.alias("book_id"), F.concat(F.lit("b"), i).alias("title"), (i % 5).cast("string").alias("category"),
        (i % 9).cast("string").alias("author"),
    )
    yield Star(users, all_books, dim_date(spark), sales)
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_category(skewed):
    plain = skewed.sales.join(skewed.books, "book_id").groupBy("category").agg(
        F.count("transaction_id"), F.sum("amount").cast("decimal(18,2)"), F.countDistinct("user_id"), F.countDistinct("book_id")
    )
    got = books.category_performance(skewed)
    assert rows(got, "category", "total_sales", "total_revenue", "unique_customers", "unique_books") == rows(plain)


def test_top_lists(skewed):
    joined = skewed.sales.join(skewed.books, "book_id")
    plain = joined.groupBy("book_id").agg(F.sum("amount").alias("r"), F.countDistinct("user_id").alias("u"))
    best = plain.orderBy(F.desc("r"), "book_id").limit(10)
    assert rows(books.top_books(skewed), "book_id", "total_revenue", "unique_customers") == rows(best)
    plain = skewed.sales.groupBy("user_id").agg(F.sum("amount").alias("r"), F.countDistinct("book_id").alias("u"))
    best = plain.orderBy(F.desc("r"), "user_id").limit(20)
    assert rows(customers.top_customers(skewed), "user_id", "total_spent", "unique_books_purchased") == rows(best)


def test_user_view(skewed):
    plain = (
        skewed.users.join(skewed.sales, "user_id", "left").join(skewed.books, "book_id", "left")
        .groupBy("user_id")
        .agg(F.countDistinct("transaction_id"), F.countDistinct("book_id"), F.countDistinct("category"))
    )
    got = views.v_user_behavior(skewed)
    assert rows(got, "user_id", "total_transactions", "unique_books_purchased", "unique_categories") == rows(plain)


def test_summaries(skewed):
    plain = skewed.sales.groupBy("date_id").agg(F.count("*"), F.countDistinct("user_id"))
    got = summaries.daily_sales_summary(skewed.sales)
    assert rows(got, "date_id", "transaction_count", "unique_users") == rows(plain)


def test_first_row_per_hot_key(skewed):
    kept = insert_ignore(skewed.sales, "transaction_id", "transaction_timestamp", "user_id", "book_id", "amount")
    assert kept.count() == skewed.sales.select("transaction_id").distinct().count()
    first = kept.filter("transaction_id = 5").first()
    assert first.transaction_timestamp == skewed.sales.filter("transaction_id = 5").agg(F.min("transaction_timestamp")).first()[0]


def test_references_and_ranks(skewed):
    known = skewed.users.filter("user_id <> 3").select(F.col("user_id").alias("id"))
    kept = referential_filter(skewed.sales, known, skewed.books)
    assert kept.count() == skewed.sales.filter("user_id <> 3").count()
    ranked = global_ranks(skewed.sales, {"book_id": "r"}, 8)
    assert ranked.count() == 30000
    top = ranked.filter("book_id = 96").select("r").distinct().collect()
    assert [t.r for t in top] == [1]
    hot = ranked.filter("book_id = 11").select("r").distinct().collect()
    assert [t.r for t in hot] == [skewed.sales.filter("book_id > 11").count() + 1]
