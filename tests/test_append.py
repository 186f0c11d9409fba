"""Key filters, seek paging and mergeable distinct counts."""

from __future__ import annotations

import pytest
from conftest import AS_OF, DATA, rows
from pyspark.sql import functions as F

from tallybook.bindings import raw_feeds
from tallybook.operators import paging
from tallybook.pipeline import load_all
from tallybook.plans import distinct_state, summaries
from tallybook.sources import keyfilter, manifest


def test_filters_never_miss_and_seldom_err(spark):
    keys = spark.range(200_000).select(F.concat(F.lit("t"), "id").alias("k"), F.concat(F.lit("f"), F.col("id") % 7).alias("f"))
    filters = keyfilter.key_filters(keys.unionByName(keys.limit(5).withColumn("k", F.lit(None))), "k", "f").persist()
    held = keyfilter.possible(keys.select("k"), "k", filters)
    right = held.join(keys.withColumnRenamed("f", "file"), ["k", "file"], "left_semi")
    assert right.count() == 200_000
    assert held.filter("file = ''").count() == 200_000
    strange = spark.range(100_000).select(F.concat(F.lit("x"), "id").alias("k"))
    assert keyfilter.possible(strange, "k", filters.filter("file = ''")).count() < 500
    assert keyfilter.possible(keys.limit(0).select("k"), "k", filters).count() == 0
    assert keyfilter.possible(strange, "k", filters.limit(0)).count() == 0


def test_an_append_reads_only_files_that_may_hold_its_keys(spark, tmp_path):
    root = str(tmp_path)
    sales = spark.range(9000).select(
        F.concat(F.lit("t"), "id").alias("transaction_id"), F.col("id").alias("user_id"), (20240101 + F.col("id") % 9).cast("int").alias("date_id")
    )
    for load, day in (("load=a", "date_id < 20240105"), ("load=b", "date_id >= 20240105")):
        sales.filter(day).write.partitionBy("date_id").parquet(f"{root}/fact/{load}")
    loads, schema = ["load=a", "load=b"], sales.schema
    assert keyfilter.add_filters(spark, root, "fact", loads, [], "transaction_id", schema) == loads
    new = sales.filter("date_id = 20240103").limit(40).unionByName(sales.limit(60).withColumn("transaction_id", F.concat(F.lit("n"), "transaction_id")))
    held = keyfilter.stored_keys(spark, root, "fact", loads, new, "transaction_id", schema)
    assert rows(held) == rows(new.join(sales.select("transaction_id"), "transaction_id", "left_semi").select("transaction_id"))
    assert held.count() == 40
    read = [f for f in held.inputFiles() if "/fact/" in f]
    assert read and len([f for f in read if "date_id=20240103" not in f]) <= 2
    none = keyfilter.stored_keys(spark, root, "fact", loads, new.limit(0), "transaction_id", schema)
    assert none.count() == 0
    assert keyfilter.stored_keys(spark, root, "fact", [], new, "transaction_id", schema).count() == 0


def test_loads_keep_their_filters(spark, tmp_path):
    root, raw = str(tmp_path / "w"), raw_feeds(spark, f"{DATA}/sf0.001")
    cuts = ("timestamp < '2024-01-12'", "timestamp between '2024-01-08' and '2024-01-22'", "timestamp >= '2024-01-20'")
    for cut in cuts:
        star, rejects = load_all(spark, {**raw, "transactions": raw["transactions"].filter(cut)}, root, AS_OF, mode="append")
    whole, _ = load_all(spark, raw, str(tmp_path / "once"), AS_OF)
    drop = ("created_at", "updated_at")
    assert rows(star.sales.drop(*drop)) == rows(whole.sales.drop(*drop))
    assert rows(star.daily.drop(*drop)) == rows(whole.daily.drop(*drop))
    listed = manifest.listing(spark, root).tables
    # The last load gets its filter with the next append.
    assert len(listed["fact_sales"]) == 3 and len(listed["keys/fact_sales"]) == 2
    manifest.drop_unlisted(spark, root, keep=0)
    again, rejected = load_all(spark, raw, root, AS_OF, mode="append")
    assert rows(again.sales.drop(*drop)) == rows(whole.sales.drop(*drop))


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("limit", [1, 3, 7])
def test_pages_by_cursor_are_the_pages_by_offset(spark, ascending, limit):
    data = [(None, 1), (None, 1), (None, None), (1, None), (1, 2), (1, 2), (1, 2), (1, 2), (2, None), (2, 5), (3, 1)]
    df = spark.createDataFrame(data, "a int, b int").coalesce(1).persist()
    cursor, got = None, []
    for n in range(len(data) // limit + 2):
        found = paging.page_after(df, "a", "b", after=cursor, limit=limit, ascending=ascending)
        page = [tuple(r) for r in found.collect()]
        assert page == [tuple(r) for r in paging.page(df, "a", "b", limit=limit, offset=n * limit, ascending=ascending).collect()]
        got += page
        cursor = paging.end_of(found, "a", "b", before=cursor, ascending=ascending)
    assert len(got) == len(data)


def test_a_cursor_prunes_the_scan(spark, tmp_path):
    spark.range(1000).select((F.col("id") % 10).cast("int").alias("date_id"), "id").write.partitionBy("date_id").parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = paging.page_after(df, "date_id", "id", after=paging.Cursor((8, 500)), limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date_id" in plan and ">= 8" in plan
    with pytest.raises(ValueError, match="limit"):
        paging.page_after(df, "id", limit=0)
    with pytest.raises(ValueError, match="order"):
        paging.page_after(df)
    assert paging.end_of(df.limit(0), "id") is None


def test_distinct_state_merges_exactly(spark, lines):
    ids = [(d, u) for d in (20240101, 20240102, 20240201) for u in (None, -40_000, -1, 0, 1, 32_768, 32_769, 10**12, d % 100 * 70_000)]
    sales = spark.createDataFrame(ids + ids, "date_id int, user_id bigint")
    dates = spark.createDataFrame([(20240101, 1), (20240102, 1), (20240201, 2)], "date_id int, month int")
    first, second = (distinct_state.distinct_state(sales.filter(f), "user_id") for f in ("date_id < 20240102", "date_id < 20240202"))
    merged = distinct_state.merged_state(first, second)
    counts = {"user_id": "users"}
    for grain in (["month"], ["date_id"], []):
        plain = sales.join(dates, "date_id").groupBy(*grain).agg(F.countDistinct("user_id").alias("users"))
        assert rows(distinct_state.distinct_by(merged, dates, grain, counts), *grain, "users") == rows(plain, *grain, "users")
    assert distinct_state.distinct_state(sales.limit(0), "user_id").count() == 0
    state = distinct_state.distinct_state(lines.sales, "user_id", "book_id")
    monthly = distinct_state.monthly_from_state(lines, summaries.daily_sales_summary(lines.sales), state)
    whole = summaries.monthly_sales_summary(lines)
    assert rows(monthly, *whole.columns) == rows(whole)
