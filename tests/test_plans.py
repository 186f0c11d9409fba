"""The shape of the physical plans: what reaches the scan, what is shuffled, what runs in one task."""

from __future__ import annotations

import re
from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry_module
from conftest import DATA
from tallybook.bindings import stored_lines_star
from tallybook.operators.merging import insert_ignore
from tallybook.operators.ranking import global_ranks
from tallybook.plans import books, customers, overview, sales, summaries, views
from tallybook.sources import feeds
from tallybook.sources.keyfilter import key_filters
from tallybook.sources.tables import create_star


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_used_columns_are_read(events):
    text = plan(customers.customer_segments(events))
    schema = re.search(r"events\.parquet.*?ReadSchema: (\S+)", text).group(1)
    assert "props" not in schema and "ts" not in schema


def test_filters_reach_the_scan(events):
    text = plan(sales.daily_sales_by_range(events, date(2024, 1, 8), date(2024, 1, 9)))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    assert "EqualTo(event_type,purchase)" in pushed
    assert "GreaterThanOrEqual(ts,2024-01-08T00:00)" in pushed and "LessThan(ts,2024-01-10T00:00)" in pushed


def test_ranges_of_summaries_and_filtered_sales_reach_the_scan(events):
    for report in (
        summaries.daily_summary(events, date(2024, 1, 8), date(2024, 1, 9)),
        views.sales_filtered(events, start=date(2024, 1, 8), end=date(2024, 1, 9)),
    ):
        assert "GreaterThanOrEqual(ts,2024-01-08T00:00)" in plan(report) and "LessThan(ts,2024-01-10T00:00)" in plan(report)
    recent = plan(summaries.sales_trends(events, 14, date(2024, 1, 30)))
    assert "GreaterThanOrEqual(ts,2024-01-16T00:00)" in recent


def test_column_statistics_do_not_multiply_rows(events):
    assert "Generate" not in plan(overview.table_stats(events)).replace("Generate explode(sequence", "")


def test_lines_fact_is_stored_once_and_read_without_a_join(spark):
    star = stored_lines_star(spark, f"{DATA}/sf0.001")
    text = plan(star.sales.groupBy("date_id").count())
    assert "Join" not in text and "lines-star" in text
    assert stored_lines_star(spark, f"{DATA}/sf0.001").sales.inputFiles() == star.sales.inputFiles()
    assert "EqualTo(user_id,41)" in plan(customers.user_transactions(star, 41))


def test_key_lookup_reaches_the_scan(events):
    assert "EqualTo(c_custkey,41)" in plan(customers.user_by_id(events, 41))
    assert "EqualTo(user_id,41)" in plan(customers.user_transactions(events, 41))


def test_first_row_per_key_is_reduced_before_the_shuffle(lines):
    text = plan(insert_ignore(lines.sales, "transaction_id", "transaction_timestamp"))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_one_distinct_column_per_aggregate(events):
    for report in (
        books.category_performance(events),
        sales.monthly_trends(events, 12, date(2024, 1, 30)),
        summaries.monthly_sales_summary(events),
        summaries.daily_sales_summary(events.sales),
        summaries.book_performance(events.sales, events.dates),
    ):
        assert "Expand" not in plan(report)


def test_top_k_is_not_a_full_sort(events):
    assert "TakeOrderedAndProject" in plan(customers.user_analytics(events))


def test_global_rank_never_gathers_rows(spark, events):
    ranked = global_ranks(events.books, {"base_price": "r"})
    text = plan(ranked)
    # The one single-task window runs over the totals of the slices.
    single = [line for line in text.splitlines() if "Exchange SinglePartition" in line]
    windows = [line for line in text.splitlines() if re.search(r"Window \[sum\(_slice_rows", line)]
    assert len(single) == len(windows) == 1
    assert "_value" in text and "Window [sum(_rows" in text


def test_fact_is_written_balanced(spark, events, tmp_path):
    hinted = events.sales.hint("rebalance", F.col("date_id"))
    assert "REBALANCE" in plan(hinted).upper()
    stored = create_star(events, str(tmp_path / "star"))
    assert stored.sales.count() == 1981


NO_PYTHON = re.compile(r"PythonUDF|ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas")


@pytest.mark.parametrize("name", sorted(entry_module.queries()))
def test_no_python_in_any_plan_and_no_cross_product(spark, name):
    text = plan(entry_module.queries()[name](spark, f"{DATA}/sf0.001"))
    assert not NO_PYTHON.search(text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("multi_line", [False, True])
def test_bulk_load_parses_and_converts_a_line_once(spark, tmp_path, multi_line):
    (tmp_path / "f.csv").write_text("a,b\n1,2024-01-02 00:00:00\nx,2024-01-02 00:00:00\n3\n")
    loaded, rejected = feeds.copy_csv(spark, str(tmp_path / "f.csv"), T.StructType.fromDDL("a bigint, b timestamp_ntz"), multi_line=multi_line)
    for df in (loaded, rejected):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        # A nested data frame's plan names the parser once.
        assert text.count("from_csv(") == 1 and text.count("try_cast(") <= 3
    assert loaded.count() == 1 and sorted(r["a"] for r in rejected.collect()) == ["3", "x"]


def test_files_of_texts_follow_the_size_of_the_table(spark):
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB"}
    queries = [entry_module.queries()[name] for name in ("s01_read_feed_text", "s03_write_csv_text")]
    assert [len(query(spark, f"{DATA}/sf0.001").inputFiles()) for query in queries] == [1, 1]
    before = {name: spark.conf.get(name) for name in small}
    try:
        for name, value in small.items():
            spark.conf.set(name, value)
        assert all(len(query(spark, f"{DATA}/sf0.01").inputFiles()) > 1 for query in queries)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_key_filters_sort_one_row_per_key(spark):
    keys = spark.range(1000).select("id", F.lit("f").alias("file"))
    assert "explode(array(pmod" not in plan(key_filters(keys, "id", "file"))
    assert key_filters(keys, "id", "file").agg(F.max(F.bitmap_count("bits"))).first()[0] <= 8 * 1000
