from __future__ import annotations

from datetime import date, datetime

import pytest
from conftest import AS_OF, DATA, rows
from pyspark.sql import functions as F

from tallybook.bindings import raw_feeds
from tallybook.pipeline import build_star, clean_feeds, load_all
from tallybook.plans import books, overview, sales, summaries, views
from tallybook.schemas import LOAD_SCHEMAS, STAR_SCHEMAS, TEXT_WIDTHS
from tallybook.sources import feeds, tables
from tallybook.sources.scratch import new_folder, stored_once


def test_csv_round_trip(spark, tmp_path):
    text = 'he said "hi", twice'
    df = spark.createDataFrame(
        [(1, text, "2024-01-02"), (2, "", None), (3, None, "2024-01-03"), (4, "x" * 300, "2024-01-04")],
        "user_id bigint, name string, signup_date string",
    ).select(
        "user_id", "name", F.lit(None).cast("string").alias("email"), F.lit("Köln, DE").alias("location"),
        "signup_date", F.lit(None).cast("string").alias("social_security_number"),
    )
    path = str(tmp_path / "users.csv")
    feeds.write_csv(df, path)
    loaded, rejected = feeds.copy_csv(spark, path, LOAD_SCHEMAS["dim_users"], TEXT_WIDTHS["dim_users"])
    assert rejected.count() == 0
    assert loaded.schema == LOAD_SCHEMAS["dim_users"]
    assert rows(loaded, "user_id", "name", "location", "signup_date") == [
        (1, text, "Köln, DE", date(2024, 1, 2)),
        (2, None, "Köln, DE", None),
        (3, None, "Köln, DE", date(2024, 1, 3)),
        (4, "x" * 255, "Köln, DE", date(2024, 1, 4)),
    ]
    written = "".join(p.read_text() for p in sorted((tmp_path / "users.csv").glob("*.csv")))
    assert '"he said ""hi"", twice"' in written


def test_copy_rejects_what_does_not_convert(spark, tmp_path):
    header = "transaction_id,user_id,book_id,date_id,amount,quantity,discount_amount,transaction_timestamp\n"
    good = "1,2,3,20240101,9.99,1,0.0,2024-01-01 10:00:00\n"
    bad = "x,2,3,20240101,9.99,1,,2024-01-01\n"
    path = tmp_path / "transactions.csv"
    path.write_text(header + good + bad)
    loaded, rejected = feeds.copy_csv(spark, str(path), LOAD_SCHEMAS["fact_sales"])
    assert rows(loaded, "transaction_id", "transaction_timestamp") == [(1, datetime(2024, 1, 1, 10))]
    assert rows(rejected, "reject_reasons") == [
        (["transaction_id does not convert", "transaction_timestamp does not convert"],)
    ]


def test_copy_accepts_invalid_characters(spark, tmp_path):
    path = tmp_path / "users.csv"
    header = b"user_id,name,email,location,signup_date,social_security_number\n"
    path.write_bytes(header + b"1,A\xffB,,,2024-01-01,\n")
    loaded, _ = feeds.copy_csv(spark, str(path), LOAD_SCHEMAS["dim_users"])
    assert rows(loaded, "user_id", "name") == [(1, "A�B")]


def test_read_raw_by_header(spark, tmp_path):
    (tmp_path / "users.csv").write_text(
        "name,id,email,location,signup_date,social_security_number,extra\nAnn,007,,,2024-01-01,,x\n"
    )
    (tmp_path / "books.csv").write_text(
        "book_id,title,category,base_price,author,isbn,publication_year,pages,publisher\n1,T,C,1,A,I,2000,5,P\n"
    )
    (tmp_path / "transactions.csv").write_text("transaction_id,user_id,book_id,amount,timestamp\n1,2,3,4,5\n")
    raw = feeds.read_raw(spark, str(tmp_path))
    assert rows(raw["users"], "id", "name", "email") == [("007", "Ann", None)]
    assert {t for _, t in raw["books"].dtypes} == {"string"}
    with pytest.raises(ValueError):
        feeds.read_feed(spark, str(tmp_path / "users.csv"), ["no_such_column"])


def test_publish(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    users = "id,name,email,location,signup_date,social_security_number\n"
    (source / "users.csv").write_text(users + "1,A,,,2024-01-01,\n")
    (source / "transactions.csv").write_text("transaction_id,user_id,book_id,amount,timestamp\n1,2,3,4,5\n")
    first = feeds.publish(spark, str(source), target)
    assert first == {"users": "published", "books": "missing", "transactions": "published"}
    (source / "users.csv").write_text(users + "2,B,,,2024-01-01,\n")

    def names():
        return rows(spark.read.csv(f"{target}/users.csv", header=True), "name")

    assert feeds.publish(spark, str(source), target)["users"] == "skipped"
    assert names() == [("A",)]
    assert feeds.publish(spark, str(source), target, overwrite=True)["users"] == "published"
    assert names() == [("B",)]


def test_pipeline(spark, tmp_path):
    raw = raw_feeds(spark, f"{DATA}/sf0.001")
    star, rejects = load_all(spark, raw, str(tmp_path / "warehouse"), AS_OF)
    kept = clean_feeds(raw)["transactions"]
    assert star.sales.count() == kept.count()
    assert star.daily.agg(F.sum("total_revenue")).first()[0] == kept.agg(F.sum("amount")).first()[0]
    for name, df in star.tables().items():
        expected = STAR_SCHEMAS[name]
        stamps = [] if name == "dim_date" else ["created_at", "updated_at"]
        assert df.columns == expected.names + stamps, name
        assert [f.dataType for f in df.drop(*stamps).schema] == [f.dataType for f in expected], name
    assert rejects["dim_books"].count() + star.books.count() == raw["books"].count()
    assert star.sales.join(star.users, "user_id", "left_anti").count() == 0
    # The loaded star answers the reports like the one it was built from.
    assert rows(sales.daily_sales_trends(star, 30), "date", "total_revenue") == rows(
        star.daily.join(star.dates, "date_id"), "full_date", F.col("total_revenue").cast("decimal(18,2)")
    )
    assert rows(summaries.top_books_from_summary(star, 5), "book_id", "total_sales", "unique_customers") == rows(
        books.top_books(star, 5), "book_id", "total_sales", "unique_customers"
    )
    prefix = "again_" + tmp_path.name.replace("-", "_")
    few = star.sales.filter("date_id = 20240105")
    again = summaries.refresh_summaries(star, str(tmp_path), changed=few, prefix=prefix)
    assert again[summaries.DAILY].count() == star.daily.count()


def test_build_star_rejects(spark):
    raw = raw_feeds(spark, f"{DATA}/sf0.001")
    feeds_ = clean_feeds(raw)
    star, rejects = build_star(feeds_, None, AS_OF)
    assert rows(rejects["dim_books"].select("reject_reasons").distinct()) == [(["publication_year is null"],)]
    assert star.users.groupBy("user_id").count().filter("count > 1").count() == 0


def test_stored_star_prunes_days(spark, events, tmp_path):
    stored = tables.create_star(events, str(tmp_path / "star"))
    report = sales.daily_sales_by_range(stored, date(2024, 1, 8), date(2024, 1, 9))
    assert rows(report) == rows(sales.daily_sales_by_range(events, date(2024, 1, 8), date(2024, 1, 9)))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date_id" in plan and "(date_id#" in plan
    assert rows(sales.daily_sales_trends(stored, 7)) == rows(sales.daily_sales_trends(events, 7))


def test_materialize_and_refresh(spark, events, tmp_path):
    root, name = str(tmp_path), "mat_" + tmp_path.name.replace("-", "_")
    first = spark.createDataFrame([(1,)], "v int")
    second = spark.createDataFrame([(2,)], "v int")
    assert rows(tables.materialize(first, name, root)) == [(1,)]
    assert rows(tables.materialize(second, name, root)) == [(1,)]
    before = spark.table(name)
    before_rows = rows(before)
    assert rows(tables.refresh(second, name, root)) == [(2,)]
    assert before_rows == [(1,)]
    assert (name,) in rows(tables.list_tables(spark))
    assert rows(tables.list_tables(spark, name)) == [(name,)]
    # A refresh may read the table it replaces.
    assert rows(tables.refresh(spark.table(name).selectExpr("v + 1 AS v"), name, root)) == [(3,)]
    spark.sql(f"DROP TABLE {name}")


def test_refresh_summaries(spark, events, tmp_path):
    root = str(tmp_path)
    for name in (summaries.DAILY, summaries.BOOKS):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    early, late = F.lit("2024-02-01 00:00:00"), F.lit("2024-02-02 00:00:00")
    first = events.replace(sales=events.sales.filter("date_id <= 20240120"))
    summaries.refresh_summaries(first, root, now=early.cast("timestamp_ntz"))
    changed = events.sales.filter("date_id > 20240120")
    full = summaries.refresh_summaries(events, root, changed, late.cast("timestamp_ntz"))
    daily = full[summaries.DAILY]
    assert rows(daily.drop("created_at", "updated_at")) == rows(summaries.daily_sales_summary(events.sales))
    assert daily.filter("created_at = updated_at").count() == 30
    assert daily.filter(F.col("created_at") == late.cast("timestamp_ntz")).count() == 10
    per_book = full[summaries.BOOKS].drop("created_at", "updated_at")
    assert rows(per_book) == rows(summaries.book_performance(events.sales, events.dates))
    again = summaries.refresh_summaries(events, root, now=late.cast("timestamp_ntz"))[summaries.DAILY]
    assert again.count() == 30 and again.filter("created_at < updated_at").count() == 20
    for name in (summaries.DAILY, summaries.BOOKS):
        spark.sql(f"DROP TABLE {name}")


def test_materialized_views(spark, events, tmp_path):
    for name in (summaries.MONTHLY_VIEW, summaries.CATEGORY_VIEW):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    created = summaries.create_materialized(events, str(tmp_path))
    refreshed = summaries.refresh_materialized(events, str(tmp_path))
    for name, df in created.items():
        assert rows(refreshed[name]) == rows(spark.table(name)) and df.columns == refreshed[name].columns
        spark.sql(f"DROP TABLE {name}")


def test_views_and_envelope(spark, events):
    stored = events.replace(book_performance=stored_once(summaries.book_performance_of(events), "books"))
    tables.register_views(views.published_views(stored))
    assert spark.table("v_user_behavior").count() == 1500
    tables.drop_views(spark, *views.published_views(stored))
    answer = tables.result_envelope(sales.daily_sales_trends(events, 7), "daily_sales_trends")
    header = answer["header"].first()
    assert header["row_count"] == answer["data"].count() == 8
    assert header["query_type"] == "daily_sales_trends" and header["timestamp"]
    # No bound on the size of a result.
    assert tables.result_envelope(spark.range(300_000), "ids")["header"].first()["row_count"] == 300_000


def test_csv_keeps_blanks_breaks_and_quotes(spark, tmp_path):
    texts = ["  lead and trail  ", "two\nlines", 'open " quote', "a,b", "tab\t", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "k bigint, v string")
    path = str(tmp_path / "t.csv")
    feeds.write_csv(df, path)
    loaded, rejected = feeds.copy_csv(spark, path, df.schema)
    assert rejected.count() == 0 and rows(loaded) == sorted(enumerate(texts), key=str)


@pytest.mark.parametrize("multi_line", [True, False])
def test_ragged_rows_are_rejected(spark, tmp_path, multi_line):
    path = tmp_path / "t.csv"
    path.write_text("k,v,w\n1,a,b\n2,short\n3,a,b,more\n4,,\n")
    schema = spark.createDataFrame([], "k bigint, v string, w string").schema
    loaded, rejected = feeds.copy_csv(spark, str(path), schema, multi_line=multi_line)
    assert rows(loaded) == [(1, "a", "b"), (4, None, None)]
    assert rows(rejected, "_corrupt_record") == [("2,short",), ("3,a,b,more",)]


def test_an_open_quote_is_rejected_line_by_line(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('k,v\n1,"two\nlines"\n2,"open\n3,"fine ""x"""\n')
    schema = spark.createDataFrame([], "k bigint, v string").schema
    loaded, rejected = feeds.copy_csv(spark, str(path), schema, multi_line=False)
    assert rows(loaded) == [(3, 'fine "x"')] and rejected.count() == 3
    with pytest.raises(ValueError):
        feeds.copy_csv(spark, str(path), spark.createDataFrame([], "k bigint, x string").schema, multi_line=False)


def test_publish_keeps_every_column_and_record(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "users.csv").write_text('id,more,name\n1, x ,"two\nlines"\n2,"",\n')
    assert feeds.publish(spark, str(source), target)["users"] == "published"
    found = spark.read.options(**feeds.CSV_FORM, multiLine=True).csv(f"{target}/users.csv")
    assert found.columns == ["id", "more", "name"]
    assert rows(found) == rows(spark.read.options(**feeds.CSV_FORM, multiLine=True).csv(str(source / "users.csv")))


def test_superseded_versions_are_removed(spark, tmp_path):
    root, name = str(tmp_path), "kept_" + tmp_path.name.replace("-", "_")
    for n in range(5):
        tables.refresh(spark.range(n), name, root)
    assert spark.table(name).count() == 4
    assert len(list(tmp_path.glob(f"{name}-*"))) == 2
    tables.drop_stored(spark, name)


def test_load_accounts_for_every_row(spark, tmp_path):
    raw = raw_feeds(spark, f"{DATA}/sf0.001")
    twice = {k: df.unionByName(df) for k, df in raw.items()}
    star, rejects = load_all(spark, twice, str(tmp_path / "w"), AS_OF)
    cleaned = clean_feeds(twice)
    kept = {"dim_users": star.users, "dim_books": star.books, "fact_sales": star.sales}
    for table, feed in (("dim_users", "users"), ("dim_books", "books"), ("fact_sales", "transactions")):
        assert kept[table].count() + rejects[table].count() == cleaned[feed].count(), table
    assert rejects["fact_sales"].filter("array_contains(reject_reasons, 'duplicate key')").count() == star.sales.count()


def test_an_identical_append_changes_nothing(spark, tmp_path):
    raw, root = raw_feeds(spark, f"{DATA}/sf0.001"), str(tmp_path / "w")
    first, _ = load_all(spark, raw, root, AS_OF, mode="append")
    before = {name: rows(df.drop("created_at", "updated_at")) for name, df in first.tables().items()}
    second, rejects = load_all(spark, raw, root, AS_OF, mode="append")
    assert {name: rows(df.drop("created_at", "updated_at")) for name, df in second.tables().items()} == before
    assert rejects["fact_sales"].count() == len(before["fact_sales"])


def test_data_status_survives_a_failing_probe(spark, events):
    broken = events.replace(dates=spark.range(1).selectExpr("raise_error('no calendar') AS date_id", "DATE'2024-01-01' AS full_date"))
    status = overview.data_status(broken, AS_OF)
    assert "error" in status["fact_sales_date_range"]
    missing = events.replace(books=lambda: spark.read.parquet("/no/such/folder"))
    report = rows(overview.data_status_report(missing, AS_OF))
    assert ("table_counts", "error", "PATH_NOT_FOUND") in report and {r[0] for r in report} >= {"recent_sales", "current_date"}
    assert status["current_date"]["data"] == [{"current_date": AS_OF}]
    assert {"fact_sales": 1981}.items() <= {
        r["table_name"]: r["row_count"] for r in overview.data_status(events, AS_OF)["table_counts"]["data"]
    }.items()


def test_scratch_is_never_reused(spark):
    assert new_folder(spark, "x") != new_folder(spark, "x")
