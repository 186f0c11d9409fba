"""Registered queries: one per operator and report, each with the SQL that a second engine can run.

``ev`` is the star over the purchase events, ``li`` the star over the order lines, ``raw`` the text feeds
derived from all rows of the tables. Reports that exist on both stars carry ``_lines`` on the second.
"""

from __future__ import annotations

import importlib
import importlib.util
import os
import sys
import uuid
from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import mart_sql as o
from tallybook import bindings as b
from tallybook.functions import labels, rules
from tallybook.functions.dates import date_id
from tallybook.operators import cleaning, dimensions, facts, merging, paging, quality
from tallybook.pipeline import DAILY_PART, clean_feeds, load_all, load_counts
from tallybook.plans import books, catalog, customers, dashboard, distinct_state, insights, overview, sales, summaries, views
from tallybook.schemas import LOAD_SCHEMAS, TEXT_WIDTHS
from tallybook.sources import feeds, keyfilter, manifest, tables
from tallybook.sources.scratch import new_folder, stored_once
from tallybook.star import Star

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = b.AS_OF
FROM, TO = date(2024, 1, 8), date(2024, 1, 21)
LINES_FROM, LINES_TO = date(1996, 3, 1), date(1999, 6, 30)
USER, BOOK, CATEGORY, SEGMENT = 41, 36, "PROMO", "Medium Value"
FIRST_LOAD, SECOND_LOAD = "2024-02-01 00:00:00", "2024-02-02 00:00:00"

_REGISTRY: dict[str, tuple[Query, str | None]] = {}


def _on(star_of: Callable[[SparkSession, str], Star], report: Callable[[Star], DataFrame]) -> Query:
    return lambda spark, sf_dir: report(star_of(spark, sf_dir))


def ev(name: str, report: Callable[[Star], DataFrame], sql: str | None) -> None:
    _REGISTRY[name] = (_on(b.events_star, report), sql and o.on_events(sql))


def li(name: str, report: Callable[[Star], DataFrame], sql: str | None) -> None:
    _REGISTRY[name] = (_on(b.stored_lines_star, report), sql and o.on_lines(sql))


def raw(name: str, report: Callable[[dict[str, DataFrame]], DataFrame], sql: str | None) -> None:
    _REGISTRY[name] = (lambda s, d: report(b.raw_feeds(s, d)), sql and o.on_feeds(sql))


def plain(name: str, query: Query, sql: str | None) -> None:
    _REGISTRY[name] = (query, sql)


def with_stored_books(star: Star) -> Star:
    """The star with its book summary stored, as the reports that read it several times expect."""
    return star.replace(book_performance=stored_once(summaries.book_performance_of(star), summaries.BOOKS))


def _unused_prefix(folder: str) -> str:
    """A table name prefix that is as fresh as the folder."""
    return f"t{folder[-12:]}_"


def _taken_out(spark: SparkSession, name: str, *others: str) -> DataFrame:
    """The files of a stored table, after this job's tables left the catalog."""
    path = tables.location(spark, name)
    tables.drop_stored(spark, name, *others)
    return spark.read.parquet(path)


# ------------------------------------------------------------------------------------ sources and sinks


def _feed_folder(raw_feeds: dict[str, DataFrame]) -> str:
    folder = new_folder(raw_feeds["users"].sparkSession, "feeds")
    for name, df in raw_feeds.items():
        feeds.write_csv(df, f"{folder}/{name}.csv")
    return folder


def s01(name):
    return lambda r: feeds.read_raw(r["users"].sparkSession, _feed_folder(r))[name]


def _curated_folder(raw_feeds: dict[str, DataFrame]) -> str:
    clean = clean_feeds(raw_feeds)
    folder = new_folder(clean["users"].sparkSession, "curated")
    feeds.write_csv(cleaning.users_projection(clean["users"]), f"{folder}/users.csv")
    feeds.write_csv(cleaning.books_projection(clean["books"]), f"{folder}/books.csv")
    feeds.write_csv(cleaning.sales_projection(clean["transactions"]), f"{folder}/transactions.csv")
    return folder


def s02(name):
    return lambda r: feeds.copy_star(r["users"].sparkSession, _curated_folder(r))[name][0]


def s02_rejects(spark, sf_dir):
    """All events as curated lines, each kind but purchases and sign-ups with a fault: loaded rows, and rejects by reason."""
    fields = [F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.get_json_object("props", "$.k"), F.lit("20240101"),
              F.col("value").cast("decimal(10,2)").cast("string"), F.lit("1"), F.lit("0.0"), F.lit("2024-01-01 10:00:00")]
    kind = F.col("event_type")
    line = (
        F.when(kind == "click", F.concat_ws(",", *fields[:3]))
        .when(kind == "error", F.concat_ws(",", *fields, F.lit("more")))
        .when(kind == "view", F.concat_ws(",", fields[0], F.lit("u"), *fields[2:]))
        .otherwise(F.concat_ws(",", *fields))
    )
    schema = LOAD_SCHEMAS["fact_sales"]
    path = new_folder(spark, "faulty")
    lines = b.table(spark, sf_dir, "events").select(line.alias(",".join(schema.names)))
    lines.write.options(header=True, sep="\x01", quote="\x00").csv(path)
    loaded, rejected = feeds.copy_csv(spark, path, schema, multi_line=False)
    whole = loaded.agg(F.count("*").alias("row_count")).select(F.lit("loaded").alias("outcome"), "row_count")
    return whole.unionByName(quality.reject_counts(rejected).withColumnRenamed("reason", "outcome"))


def s03(raw_feeds):
    spark = raw_feeds["users"].sparkSession
    path = f"{_curated_folder(raw_feeds)}/users.csv"
    return feeds.copy_csv(spark, path, LOAD_SCHEMAS["dim_users"], TEXT_WIDTHS["dim_users"])[0]


def s03_text(spark, sf_dir):
    """Every text written as CSV and loaded again: quotes, line breaks and blanks survive."""
    path = new_folder(spark, "texts")
    feeds.write_csv(b.table(spark, sf_dir, "documents").select("doc_id", "text").hint("rebalance"), path)
    return feeds.copy_csv(spark, path, T.StructType.fromDDL("doc_id bigint, text string"))[0]


def s01_text(spark, sf_dir):
    """Every text, most with line breaks inside quotes, in files of bounded size whatever the table's, one if it is small,
    that tasks read by byte ranges."""
    path = new_folder(spark, "feed-texts")
    feeds.write_csv(b.table(spark, sf_dir, "documents").select("doc_id", "text").hint("rebalance"), path)
    return feeds.read_feed(spark, path, ["doc_id", "text"])


def s04(name):
    def published(raw_feeds):
        spark = raw_feeds["users"].sparkSession
        target = new_folder(spark, "published")
        feeds.publish(spark, _feed_folder(raw_feeds), target)
        return feeds.read_raw(spark, target)[name]

    return published


_RAW_TRANSACTIONS = (
    "SELECT transaction_id, user_id, nullif(book_id, '') AS book_id, amount, timestamp FROM raw_transactions"
)
_RAW_USERS = "SELECT id, name, email, location, signup_date, social_security_number FROM raw_users"
_RAW_BOOKS = (
    "SELECT book_id, title, category, base_price, author, isbn, publication_year, pages, publisher FROM raw_books"
)
raw("s01_read_raw", s01("transactions"), _RAW_TRANSACTIONS)
raw("s01_read_raw_users", s01("users"), _RAW_USERS)
raw("s01_read_raw_books", s01("books"), _RAW_BOOKS)
raw("s02_copy_csv", s02("fact_sales"), o.FACT)
raw("s02_copy_csv_users", s02("dim_users"),
    "SELECT user_id, name, email, location, CAST(signup_date AS DATE) AS signup_date, "
    f"social_security_number FROM ({o.USERS_FILE})")
plain("s02_copy_rejects", s02_rejects, """
SELECT 'loaded' AS outcome, COUNT(*) AS row_count FROM events WHERE event_type NOT IN ('click', 'error', 'view')
UNION ALL SELECT 'number of fields or quotes', COUNT(*) FROM events WHERE event_type IN ('click', 'error')
UNION ALL SELECT 'user_id does not convert', COUNT(*) FROM events WHERE event_type = 'view'""")
plain("s01_read_feed_text", s01_text, "SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(text, '') AS text FROM documents")
plain("s03_write_csv_text", s03_text, "SELECT doc_id, nullif(text, '') AS text FROM documents")
raw("s03_write_csv", s03, "SELECT user_id, name, email, location, CAST(signup_date AS DATE) AS signup_date, "
    f"social_security_number FROM ({o.USERS_FILE})")
raw("s04_publish", s04("users"), _RAW_USERS)
raw("s04_publish_books", s04("books"), _RAW_BOOKS)
raw("s04_publish_transactions", s04("transactions"), _RAW_TRANSACTIONS)

FIRST_ORDER = ("transaction_timestamp", "user_id", "book_id", "amount", "quantity")


def s05(star):
    """Lines from ``LINES_FROM`` on inserted into the earlier ones, which hold many of their ids."""
    early = merging.insert_ignore(star.sales.filter(F.col("date_id") < date_id(F.lit(LINES_FROM))), "transaction_id", *FIRST_ORDER)
    return merging.insert_ignore(facts.sales_between(star.sales, start=LINES_FROM), "transaction_id", *FIRST_ORDER, target=early)


li("s05_insert_ignore", s05, o.FIRST_LINES)


def s05_filters(star):
    """The same by key filters: the earlier lines stored by day with a filter per file, of which only files that may hold
    an id of the later lines are read."""
    spark, root, load = star.sales.sparkSession, new_folder(star.sales.sparkSession, "keyed"), "load=first"
    early = merging.insert_ignore(star.sales.filter(F.col("date_id") < date_id(F.lit(LINES_FROM))), "transaction_id", *FIRST_ORDER)
    tables.write_fact(early, f"{root}/fact_sales/{load}", by_day=False)
    target = manifest.read_table(spark, root, "fact_sales", [load], early.schema)
    late = merging.insert_ignore(facts.sales_between(star.sales, start=LINES_FROM), "transaction_id", *FIRST_ORDER)
    keyfilter.add_filters(spark, root, "fact_sales", [load], [], "transaction_id", early.schema)
    held = keyfilter.stored_keys(spark, root, "fact_sales", [load], late, "transaction_id", early.schema)
    return target.unionByName(late.join(held, "transaction_id", "left_anti").select(*target.columns))


li("s05_insert_by_key_filters", s05_filters, o.FIRST_LINES)


def s06(raw_feeds):
    """Accepted rows and rejected rows per reason."""
    checked = cleaning.clean_books(raw_feeds["books"])
    broken = {
        "publication_year is null": F.col("publication_year").isNotNull(),
        "price below one": F.col("base_price") >= 1,
    }
    ok, rejected = quality.split_rejects(checked, broken)
    accepted = ok.agg(F.count("*").alias("row_count")).select(F.lit("accepted").alias("reason"), "row_count")
    return accepted.unionByName(quality.reject_counts(rejected))


raw("s06_split_rejects", s06, """
SELECT 'accepted' AS reason, COUNT(*) AS row_count FROM clean_books
WHERE publication_year IS NOT NULL AND base_price >= 1
UNION ALL SELECT 'publication_year is null', COUNT(*) FROM clean_books WHERE publication_year IS NULL
UNION ALL SELECT 'price below one', COUNT(*) FROM clean_books WHERE base_price < 1""")


def s07(star):
    """Two overlapping loads of the daily summary: the second wins where they meet."""
    first = summaries.daily_sales_summary(facts.sales_between(star.sales, end=TO))
    second = summaries.daily_sales_summary(facts.sales_between(star.sales, start=FROM))
    stored = merging.stamped(first, F.lit(FIRST_LOAD).cast("timestamp_ntz"))
    return merging.upsert(stored, second, "date_id", F.lit(SECOND_LOAD).cast("timestamp_ntz"))


ev("s07_upsert", s07, f"""
, {o.M01.strip()}
SELECT *, CASE WHEN date_id <= 20240121 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-02-02' END AS created_at,
       CASE WHEN date_id < 20240108 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-02-02' END AS updated_at
FROM daily""")


def s08(star):
    return tables.create_star(star, new_folder(star.sales.sparkSession, "star")).sales


ev("s08_create_star", s08, "SELECT * FROM sales")


def s09(star):
    folder = new_folder(star.sales.sparkSession, "aggregates")
    name = _unused_prefix(folder) + summaries.MONTHLY_VIEW
    tables.materialize(summaries.monthly_sales_summary(star), name, folder)
    return _taken_out(star.sales.sparkSession, name)


ev("s09_materialize", s09, o.MONTHLY_SUMMARY)


def s11(star):
    """The star registered table by table, listed, with the rows of each listed table."""
    spark, prefix = star.sales.sparkSession, _unused_prefix(uuid.uuid4().hex)
    registered = {prefix + name: df for name, df in star.tables().items()}
    tables.register_views(registered)
    listed = tables.list_tables(spark, f"{prefix}%").select(F.substring("table_name", len(prefix) + 1, 100).alias("table_name"))
    tables.drop_views(spark, *registered)
    return listed.join(overview.table_counts(star), "table_name")


ev("s11_list_tables", s11, o.TABLE_COUNTS)


def s12(part):
    return lambda star: tables.result_envelope(sales.daily_sales_trends(star, 30), "daily_sales_trends")[part].drop("timestamp")


ev("s12_result_envelope", s12("header"),
   f", daily AS ({o.trends(30)}) SELECT 'daily_sales_trends' AS query_type, COUNT(*) AS row_count FROM daily")
ev("s12_result_envelope_rows", s12("data"), o.trends(30))


def s10(star):
    spark, prefix = star.sales.sparkSession, _unused_prefix(uuid.uuid4().hex)
    registered = {prefix + name: df for name, df in views.published_views(with_stored_books(star)).items()}
    tables.register_views(registered)
    joined = spark.sql(
        "SELECT s.book_category, COUNT(*) AS sales, COUNT(DISTINCT t.book_id) AS top_ten_books "
        f"FROM {prefix}v_sales_with_dimensions s LEFT JOIN {prefix}v_top_books t "
        "ON s.book_title = t.title AND s.book_author = t.author AND t.revenue_rank <= 10 "
        "GROUP BY s.book_category"
    )
    users = spark.sql(f"SELECT COUNT(*) AS sales FROM {prefix}v_user_behavior").select(
        F.lit("(users)").alias("book_category"), "sales", F.lit(0).cast("bigint").alias("top_ten_books")
    )
    tables.drop_views(spark, *registered)
    return joined.unionByName(users)


ev("s10_register_views", s10, f"""
, v_sales AS ({o.V01}), {o.M02.strip()}, v_top AS (
  SELECT b.book_id, b.title, b.author, RANK() OVER (ORDER BY p.total_revenue DESC) AS revenue_rank
  FROM books b JOIN performance p USING (book_id))
SELECT s.book_category, COUNT(*) AS sales, COUNT(DISTINCT t.book_id) AS top_ten_books
FROM v_sales s LEFT JOIN v_top t
ON s.book_title = t.title AND s.book_author = t.author AND t.revenue_rank <= 10 GROUP BY s.book_category
UNION ALL SELECT '(users)', COUNT(*), 0 FROM users""")

# ---------------------------------------------------------------------------------- cleaning and quality

raw("c01_clean_users", lambda r: cleaning.clean_users(r["users"]), "SELECT * FROM clean_users")
raw("c02_clean_transactions", lambda r: cleaning.clean_transactions(r["transactions"]),
    "SELECT * FROM clean_transactions")
li("c02_clean_transactions_lines",
   lambda s: cleaning.clean_transactions(
       s.sales.select(
           *[F.col(c).cast("string").alias(c) for c in ("transaction_id", "user_id", "book_id", "amount")],
           F.date_format("transaction_timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
       ),
       hi=100000,
   ),
   "SELECT transaction_id, user_id, book_id, amount, transaction_timestamp AS timestamp FROM sales "
   "WHERE amount BETWEEN 0 AND 100000")
raw("c03_clean_books", lambda r: cleaning.clean_books(r["books"]), "SELECT * FROM clean_books")
raw("c04_referential_filter", lambda r: clean_feeds(r)["transactions"],
    f"SELECT {o.CLEAN_TRANSACTIONS} FROM kept")
raw("c04_referential_rejects",
    lambda r: cleaning.referential_rejects(
        cleaning.clean_transactions(r["transactions"]),
        cleaning.clean_users(r["users"]),
        cleaning.clean_books(r["books"]),
    ),
    f"""SELECT {o.CLEAN_TRANSACTIONS} FROM clean_transactions
WHERE user_id NOT IN (SELECT id FROM clean_users) OR book_id NOT IN (SELECT book_id FROM clean_books)""")
raw("c05_null_out",
    lambda r: cleaning.null_out(r["users"], ["social_security_number", "email"]).select(
        "id", "email", "social_security_number"),
    "SELECT id, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS social_security_number FROM raw_users")
raw("c06_users_projection",
    lambda r: cleaning.users_projection(cleaning.clean_users(r["users"])), o.USERS_FILE)
raw("c07_books_projection",
    lambda r: cleaning.books_projection(cleaning.clean_books(r["books"])), o.BOOKS_FILE)
raw("c08_sales_projection", lambda r: cleaning.sales_projection(clean_feeds(r)["transactions"]), o.SALES_FILE)
raw("c09_fill_null_text",
    lambda r: cleaning.fill_null_text(
        cleaning.null_empty_text(r["transactions"]).select("transaction_id", "book_id")),
    "SELECT transaction_id, coalesce(book_id, '') AS book_id FROM raw_transactions")
raw("c10_truncate_text",
    lambda r: cleaning.truncate_text(r["users"], {"name": 12, "location": 8}).select("id", "name", "location"),
    "SELECT id, left(name, 12) AS name, left(location, 8) AS location FROM raw_users")


def c11(spark, sf_dir):
    """Texts of one language end in a byte that is no UTF-8."""
    byte = F.when(F.col("lang") == "de", F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit("")))
    broken = F.concat(F.encode("text", "UTF-8"), byte).cast("string").alias("text")
    return cleaning.repair_utf8(b.table(spark, sf_dir, "documents").select("doc_id", broken))


plain("c11_repair_utf8", c11,
      "SELECT doc_id, CASE WHEN lang = 'de' THEN text || chr(65533) ELSE text END AS text FROM documents")
raw("c12_drop_negative",
    lambda r: cleaning.drop_negative(cleaning.clean_transactions(r["transactions"], lo=-10000)),
    """SELECT TRY_CAST(transaction_id AS BIGINT) AS transaction_id, TRY_CAST(user_id AS BIGINT) AS user_id,
       CAST(TRY_CAST(book_id AS DOUBLE) AS BIGINT) AS book_id,
       CAST(TRY_CAST(amount AS DOUBLE) AS DECIMAL(10,2)) AS amount,
       TRY_STRPTIME(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp
FROM raw_transactions
WHERE TRY_CAST(amount AS DOUBLE) BETWEEN -10000 AND 10000 AND TRY_CAST(amount AS DOUBLE) >= 0
  AND TRY_CAST(user_id AS BIGINT) IS NOT NULL AND TRY_CAST(book_id AS DOUBLE) IS NOT NULL
  AND TRY_STRPTIME(timestamp, '%Y-%m-%d %H:%M:%S') IS NOT NULL""")
raw("c13_check_not_null",
    lambda r: quality.check_not_null(
        cleaning.clean_books(r["books"]), ["title", "publication_year", "base_price"]
    ).select("book_id", F.explode("reject_reasons").alias("reason")),
    "SELECT book_id, 'publication_year is null' AS reason FROM clean_books WHERE publication_year IS NULL")
li("c14_check_unique", lambda s: quality.check_unique(s.sales, "transaction_id"),
   "SELECT transaction_id, COUNT(*) AS row_count FROM sales GROUP BY transaction_id HAVING COUNT(*) > 1")
raw("c15_check_foreign_key",
    lambda r: quality.check_foreign_key(
        cleaning.clean_transactions(r["transactions"]),
        cleaning.clean_users(r["users"]).withColumnRenamed("id", "user_id"),
        "user_id",
    ),
    f"""SELECT {o.CLEAN_TRANSACTIONS} FROM clean_transactions
WHERE user_id NOT IN (SELECT id FROM clean_users)""")


def c16_email(star):
    """Users of the cities whose name ends in a one have a malformed address."""
    email = F.when(F.col("city").endswith("1"), F.regexp_replace("email", "@", " at ")).otherwise(F.col("email"))
    broken = quality.check_rules(star.users.select("user_id", email.alias("email")), {"email": rules.valid_email(F.col("email"))})
    return broken.select("user_id", F.explode("reject_reasons").alias("reason"))


ev("c16_check_rules", c16_email,
   "SELECT user_id, 'email' AS reason FROM users WHERE city LIKE '%1'")
ev("c16_check_rules_year",
   lambda s: quality.check_rules(
       s.books.select("book_id", "publication_year"),
       {"publication year": rules.valid_publication_year(F.col("publication_year"), date(2009, 6, 30))},
   ).select("book_id", F.explode("reject_reasons").alias("reason")),
   """SELECT book_id, 'publication year' AS reason FROM books
WHERE NOT (publication_year BETWEEN 1900 AND 2010)""")
li("c16_check_rules_lines",
   lambda s: quality.check_rules(
       s.sales.select("transaction_id", F.date_add(F.col("transaction_timestamp").cast("date"), 8000).alias("full_date")),
       {"calendar day": rules.valid_calendar_day(F.col("full_date"))},
   ).select("transaction_id", "full_date"),
   """SELECT transaction_id, CAST(transaction_timestamp AS DATE) + 8000 AS full_date FROM sales
WHERE CAST(transaction_timestamp AS DATE) + 8000 < DATE '2020-01-01'""")
li("c17_page", lambda s: paging.page(s.sales, "transaction_timestamp", "transaction_id", "book_id", "user_id",
                                     "amount", "quantity", limit=500, offset=250),
   """SELECT * FROM sales
ORDER BY transaction_timestamp, transaction_id, book_id, user_id, amount, quantity LIMIT 500 OFFSET 250""")


def walked(df, order, pages, limit, ascending=True):
    """The last of so many pages, each found from the end of the one before."""
    cursor = None
    for _ in range(pages - 1):
        found = paging.page_after(df, *order, after=cursor, limit=limit, ascending=ascending)
        cursor = paging.end_of(found, *order, before=cursor, ascending=ascending)
    return paging.page_after(df, *order, after=cursor, limit=limit, ascending=ascending)


PAGE_ORDER = ("transaction_timestamp", "transaction_id", "book_id", "user_id", "amount", "quantity")
li("c17_page_after", lambda s: walked(s.sales, ("date_id", *PAGE_ORDER), 3, 500),
   f"""SELECT * FROM sales ORDER BY date_id, {', '.join(PAGE_ORDER)} LIMIT 500 OFFSET 1000""")
li("c17_page_after_descending", lambda s: walked(s.sales, ("date_id", *PAGE_ORDER), 3, 500, ascending=False),
   f"""SELECT * FROM sales ORDER BY date_id DESC, {', '.join(f'{c} DESC' for c in PAGE_ORDER)} LIMIT 500 OFFSET 1000""")
ev("c18_date_range",
   lambda s: facts.date_range(s.sales.withColumn("full_date", F.col("transaction_timestamp").cast("date")),
                              FROM, TO).drop("full_date"),
   "SELECT * FROM sales WHERE CAST(transaction_timestamp AS DATE) BETWEEN '2024-01-08' AND '2024-01-21'")

# ------------------------------------------------------------------------------------ dimensions and fact

_COVERING = f"WITH {o.calendar(o.ORDER_DAYS).strip()}"
plain("d01_dim_date", lambda s, d: dimensions.dim_date_covering(b.table(s, d, "orders"), "o_orderdate"),
      f"{_COVERING} SELECT * FROM dates")
plain("d02_dim_date",
      lambda s, d: dimensions.dim_date_covering(b.table(s, d, "orders"), "o_orderdate", style="mon1"),
      f"""{_COVERING} SELECT * REPLACE (CAST(isodow(full_date) AS INTEGER) AS day_of_week), FALSE AS is_holiday,
CAST(CASE WHEN month >= 4 THEN year ELSE year - 1 END AS INTEGER) AS fiscal_year,
CAST(CASE WHEN month >= 4 THEN quarter ELSE (month + 8) // 3 + 1 END AS INTEGER) AS fiscal_quarter FROM dates""")
raw("d03_split_location", lambda r: dimensions.split_location(r["users"]).select("id", "city", "state"),
    """SELECT id, trim(split_part(location, ',', 1)) AS city, trim(split_part(location, ',', 2)) AS state
FROM raw_users""")
raw("d04_tenure_segment",
    lambda r: cleaning.clean_users(r["users"]).select(
        "id", labels.tenure_segment(F.col("signup_date"), AS_OF).alias("user_segment")),
    f"SELECT user_id AS id, user_segment FROM ({o.DIM_USERS})")
ev("d05_price_tier", lambda s: s.books.select("book_id", labels.price_tier(F.col("base_price")).alias("tier")),
   "SELECT book_id, price_tier AS tier FROM books")
ev("d06_age_category",
   lambda s: s.books.select("book_id", labels.age_category(F.col("publication_year"), AS_OF).alias("age")),
   "SELECT book_id, age_category AS age FROM books")
raw("d07_dim_users", lambda r: dimensions.dim_users(cleaning.clean_users(r["users"]), AS_OF), o.DIM_USERS)
raw("d08_dim_books", lambda r: dimensions.dim_books(cleaning.clean_books(r["books"]), AS_OF), o.DIM_BOOKS)
raw("d09_fact_sales", lambda r: facts.fact_sales(clean_feeds(r)["transactions"]), o.FACT)


def d10(table):
    def loaded(raw_feeds):
        spark = raw_feeds["users"].sparkSession
        star, _ = load_all(spark, raw_feeds, new_folder(spark, "warehouse"), AS_OF)
        return star.tables()[table].drop("created_at", "updated_at")

    return loaded


def d10_counts(raw_feeds):
    """Stored and rejected rows of a load in which every user occurs twice."""
    spark = raw_feeds["users"].sparkSession
    twice = {**raw_feeds, "users": raw_feeds["users"].unionByName(raw_feeds["users"])}
    return load_counts(*load_all(spark, twice, new_folder(spark, "warehouse"), AS_OF))


def d10_append(raw_feeds):
    """Two loads whose sales overlap for two weeks, the second one appended."""
    spark, root = raw_feeds["users"].sparkSession, new_folder(raw_feeds["users"].sparkSession, "warehouse")
    early = raw_feeds["transactions"].filter("timestamp < '2024-01-22'")
    late = raw_feeds["transactions"].filter("timestamp >= '2024-01-08'")
    load_all(spark, {**raw_feeds, "transactions": early}, root, AS_OF)
    return load_all(spark, {**raw_feeds, "transactions": late}, root, AS_OF, mode="append")


# Books without a known year are rejected from the dimension; the sales of those books stay in the fact.
_LOADED = f", sales AS ({o.FACT})"
raw("d10_load_all", d10(summaries.DAILY), f"{_LOADED}, {o.M01.strip()} SELECT * FROM daily")
raw("d10_load_append_daily", lambda r: d10_append(r)[0].daily.drop("created_at", "updated_at"), f"{_LOADED}, {o.M01.strip()} SELECT * FROM daily")
raw("d10_load_append_books", lambda r: d10_append(r)[0].book_performance.drop("created_at", "updated_at"),
    f"{_LOADED}, dates AS (SELECT DISTINCT date_id, CAST(transaction_timestamp AS DATE) AS full_date FROM sales), {o.M02.strip()} SELECT * FROM performance")
raw("d10_load_all_users", d10("dim_users"), o.DIM_USERS)
raw("d10_load_all_books", d10("dim_books"), f"SELECT * FROM ({o.DIM_BOOKS}) WHERE publication_year IS NOT NULL")
raw("d10_load_all_sales", d10("fact_sales"), o.FACT)
raw("d10_load_append", lambda r: d10_append(r)[0].sales.drop("created_at", "updated_at"), o.FACT)
raw("d10_load_append_counts", lambda r: load_counts(*d10_append(r)).filter("table_name = 'fact_sales'"), f"""{_LOADED}
SELECT 'fact_sales' AS table_name, 'stored' AS outcome, COUNT(*) AS row_count FROM sales
UNION ALL SELECT 'fact_sales', 'duplicate key', COUNT(*) FROM sales WHERE date_id BETWEEN 20240108 AND 20240121""")
raw("d10_load_rejects", d10_counts, f"""{_LOADED}, shaped_users AS ({o.DIM_USERS}), shaped_books AS ({o.DIM_BOOKS})
SELECT 'dim_users' AS table_name, 'stored' AS outcome, COUNT(*) AS row_count FROM shaped_users
UNION ALL SELECT 'dim_users', 'duplicate key', COUNT(*) FROM shaped_users
UNION ALL SELECT 'dim_books', 'stored', COUNT(*) FROM shaped_books WHERE publication_year IS NOT NULL
UNION ALL SELECT 'dim_books', 'publication_year is null', COUNT(*) FROM shaped_books WHERE publication_year IS NULL
UNION ALL SELECT 'fact_sales', 'stored', COUNT(*) FROM sales""")

# ------------------------------------------------------------------------------------------------ reports

ev("q01_daily_sales_trends", lambda s: sales.daily_sales_trends(s, 30), o.trends(30))
ev("q01_daily_sales_one_end", lambda s: sales.daily_sales(s, start=FROM), o.trends(30))
ev("q01_daily_sales_both_ends", lambda s: sales.daily_sales(s, FROM, TO), o.by_range("2024-01-08", "2024-01-21"))
ev("q01_daily_sales_trends_7", lambda s: sales.daily_sales_trends(s, 7), o.trends(7))
li("q01_daily_sales_trends_lines", lambda s: sales.daily_sales_trends(s, 365), o.trends(365))
ev("q02_daily_sales_by_range", lambda s: sales.daily_sales_by_range(s, FROM, TO),
   o.by_range("2024-01-08", "2024-01-21"))
li("q02_daily_sales_by_range_lines", lambda s: sales.daily_sales_by_range(s, LINES_FROM, LINES_TO),
   o.by_range("1996-03-01", "1999-06-30"))
ev("q03_top_books", books.top_books, o.TOP_BOOKS)
li("q03_top_books_lines", books.top_books, o.TOP_BOOKS)
ev("q04_user_analytics", customers.user_analytics, o.USER_ANALYTICS)
li("q04_user_analytics_lines", customers.user_analytics, o.USER_ANALYTICS)
ev("q05_category_performance", books.category_performance, o.CATEGORY)
li("q05_category_performance_lines", books.category_performance, o.CATEGORY)
ev("q06_sales_summary", overview.sales_summary, o.SUMMARY)
li("q06_sales_summary_lines", overview.sales_summary, o.SUMMARY)
ev("q07_monthly_trends", lambda s: sales.monthly_trends(s, 12, AS_OF), o.monthly("DATE '2023-01-30'"))
li("q07_monthly_trends_lines", lambda s: sales.monthly_trends(s, 48, date(2001, 8, 1)),
   o.monthly("DATE '1997-08-01'"))
ev("q08_customer_segments", customers.customer_segments, o.segments(o.SPEND_BANDS))
li("q08_customer_segments_lines", lambda s: customers.customer_segments(s, b.LINES_BANDS),
   o.segments(o.LINES_BANDS))
ev("q09_author_performance", books.author_performance, o.AUTHORS)
li("q09_author_performance_lines", books.author_performance, o.AUTHORS)
ev("q10a_table_counts", overview.table_counts, o.TABLE_COUNTS)
ev("q10b_fact_date_range", overview.fact_date_range, o.FACT_RANGE)
li("q10b_fact_date_range_lines", overview.fact_date_range, o.FACT_RANGE)
ev("q10c_recent_sales", lambda s: sales.recent_sales(s, 30, 10, AS_OF), o.RECENT)
_TODAY = f"UNION ALL SELECT 'current_date', 'current_date', CAST({o.AS_OF} AS VARCHAR)"
ev("q10d_data_status", lambda s: overview.data_status_report(s, AS_OF), f"{o.STATUS} {_TODAY}")


def q10d_missing(spark, sf_dir):
    """The status of a star whose books are not there."""
    return overview.data_status_report(b.events_star(spark, sf_dir).replace(books=lambda: spark.read.parquet(f"{sf_dir}/no_such_table")), AS_OF)


plain("q10d_data_status_missing", q10d_missing, o.on_events(f"""{o.STATUS} {_TODAY}""").replace(
    "SELECT 'table_counts' AS probe, table_name AS item, CAST(row_count AS VARCHAR) AS value FROM counts",
    "SELECT 'table_counts' AS probe, 'error' AS item, 'PATH_NOT_FOUND' AS value"))
ev("q11_users_page", lambda s: customers.users_page(s, limit=200, offset=25),
   f"SELECT {o.USER_COLUMNS} FROM users ORDER BY user_id LIMIT 200 OFFSET 25")
ev("q11_users_after", lambda s: customers.users_after(s, paging.Cursor((USER,)), 200),
   f"SELECT {o.USER_COLUMNS} FROM users WHERE user_id > {USER} ORDER BY user_id LIMIT 200")
ev("q12_user_by_id", lambda s: customers.user_by_id(s, USER),
   f"SELECT {o.USER_COLUMNS} FROM users WHERE user_id = {USER}")
ev("q13_user_transactions", lambda s: customers.user_transactions(s, USER), f"""
SELECT transaction_id, amount, transaction_timestamp, title AS book_title, category AS book_category,
       author AS book_author, base_price FROM sales JOIN books USING (book_id) WHERE user_id = {USER}
ORDER BY transaction_timestamp DESC, transaction_id LIMIT 100""")
ev("q14_books_page", lambda s: catalog.books_page(s, limit=200, offset=25),
   f"SELECT {o.BOOK_COLUMNS} FROM books ORDER BY book_id LIMIT 200 OFFSET 25")
ev("q14_books_after", lambda s: catalog.books_after(s, paging.Cursor((BOOK,)), 200, ascending=False),
   f"SELECT {o.BOOK_COLUMNS} FROM books WHERE book_id < {BOOK} ORDER BY book_id DESC LIMIT 200")
ev("q15_book_by_id", lambda s: catalog.book_by_id(s, BOOK),
   f"SELECT {o.BOOK_COLUMNS} FROM books WHERE book_id = {BOOK}")
ev("q16_books_by_category", lambda s: summaries.books_by_category(s, CATEGORY), f"""
, {o.M02.strip()}
SELECT b.book_id, title, category, base_price, author, total_sales, total_revenue, average_price
FROM books b LEFT JOIN performance p ON b.book_id = p.book_id WHERE category = '{CATEGORY}'
ORDER BY total_revenue DESC NULLS LAST, b.book_id LIMIT 100""")
ev("q17_daily_summary", lambda s: summaries.daily_summary(s, FROM, TO), f"""
, {o.M01.strip()}
SELECT full_date, total_revenue, transaction_count, unique_users, average_transaction_value, total_quantity
FROM daily JOIN dates USING (date_id) WHERE full_date BETWEEN '2024-01-08' AND '2024-01-21'
ORDER BY full_date DESC LIMIT 100""")
ev("q18_top_books_from_summary", summaries.top_books_from_summary, f"""
, {o.M02.strip()}
SELECT book_id, title, category, author, total_sales, total_revenue, average_price, unique_customers,
       first_sale_date, last_sale_date
FROM performance JOIN books USING (book_id) ORDER BY total_revenue DESC, book_id LIMIT 50""")
ev("q19_sales_by_category", books.sales_by_category, o.sales_by_category("TRUE"))
ev("q19_sales_by_category_range", lambda s: books.sales_by_category(s, FROM, TO),
   o.sales_by_category("d.full_date BETWEEN '2024-01-08' AND '2024-01-21'"))
li("q19_sales_by_category_lines", lambda s: books.sales_by_category(s, LINES_FROM, LINES_TO),
   o.sales_by_category("d.full_date BETWEEN '1996-03-01' AND '1999-06-30'"))
ev("q20_analytics_overview", overview.analytics_overview, o.OVERVIEW)
li("q20_analytics_overview_lines", overview.analytics_overview, o.OVERVIEW)
ev("q21_user_segment_counts", customers.user_segment_counts, o.SEGMENT_COUNTS)
ev("q22_hourly_pattern", sales.hourly_pattern, o.HOURS)
ev("q23_geographic_distribution", customers.geographic_distribution, o.STATES)
ev("q24_user_behavior_analytics", overview.user_behavior_rows, o.BEHAVIOR_ROWS)


def q24_maps(star):
    """The maps of the report as rows again."""
    one = overview.user_behavior_analytics(star)

    def part(section: str, entries, key: str, value: str) -> DataFrame:
        return one.select(F.explode(entries).alias("e")).select(
            F.lit(section).alias("section"), F.col(f"e.{key}").cast("string").alias("item"), F.col(f"e.{value}").cast("double").alias("value")
        )

    maps = ("user_segments", "retention_metrics", "geographic_distribution")
    rows = [part(m, F.map_entries(m), "key", "value") for m in maps]
    rows.append(part("hourly_distribution", F.col("hourly_distribution"), "hour", "transaction_count"))
    return reduce(lambda a, c: a.unionByName(c), rows)


ev("q24_user_behavior_maps", q24_maps, o.BEHAVIOR_ROWS)
ev("q25_sales_trends", lambda s: summaries.sales_trends(s, 14, AS_OF), f"""
, {o.M01.strip()}
SELECT full_date, total_revenue, transaction_count, unique_users, average_transaction_value
FROM daily JOIN dates USING (date_id) WHERE full_date >= {o.AS_OF} - 14""")
ev("q26_top_customers", customers.top_customers, o.TOP_CUSTOMERS)
li("q26_top_customers_lines", customers.top_customers, o.TOP_CUSTOMERS)
ev("q27_table_stats", overview.table_stats, o.TABLE_STATS)


def q27_approx(star):
    """Exact rows and missing values, and whether each sketched distinct count is within 15 percent of the exact one."""
    keys = ["table_name", "column_name"]
    exact = overview.table_stats(star).select(*keys, F.col("distinct_count").alias("exact"))
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= 0.15 * F.col("exact")
    return overview.table_stats(star, "approx").join(exact, keys).select(*keys, "row_count", "null_count", near.alias("near"))


ev("q27_table_stats_approx", q27_approx,
   f"SELECT table_name, column_name, row_count, null_count, TRUE AS near FROM ({o.TABLE_STATS})")

# ------------------------------------------------------------------------------------ views and summaries

ev("v01_sales_with_dimensions", views.v_sales_with_dimensions, o.V01)
li("v01_sales_with_dimensions_lines", views.v_sales_with_dimensions, o.V01)
ev("v02_top_books", lambda s: views.v_top_books(with_stored_books(s)), o.V02)
li("v02_top_books_lines", lambda s: views.v_top_books(with_stored_books(s)), o.V02)
ev("v03_user_behavior", views.v_user_behavior, o.V03)
li("v03_user_behavior_lines", views.v_user_behavior, o.V03)
ev("m01_daily_sales_summary", lambda s: summaries.daily_sales_summary(s.sales),
   f", {o.M01.strip()} SELECT * FROM daily")
li("m01_daily_sales_summary_lines", lambda s: summaries.daily_sales_summary(s.sales),
   f", {o.M01.strip()} SELECT * FROM daily")
ev("m02_book_performance", lambda s: summaries.book_performance(s.sales, s.dates),
   f", {o.M02.strip()} SELECT * FROM performance")
li("m02_book_performance_lines", lambda s: summaries.book_performance(s.sales, s.dates),
   f", {o.M02.strip()} SELECT * FROM performance")


def m03(name):
    """Summaries stored for the sales up to ``TO``, then brought up to date with the later ones."""

    def refreshed(star):
        spark = star.sales.sparkSession
        folder = new_folder(spark, "summaries")
        prefix = _unused_prefix(folder)
        early = star.replace(sales=facts.sales_between(star.sales, end=TO))
        summaries.refresh_summaries(early, folder, prefix=prefix)
        later = facts.sales_between(star.sales, start=date(2024, 1, 22))
        summaries.refresh_summaries(star, folder, changed=later, prefix=prefix)
        kept = _taken_out(spark, prefix + name, prefix + summaries.DAILY, prefix + summaries.BOOKS)
        return kept.drop("created_at", "updated_at")

    return refreshed


def m03_parts(star):
    """A daily summary stored by month up to ``LINES_FROM``, then brought up to date with the later days: its rows, and per month
    the days and whether its files were kept."""
    spark, root = star.sales.sparkSession, new_folder(star.sales.sparkSession, "parts")
    early = summaries.daily_sales_summary(star.sales.filter(F.col("date_id") < date_id(F.lit(LINES_FROM))))
    late = summaries.daily_sales_summary(facts.sales_between(star.sales, start=LINES_FROM))
    first = manifest.merge_parts(spark, root, summaries.DAILY, [], early, "date_id", DAILY_PART)
    second = manifest.merge_parts(spark, root, summaries.DAILY, first, late, "date_id", DAILY_PART)
    rows = manifest.read_table(spark, root, summaries.DAILY, second).drop("created_at", "updated_at")
    months = spark.createDataFrame([(int(p.rpartition("=")[2]), p in first) for p in second], "month bigint, kept boolean")
    return rows, rows.groupBy(F.expr(DAILY_PART).alias("month")).agg(F.count("*").alias("days")).join(months, "month")


li("m03_merge_parts_lines", lambda s: m03_parts(s)[0], f", {o.M01.strip()} SELECT * FROM daily")
li("m03_kept_parts_lines", lambda s: m03_parts(s)[1], f""", {o.M01.strip()}
SELECT CAST(date_id // 100 AS BIGINT) AS month, COUNT(*) AS days, date_id // 100 < {LINES_FROM:%Y%m} AS kept FROM daily GROUP BY 1, 3""")
ev("m03_refresh_summaries", m03(summaries.BOOKS), f", {o.M02.strip()} SELECT * FROM performance")
ev("m03_refresh_summaries_daily", m03(summaries.DAILY), f", {o.M01.strip()} SELECT * FROM daily")
ev("m04_monthly_sales_summary", summaries.monthly_sales_summary, o.MONTHLY_SUMMARY)
li("m04_monthly_sales_summary_lines", summaries.monthly_sales_summary, o.MONTHLY_SUMMARY)


def m04_from_state(star):
    """Months from what two loads stored: daily summaries of disjoint days and bitmaps of overlapping ones."""
    early, late = facts.sales_between(star.sales, end=LINES_TO), facts.sales_between(star.sales, start=LINES_FROM)
    states = [stored_once(distinct_state.distinct_state(part, "user_id", "book_id"), "state") for part in (early, late)]
    daily = stored_once(summaries.daily_sales_summary(star.sales), summaries.DAILY)
    return distinct_state.monthly_from_state(star, daily, distinct_state.merged_state(*states))


def m01_unique_by(grain):
    def counted(star):
        state = stored_once(distinct_state.distinct_state(star.sales, "user_id", "book_id"), "state")
        return distinct_state.distinct_by(state, star.dates, grain, {"user_id": "unique_users", "book_id": "unique_books"})

    return counted


li("m04_monthly_from_state_lines", m04_from_state, o.MONTHLY_SUMMARY)
li("m01_unique_by_quarter_lines", m01_unique_by(["year", "quarter"]), """
SELECT d.year, d.quarter, COUNT(DISTINCT user_id) AS unique_users, COUNT(DISTINCT book_id) AS unique_books
FROM sales JOIN dates d USING (date_id) GROUP BY ALL""")
ev("m01_unique_by_day", m01_unique_by(["date_id"]), """
SELECT date_id, COUNT(DISTINCT user_id) AS unique_users, COUNT(DISTINCT book_id) AS unique_books FROM sales GROUP BY date_id""")
li("m01_unique_ever_lines", m01_unique_by([]), """
SELECT COUNT(DISTINCT user_id) AS unique_users, COUNT(DISTINCT book_id) AS unique_books FROM sales""")
ev("m05_category_performance", summaries.category_summary, o.CATEGORY_SUMMARY)


def m06(name):
    def refreshed(star):
        spark = star.sales.sparkSession
        folder = new_folder(spark, "aggregates")
        prefix = _unused_prefix(folder)
        summaries.create_materialized(star, folder, prefix)
        summaries.refresh_materialized(star, folder, prefix)
        return _taken_out(spark, prefix + name, prefix + summaries.MONTHLY_VIEW, prefix + summaries.CATEGORY_VIEW)

    return refreshed


ev("m06_refresh_materialized", m06(summaries.CATEGORY_VIEW), o.CATEGORY_SUMMARY)
ev("m06_refresh_materialized_monthly", m06(summaries.MONTHLY_VIEW), o.MONTHLY_SUMMARY)

# -------------------------------------------------------------------------------------------- dashboard

_DAILY = f", daily AS ({o.trends(30)})"
ev("k01_coerce_numeric",
   lambda s: dashboard.coerce_numeric(sales.daily_sales_trends(s), ["total_revenue", "day_name"]).select(
       "date", "total_revenue", "day_name"),
   f"{_DAILY} SELECT date, CAST(total_revenue AS DOUBLE) AS total_revenue, CAST(0 AS DOUBLE) AS day_name FROM daily")


def k02(star):
    daily = sales.daily_sales_trends(star)
    return daily.select(
        "date",
        dashboard.first_present(daily, dashboard.TRANSACTIONS).alias("transaction_count"),
        dashboard.first_present(daily, ("no_such_column",)).alias("missing"),
    )


ev("k02_first_present", k02, f"""{_DAILY}
SELECT date, CAST(total_transactions AS DOUBLE) AS transaction_count, CAST(0 AS DOUBLE) AS missing FROM daily""")
ev("k03_revenue_kpis",
   lambda s: dashboard.revenue_kpis(sales.daily_sales_by_range(s, FROM, TO)).select(
       F.round("total_revenue", 2).alias("total_revenue"), "total_transactions",
       F.round("avg_transaction_value", 6).alias("avg_transaction_value"), "days_with_sales"),
   f""", daily AS ({o.by_range("2024-01-08", "2024-01-21")})
SELECT CAST(SUM(total_revenue) AS DOUBLE) AS total_revenue,
       CAST(SUM(total_transactions) AS DOUBLE) AS total_transactions,
       round(CAST(SUM(total_revenue) AS DOUBLE) / CAST(SUM(total_transactions) AS DOUBLE), 6)
         AS avg_transaction_value,
       COUNT(*) AS days_with_sales FROM daily""")
ev("k04_active_user_kpis",
   lambda s: dashboard.active_user_kpis(sales.daily_sales_by_range(s, FROM, TO)),
   f""", daily AS ({o.by_range("2024-01-08", "2024-01-21")})
SELECT CAST(SUM(unique_customers) AS DOUBLE) / COUNT(*) AS avg_daily_users,
       CAST(MAX(unique_customers) AS DOUBLE) AS max_daily_users FROM daily""")
ev("k05_revenue_trend", lambda s: dashboard.revenue_trend(sales.daily_sales_trends(s)), f"""{_DAILY}
SELECT date, CAST(total_revenue AS DOUBLE) AS total_revenue,
       CAST(total_transactions AS DOUBLE) AS transaction_count FROM daily""")
ev("k06_active_users", lambda s: dashboard.active_users(sales.daily_sales_by_range(s, FROM, TO)),
   f""", daily AS ({o.by_range("2024-01-08", "2024-01-21")})
SELECT date, CAST(unique_customers AS DOUBLE) AS unique_customers,
       CAST(total_transactions AS DOUBLE) AS transaction_count FROM daily""")
ev("k07_market_share",
   lambda s: dashboard.market_share(books.category_performance(s)).withColumn(
       "market_share", F.round("market_share", 6)),
   f""", cat AS ({o.CATEGORY})
SELECT category, CAST(total_revenue AS DOUBLE) AS total_revenue,
       round(CAST(total_revenue AS DOUBLE) * 100 / CAST(SUM(total_revenue) OVER () AS DOUBLE), 6) AS market_share
FROM cat""")
ev("k08_segment_series", lambda s: dashboard.segment_series(customers.customer_segments(s)),
   f"""{o.segments(o.SPEND_BANDS).replace("SELECT *, ROUND", ", shares AS (SELECT *, ROUND")})
SELECT segment, CAST(customer_count AS DOUBLE) AS customer_count,
       CAST(total_revenue AS DOUBLE) AS total_revenue, avg_spent AS average_order_value FROM shares""")
ev("k09_top_books_series", lambda s: dashboard.top_books_series(books.top_books(s)),
   f""", top AS ({o.TOP_BOOKS})
SELECT title, CAST(total_revenue AS DOUBLE) AS total_revenue, CAST(total_sales AS DOUBLE) AS total_sales,
       CAST(unique_customers AS DOUBLE) AS unique_customers FROM top""")

# ------------------------------------------------------------------------------------- declared contracts

for _metric, _column in books.METRIC_COLUMNS.items():
    ev(f"p01_top_books_{_metric}", lambda s, m=_metric: books.top_books_by_metric(s, m, limit=20),
       o.ranked_books(_column, limit=20))
li("p01_top_books_category_lines",
   lambda s: books.top_books_by_metric(s, "books_sold", "PROMO", "yearly", 50, date(1998, 6, 30)),
   o.ranked_books("total_quantity",
                  "b.category = 'PROMO' AND d.full_date BETWEEN '1998-01-01' AND '1998-06-30'", 50))
for _grain, _unit in (("daily", "day"), ("weekly", "week"), ("monthly", "month"), ("yearly", "year")):
    ev(f"p02_sales_by_grain_{_grain}", lambda s, g=_grain: sales.sales_by_grain(s, g), o.grain(_unit))
li("p02_sales_by_grain_weekly_lines", lambda s: sales.sales_by_grain(s, "weekly"), o.grain("week"))
_FILTER = f"book_category = '{CATEGORY}' AND user_segment = '{SEGMENT}' AND full_date BETWEEN '2024-01-08' AND '2024-01-21'"
ev("p03_sales_filtered", lambda s: views.sales_filtered(s, CATEGORY, SEGMENT, FROM, TO, limit=50, offset=5),
   f""", v AS ({o.V01}) SELECT * FROM v WHERE {_FILTER}
ORDER BY transaction_timestamp DESC, transaction_id DESC LIMIT 50 OFFSET 5""")
ev("p03_sales_filtered_total", lambda s: views.sales_filtered_total(s, CATEGORY, SEGMENT, FROM, TO),
   f""", v AS ({o.V01}) SELECT COUNT(*) AS total_records, {o.total("amount")} AS total_revenue,
{o.mean("amount")} AS average_transaction_value FROM v WHERE {_FILTER}""")
ev("p04_user_history", lambda s: customers.user_history(s, USER)["purchases"], o.HISTORY_PURCHASES)
ev("p04_user_history_analytics", lambda s: customers.user_history(s, USER)["analytics"], o.HISTORY_ANALYTICS)
ev("p04_user_history_pagination", lambda s: customers.user_history(s, USER)["pagination"], f"""
SELECT COUNT(*) AS total_records, CAST(100 AS BIGINT) AS "limit", CAST(0 AS BIGINT) AS "offset"
FROM sales JOIN books USING (book_id) WHERE user_id = {USER}""")
ev("p05_retention", customers.retention, o.retention_select("monthly"))
for _period in customers.RETENTION_MONTHS:
    li(f"p05_retention_{_period}_lines", lambda s, p=_period: customers.retention(s, p),
       o.retention_select(_period))
li("p05_retention_metrics_lines", customers.retention_metrics, o.RETENTION_METRICS)
ev("p06_trend_analysis", lambda s: insights.trend_analysis(sales.daily_sales_trends(s)),
   o.trend("total_revenue"))
ev("p06_trend_points", lambda s: insights.trend_points(sales.daily_sales_trends(s), "unique_customers"),
   f"""{_DAILY}
SELECT date, CAST(unique_customers AS DOUBLE) AS value, 'unique_customers' AS label FROM daily""")
ev("p07_segment_value", customers.segment_value, o.segment_value(o.SPEND_BANDS))
li("p07_segment_value_lines", lambda s: customers.segment_value(s, b.LINES_BANDS),
   o.segment_value(o.LINES_BANDS))


def p08(star):
    """The combined report flattened to ``(part, item, value)``."""
    report = insights.comprehensive(star)
    keyed = {
        "category_performance": ("category", "total_revenue"),
        "customer_segments": ("segment", "total_revenue"),
        "top_books": ("book_id", "total_revenue"),
        "top_customers": ("user_id", "total_spent"),
    }
    rows = [
        report[part].select(
            F.lit(part).alias("part"),
            F.col(item).cast("string").alias("item"),
            F.col(value).cast("double").alias("value"),
        )
        for part, (item, value) in keyed.items()
    ]
    one = report["overview"].select(
        F.lit("overview").alias("part"),
        F.col("top_category").alias("item"),
        F.col("total_revenue").cast("double").alias("value"),
    )
    trend = report["trends"].select(
        F.lit("trends").alias("part"), F.col("metric").alias("item"), F.col("percentage_change").alias("value")
    )
    return reduce(lambda a, c: a.unionByName(c), [one, trend, *rows])


def _change(metric: str) -> str:
    return f"""SELECT 'trends' AS part, '{metric}' AS item,
round((arg_max(CAST({metric} AS DOUBLE), date) - arg_min(CAST({metric} AS DOUBLE), date)) * 100
      / abs(arg_min(CAST({metric} AS DOUBLE), date)), 4) AS value FROM daily"""


_P08_SEGMENTS = o.segments(o.SPEND_BANDS).split("SELECT *, ROUND")[0]
ev("p08_comprehensive", p08, f"""{_P08_SEGMENTS}, daily AS ({o.trends(30)}), cat AS ({o.CATEGORY}),
top AS ({o.TOP_BOOKS}), best AS ({o.TOP_CUSTOMERS}), one AS ({o.OVERVIEW})
SELECT 'overview' AS part, top_category AS item, CAST(total_revenue AS DOUBLE) AS value FROM one
UNION ALL {_change("total_revenue")} UNION ALL {_change("total_transactions")}
UNION ALL {_change("unique_customers")}
UNION ALL SELECT 'category_performance', category, CAST(total_revenue AS DOUBLE) FROM cat
UNION ALL SELECT 'customer_segments', segment, CAST(total_revenue AS DOUBLE) FROM segments
UNION ALL (SELECT 'top_books', CAST(book_id AS VARCHAR), CAST(total_revenue AS DOUBLE) FROM top
           ORDER BY total_revenue DESC, book_id LIMIT 5)
UNION ALL (SELECT 'top_customers', CAST(user_id AS VARCHAR), CAST(total_spent AS DOUBLE) FROM best
           ORDER BY total_spent DESC, user_id LIMIT 5)""")


# ------------------------------------------------------------------- optional operators for training data


def _optional(package: str, *modules: str) -> None:
    """Queries of modules that may be absent, all of which need the package. Only what is absent is left out: a module that is there is
    imported, and whatever goes wrong in it is raised. A folder without a module of its own, as deleting may leave it, is no package."""
    found = importlib.util.find_spec(package)
    if found is None or found.origin is None:
        return
    for module in modules:
        if importlib.util.find_spec(module) is not None:
            loaded = importlib.import_module(module)
            sql = loaded.oracle_sql()
            for name, query in loaded.queries().items():
                plain(name, query, sql.get(name))


_optional("tallybook.llm", "tallybook.llm.queries", "corpus_pipeline")


# ------------------------------------------------------------------------------------------- entry points


def entry(spark: SparkSession) -> DataFrame:
    """Daily sales of the last 30 days of data."""
    return sales.daily_sales_trends(b.events_star(spark, "/root/testdata/sf0.001"), 30)


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _REGISTRY.items() if sql}
