"""The star bound to the provided test tables.

``events`` profile: purchases of the event table, with customers as users and parts as books.
``lines`` profile: order lines, for volume; its transaction ids repeat, its days run over seven years.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.dates import date_id
from tallybook.functions.money import AMOUNT_TYPE
from tallybook.operators.dimensions import CALENDAR_END, CALENDAR_START, dim_books, dim_date, dim_users
from tallybook.sources.scratch import new_folder
from tallybook.sources.tables import write_fact
from tallybook.star import Star

AS_OF = date(2024, 1, 30)
LINES_CALENDAR = (date(1995, 1, 1), date(2001, 12, 31))
# Spend bands that split the customers of the ``lines`` profile, whose amounts are far larger.
LINES_BANDS = ((2_000_000, "High Value"), (1_500_000, "Medium Value"), (500_000, "Low Value"))


# Columns of the test tables. Naming them saves a job per table that reads file footers.
TABLE_COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_COLUMNS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def users_feed(spark: SparkSession, sf_dir: str, as_of: date = AS_OF) -> DataFrame:
    """Customers as cleaned users."""
    key = F.col("c_custkey")
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.alias("id"),
            F.col("c_name").alias("name"),
            F.concat(F.lit("c"), key.cast("string"), F.lit("@example.com")).alias("email"),
            F.concat("n_name", F.lit(", "), "r_name").alias("location"),
            F.date_sub(F.lit(as_of), (key * 37 % 730).cast("int")).alias("signup_date"),
            F.lpad(key.cast("string"), 9, "0").alias("social_security_number"),
            F.col("c_mktsegment").alias("_segment"),
        )
    )


def books_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cleaned books."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("book_id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("category"),
        (F.col("p_retailprice").cast(AMOUNT_TYPE) - 900).cast(AMOUNT_TYPE).alias("base_price"),
        F.col("p_brand").alias("author"),
        F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("isbn"),
        (F.col("p_size") + 1974).alias("publication_year"),
        (F.col("p_size") * 10).alias("pages"),
        F.concat(F.lit("Pub "), "p_brand").alias("publisher"),
    )


def event_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as fact rows. The type filter and the few columns used reach the scan."""
    bought = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    return bought.select(
        F.col("event_id").alias("transaction_id"),
        "user_id",
        F.get_json_object("props", "$.k").try_cast("bigint").alias("book_id"),
        date_id(F.col("ts")).alias("date_id"),
        F.col("value").cast(AMOUNT_TYPE).alias("amount"),
        F.lit(1).alias("quantity"),
        F.lit(0).cast(AMOUNT_TYPE).alias("discount_amount"),
        F.col("ts").alias("transaction_timestamp"),
    )


def line_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as fact rows."""
    return (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"),
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("book_id"),
            date_id(F.col("o_orderdate")).alias("date_id"),
            F.col("l_extendedprice").cast(AMOUNT_TYPE).alias("amount"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.lit(0).cast(AMOUNT_TYPE).alias("discount_amount"),
            F.col("o_orderdate").alias("transaction_timestamp"),
        )
    )


def _star(spark: SparkSession, sf_dir: str, calendar: tuple[date, date], sales) -> Star:
    return Star(
        users=lambda: dim_users(users_feed(spark, sf_dir).drop("_segment"), AS_OF),
        books=lambda: dim_books(books_feed(spark, sf_dir), AS_OF),
        dates=lambda: dim_date(spark, *calendar),
        sales=lambda: sales(spark, sf_dir),
    )


def events_star(spark: SparkSession, sf_dir: str) -> Star:
    return _star(spark, sf_dir, (CALENDAR_START, CALENDAR_END), event_sales)


def lines_star(spark: SparkSession, sf_dir: str) -> Star:
    return _star(spark, sf_dir, LINES_CALENDAR, line_sales)


_stored: dict[tuple[str, ...], str] = {}


def stored_lines_star(spark: SparkSession, sf_dir: str) -> Star:
    """The lines star with its fact stored once per application and input, as a warehouse holds it.

    The input is known by its files, their lengths and times: other files are stored anew, never served by an
    older copy. The fact is built when a report first reads it.
    """

    def fact() -> DataFrame:
        files = spark.read.format("binaryFile").load([f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("lineitem", "orders")])
        mark = files.agg(
            F.count("*"), F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(20,0)"))
        ).first()
        key = (spark.sparkContext.applicationId, sf_dir, str(mark[0]), str(mark[1]))
        if key not in _stored:
            path = new_folder(spark, "lines-star")
            write_fact(line_sales(spark, sf_dir), path, by_day=False)
            _stored[key] = path
        return spark.read.parquet(_stored[key])

    return lines_star(spark, sf_dir).replace(sales=fact)


def raw_feeds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All rows of the tables as text feeds, with the faults that cleaning has to deal with.

    Customers of one market segment write their sign-up date the wrong way round, those of another have a
    malformed id. Parts of one type have no known year. Each kind of event other than a purchase carries
    one fault: a negative amount, a date without time, a malformed user, a missing book.
    """
    users = users_feed(spark, sf_dir)
    day_first = F.date_format("signup_date", "dd/MM/yyyy")
    segment = F.col("_segment")
    raw_users = users.select(
        F.when(segment == "MACHINERY", F.concat(F.lit("x"), F.col("id").cast("string")))
        .otherwise(F.col("id").cast("string"))
        .alias("id"),
        "name",
        "email",
        "location",
        F.when(segment == "BUILDING", day_first)
        .otherwise(F.date_format("signup_date", "yyyy-MM-dd"))
        .alias("signup_date"),
        "social_security_number",
    )
    books = books_feed(spark, sf_dir)
    raw_books = books.select(
        F.col("book_id").cast("string").alias("book_id"),
        "title",
        "category",
        F.col("base_price").cast("string").alias("base_price"),
        "author",
        "isbn",
        F.when(F.col("category") == "ECONOMY", F.lit("unknown"))
        .otherwise(F.col("publication_year").cast("string"))
        .alias("publication_year"),
        F.col("pages").cast("string").alias("pages"),
        "publisher",
    )
    kind = F.col("event_type")
    user = F.col("user_id").cast("string")
    book = F.concat(F.get_json_object("props", "$.k"), F.lit(".0"))
    amount = F.col("value").cast("string")
    moment = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    raw_transactions = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.when(kind == "view", F.concat(F.lit("u"), user)).otherwise(user).alias("user_id"),
        F.when(kind == "signup", F.lit("")).otherwise(book).alias("book_id"),
        F.when(kind == "error", F.concat(F.lit("-"), amount)).otherwise(amount).alias("amount"),
        F.when(kind == "click", F.date_format("ts", "yyyy-MM-dd")).otherwise(moment).alias("timestamp"),
    )
    return {"users": raw_users, "books": raw_books, "transactions": raw_transactions}
