"""Cleaning of the raw text feeds and the projections written to the curated files.

Every step is a projection or a filter over the scan; only ``referential_filter`` joins.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions import parsing
from tallybook.functions.dates import date_id
from tallybook.functions.money import AMOUNT_TYPE
from tallybook.functions.text import empty_to_null


def parsed_once(df: DataFrame, *parsed: Column) -> DataFrame:
    """A projection that later filters do not move below.

    Spark pushes a filter on a computed column under the projection and evaluates the parsing again there,
    several times for a range check. Generating the row from a one-element array keeps it to one
    evaluation, which halves the time of cleaning a text feed.
    """
    return df.select(F.inline(F.array(F.struct(*parsed))))


def clean_users(users: DataFrame) -> DataFrame:
    """Parse ``id`` and ``signup_date``; drop rows where either is missing."""
    return users.withColumns(
        {
            "id": parsing.parse_long(F.col("id")),
            "signup_date": parsing.parse_date(F.col("signup_date")),
        }
    ).filter(F.col("id").isNotNull() & F.col("signup_date").isNotNull())


def clean_transactions(transactions: DataFrame, lo: float = 0, hi: float = 10000) -> DataFrame:
    """Parse ids, amount and timestamp; drop rows missing any of them or with an amount outside [lo, hi].

    The bounds are applied to the parsed double, before it is rounded to cents. A missing
    ``transaction_id`` is kept here.
    """
    parsed = parsed_once(
        transactions,
        parsing.parse_long(F.col("transaction_id")).alias("transaction_id"),
        parsing.parse_long(F.col("user_id")).alias("user_id"),
        parsing.parse_long_via_double(F.col("book_id")).alias("book_id"),
        parsing.parse_double(F.col("amount")).alias("amount"),
        parsing.parse_timestamp(F.col("timestamp")).alias("timestamp"),
    )
    complete = parsed.filter(F.col("amount").between(lo, hi)).dropna(
        subset=["timestamp", "book_id", "user_id"]
    )
    return complete.withColumn("amount", F.col("amount").cast(AMOUNT_TYPE))


def clean_books(books: DataFrame) -> DataFrame:
    """Parse the numeric columns; drop rows without ``book_id``."""
    return books.withColumns(
        {
            "book_id": parsing.parse_long(F.col("book_id")),
            "publication_year": parsing.parse_long(F.col("publication_year")),
            "pages": parsing.parse_long(F.col("pages")),
            "base_price": parsing.parse_double(F.col("base_price")).try_cast(AMOUNT_TYPE),
        }
    ).filter(F.col("book_id").isNotNull())


def referential_filter(transactions: DataFrame, users: DataFrame, books: DataFrame) -> DataFrame:
    """Transactions whose user and book both exist.

    Semi joins on the bare keys. No broadcast hint: Spark broadcasts a key list it has sized below the
    threshold and otherwise sort-merges, splitting hot keys with adaptive skew handling.
    """
    user_keys = users.select(F.col("id").alias("user_id"))
    book_keys = books.select("book_id")
    return transactions.join(book_keys, "book_id", "left_semi").join(user_keys, "user_id", "left_semi")


def referential_rejects(transactions: DataFrame, users: DataFrame, books: DataFrame) -> DataFrame:
    """The transactions ``referential_filter`` removes, one row each."""
    user_keys = users.select(F.col("id").alias("user_id"), F.lit(True).alias("_user")).distinct()
    book_keys = books.select("book_id", F.lit(True).alias("_book")).distinct()
    return (
        transactions.join(book_keys, "book_id", "left")
        .join(user_keys, "user_id", "left")
        .filter(F.col("_book").isNull() | F.col("_user").isNull())
        .select(*transactions.columns)
    )


def null_out(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Replace personal data by NULL, keeping name and type."""
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in cols})


def users_projection(users: DataFrame) -> DataFrame:
    """Cleaned users as written to the curated file; personal number blanked."""
    shaped = users.withColumnRenamed("id", "user_id").select(
        "user_id",
        "name",
        "email",
        "location",
        F.date_format("signup_date", parsing.DATE_FORMAT).alias("signup_date"),
        "social_security_number",
    )
    return null_out(shaped, ["social_security_number"])


def books_projection(books: DataFrame) -> DataFrame:
    """Cleaned books as written to the curated file."""
    return books.select(
        "book_id", "title", "author", "category", "publication_year", "pages", "base_price"
    )


def sales_projection(transactions: DataFrame) -> DataFrame:
    """Cleaned transactions as written to the curated file, with the derived sale columns."""
    return transactions.select(
        "transaction_id",
        "user_id",
        "book_id",
        date_id(F.col("timestamp")).cast("bigint").alias("date_id"),
        "amount",
        F.lit(1).cast("bigint").alias("quantity"),
        F.lit(0.0).alias("discount_amount"),
        F.date_format("timestamp", parsing.TIMESTAMP_FORMAT).alias("transaction_timestamp"),
    )


def fill_null_text(df: DataFrame) -> DataFrame:
    """Missing text becomes empty text."""
    return df.na.fill("")


def null_empty_text(df: DataFrame) -> DataFrame:
    """Empty text becomes missing text: the load-side counterpart of ``fill_null_text``."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: empty_to_null(F.col(c)) for c in text})


def truncate_text(df: DataFrame, widths: Mapping[str, int]) -> DataFrame:
    """Cut text columns to their declared widths."""
    present = {c: n for c, n in widths.items() if c in df.columns}
    return df.withColumns({c: F.left(F.col(c), F.lit(n)) for c, n in present.items()})


def repair_utf8(df: DataFrame) -> DataFrame:
    """Replace invalid byte sequences in text columns by the replacement character."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.make_valid_utf8(F.col(c)) for c in text})


def drop_negative(df: DataFrame) -> DataFrame:
    """Drop rows with a negative amount."""
    return df.filter(F.col("amount") >= 0)
