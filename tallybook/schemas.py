"""Table schemas: column names, Spark types, declared text widths and constraints."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "amount": T.DecimalType(10, 2),
    "stored_total": T.DecimalType(15, 2),
}


def _struct(columns: str) -> T.StructType:
    """A schema from ``name type, name type, ...``; needs no session, unlike a DDL string."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# Columns of the three raw feeds, all read as text.
RAW_COLUMNS = {
    "users": ["id", "name", "email", "location", "signup_date", "social_security_number"],
    "books": [
        "book_id", "title", "category", "base_price", "author",
        "isbn", "publication_year", "pages", "publisher",
    ],
    "transactions": ["transaction_id", "user_id", "book_id", "amount", "timestamp"],
}

# Columns of the curated load files, in file order.
LOAD_SCHEMAS = {
    "dim_users": _struct(
        "user_id bigint, name string, email string, location string, signup_date date, "
        "social_security_number string"
    ),
    "dim_books": _struct(
        "book_id bigint, title string, author string, category string, publication_year int, "
        "pages int, base_price amount"
    ),
    "fact_sales": _struct(
        "transaction_id bigint, user_id bigint, book_id bigint, date_id int, amount amount, "
        "quantity int, discount_amount amount, transaction_timestamp timestamp"
    ),
}

STAR_SCHEMAS = {
    "dim_users": _struct(
        "user_id bigint, name string, email string, location string, signup_date date, "
        "social_security_number string, state string, city string, user_segment string"
    ),
    "dim_books": _struct(
        "book_id bigint, title string, category string, base_price amount, author string, "
        "isbn string, publication_year int, pages int, publisher string, price_tier string, "
        "age_category string"
    ),
    "dim_date": _struct(
        "date_id int, full_date date, year int, month int, day int, quarter int, day_of_week int, "
        "day_name string, month_name string, is_weekend boolean, is_holiday boolean, "
        "fiscal_year int, fiscal_quarter int"
    ),
    "fact_sales": LOAD_SCHEMAS["fact_sales"],
    "fact_daily_sales_summary": _struct(
        "date_id int, total_revenue stored_total, transaction_count bigint, "
        "unique_users bigint, average_transaction_value amount, total_quantity bigint"
    ),
    "fact_book_performance": _struct(
        "book_id bigint, total_sales bigint, total_revenue stored_total, "
        "average_price amount, unique_customers bigint, first_sale_date date, "
        "last_sale_date date"
    ),
}

# Primary key of each table.
PRIMARY_KEYS = {
    "dim_users": "user_id",
    "dim_books": "book_id",
    "dim_date": "date_id",
    "fact_sales": "transaction_id",
    "fact_daily_sales_summary": "date_id",
    "fact_book_performance": "book_id",
}

# Declared widths of text columns.
TEXT_WIDTHS = {
    "dim_users": {
        "name": 255, "email": 255, "location": 255, "social_security_number": 20,
        "state": 50, "city": 100, "user_segment": 50,
    },
    "dim_books": {
        "title": 500, "category": 100, "author": 255, "isbn": 20, "publisher": 255,
        "price_tier": 20, "age_category": 20,
    },
    "dim_date": {"day_name": 20, "month_name": 20},
}

# Columns that must be present in a stored row.
NOT_NULL = {
    "dim_users": ["user_id", "name", "signup_date"],
    "dim_books": [
        "book_id", "title", "category", "base_price", "author", "isbn", "publication_year",
    ],
    "dim_date": [
        "date_id", "full_date", "year", "quarter", "month", "month_name", "day", "day_of_week",
        "day_name", "is_weekend",
    ],
    "fact_sales": [
        "transaction_id", "user_id", "book_id", "date_id", "amount", "transaction_timestamp",
    ],
    "fact_daily_sales_summary": [
        "date_id", "total_revenue", "transaction_count", "unique_users",
        "average_transaction_value", "total_quantity",
    ],
    "fact_book_performance": [
        "book_id", "total_sales", "total_revenue", "average_price", "unique_customers",
    ],
}
