"""Customers: spend, segments, history, retention."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.dates import calendar_days_between
from tallybook.functions.labels import SPEND_BANDS, SPEND_OTHERWISE, spend_segment
from tallybook.functions.money import ratio, total
from tallybook.operators.facts import sales_between
from tallybook.operators.paging import Cursor, page, page_after
from tallybook.star import Star

# Months in each retention period.
RETENTION_MONTHS = {"monthly": 1, "quarterly": 3, "annual": 12}


def spend_per_user(sales: DataFrame, *extra) -> DataFrame:
    """Additive measures of each user, combined in the map tasks."""
    return sales.groupBy("user_id").agg(
        F.count("transaction_id").alias("_n"),
        F.count("amount").alias("_amounts"),
        total("amount").alias("total_spent"),
        *extra,
    )


def user_analytics(star: Star, limit: int = 100) -> DataFrame:
    """Users by total spend, with the calendar days between their first and last purchase."""
    first, last = F.col("first_purchase_date"), F.col("last_purchase_date")
    per_user = spend_per_user(
        star.sales,
        F.min("transaction_timestamp").alias("first_purchase_date"),
        F.max("transaction_timestamp").alias("last_purchase_date"),
    ).filter(F.col("total_spent") > 0)
    return (
        per_user.join(star.users.select("user_id", "name", "location", "signup_date"), "user_id")
        .orderBy(F.col("total_spent").desc(), "user_id")
        .limit(limit)
        .select(
            "user_id",
            "name",
            "location",
            "signup_date",
            F.col("_n").alias("total_purchases"),
            "total_spent",
            ratio(F.col("total_spent"), F.col("_amounts")).alias("avg_purchase_value"),
            first,
            last,
            calendar_days_between(first, last).alias("customer_lifespan_days"),
        )
    )


def _spend_segments(star: Star, bands, otherwise: str) -> DataFrame:
    """Spend, purchases and segment of every user with sales."""
    buyers = spend_per_user(star.sales).join(star.users.select("user_id"), "user_id", "left_semi")
    return buyers.withColumn("segment", spend_segment(F.col("total_spent"), bands, otherwise))


def customer_segments(star: Star, bands=SPEND_BANDS, otherwise: str = SPEND_OTHERWISE) -> DataFrame:
    """Customers, revenue and averages of each spend segment, and its share of customers in percent."""
    per_segment = (
        _spend_segments(star, bands, otherwise)
        .groupBy("segment")
        .agg(
            F.count("*").alias("customer_count"),
            total("total_spent").alias("total_revenue"),
            ratio(total("total_spent"), F.count("total_spent")).alias("avg_spent"),
            ratio(F.sum("_n"), F.count("*")).alias("avg_purchases"),
        )
    )
    # The window sees one row per segment: as many as there are bands, plus one.
    everyone = F.sum("customer_count").over(Window.partitionBy())
    share = F.round(ratio(F.col("customer_count") * 100, everyone), 2)
    return per_segment.withColumn("percentage", share).orderBy(F.col("total_revenue").desc(), "segment")


def segment_value(star: Star, bands=SPEND_BANDS, otherwise: str = SPEND_OTHERWISE) -> DataFrame:
    """Worth of each spend segment.

    Average order value is revenue per transaction, lifetime value revenue per customer. The retention
    rate is the share of the segment's active user-months that were followed by another active month,
    leaving out the last month of the data, which has no successor yet.
    """
    activity = _activity(_user_periods(star, "monthly"))
    last = activity.agg(F.max("_period").alias("last")).scalar()
    months = (
        activity.filter(F.col("_period") < last)
        .groupBy("user_id")
        .agg(F.count("*").alias("_months"), F.sum("_retained").alias("_kept"))
    )
    revenue = total("total_spent")
    return (
        _spend_segments(star, bands, otherwise)
        .join(months, "user_id", "left")
        .groupBy("segment")
        .agg(
            F.count("*").alias("customer_count"),
            revenue.alias("total_revenue"),
            ratio(revenue, F.sum("_n")).alias("average_order_value"),
            ratio(F.sum("_kept"), F.sum("_months")).alias("retention_rate"),
            ratio(revenue, F.count("*")).alias("lifetime_value"),
        )
        .orderBy(F.col("total_revenue").desc(), "segment")
    )


def top_customers(star: Star, limit: int = 20) -> DataFrame:
    """Users by total spend, with the number of different books they bought."""
    kept = (
        spend_per_user(star.sales)
        .join(star.users.select("user_id", "name", "user_segment"), "user_id")
        .orderBy(F.col("total_spent").desc(), "user_id")
        .limit(limit)
    )
    # Distinct books are counted for the kept users only; a limit has a known size and is broadcast.
    matching = star.sales.select("user_id", "book_id").join(kept, "user_id")
    counted = matching.groupBy(*kept.columns).agg(F.countDistinct("book_id").alias("unique_books_purchased"))
    return counted.select(
        "user_id",
        "name",
        "user_segment",
        F.col("_n").alias("total_transactions"),
        "total_spent",
        ratio(F.col("total_spent"), F.col("_amounts")).alias("avg_transaction_value"),
        "unique_books_purchased",
    ).orderBy(F.col("total_spent").desc(), "user_id")


def user_segment_counts(star: Star) -> DataFrame:
    """Users per tenure segment."""
    return star.users.groupBy("user_segment").agg(F.count("*").alias("user_count"))


def geographic_distribution(star: Star, limit: int = 10) -> DataFrame:
    """Users per state, most first; users without a state are left out."""
    known = star.users.filter(F.col("state").isNotNull() & (F.col("state") != ""))
    return (
        known.groupBy("state")
        .agg(F.count("*").alias("user_count"))
        .orderBy(F.col("user_count").desc(), "state")
        .limit(limit)
    )


def users_page(star: Star, limit: int = 100, offset: int = 0, ascending: bool = True) -> DataFrame:
    """A page of users by id."""
    return page(_user_columns(star), "user_id", limit=limit, offset=offset, ascending=ascending)


def users_after(star: Star, after: Cursor | None = None, limit: int = 100, ascending: bool = True) -> DataFrame:
    """The page of users by id that follows a cursor."""
    return page_after(_user_columns(star), "user_id", after=after, limit=limit, ascending=ascending)


def user_by_id(star: Star, user_id: int) -> DataFrame:
    """One user, or no row. The key filter reaches the scan."""
    return _user_columns(star).filter(F.col("user_id") == user_id)


def _user_columns(star: Star) -> DataFrame:
    return star.users.select(
        "user_id",
        "name",
        "email",
        "location",
        "signup_date",
        "social_security_number",
        "state",
        "city",
        "user_segment",
    )


def user_transactions(star: Star, user_id: int, limit: int = 100) -> DataFrame:
    """The latest purchases of a user with the books they bought."""
    theirs = star.sales.filter(F.col("user_id") == user_id)
    return (
        theirs.join(star.books, "book_id")
        .select(
            "transaction_id",
            "amount",
            "transaction_timestamp",
            F.col("title").alias("book_title"),
            F.col("category").alias("book_category"),
            F.col("author").alias("book_author"),
            "base_price",
        )
        .orderBy(F.col("transaction_timestamp").desc(), "transaction_id")
        .limit(limit)
    )


def user_history(
    star: Star,
    user_id: int,
    start: date | None = None,
    end: date | None = None,
    limit: int = 100,
    offset: int = 0,
    include_analytics: bool = True,
) -> dict[str, DataFrame]:
    """A user's purchase history: ``user``, a page of ``purchases``, ``pagination`` and ``analytics``."""
    theirs = sales_between(star.sales.filter(F.col("user_id") == user_id), start, end)
    user = star.users.filter(F.col("user_id") == user_id)
    books = star.books.select("book_id", "title", "category", "author")
    bought = theirs.join(books, "book_id").select(
        "transaction_id",
        F.col("transaction_timestamp").alias("transaction_date"),
        F.col("title").alias("book_title"),
        F.col("category").alias("book_category"),
        F.col("author").alias("book_author"),
        "amount",
        "quantity",
    )
    history = {
        "user": user.select(
            "user_id", F.col("name").alias("user_name"), F.col("email").alias("user_email")
        ),
        "purchases": page(
            bought, "transaction_date", "transaction_id", limit=limit, offset=offset, ascending=False
        ),
        "pagination": bought.agg(F.count("*").alias("total_records")).select(
            "total_records",
            F.lit(limit).cast("bigint").alias("limit"),
            F.lit(offset).cast("bigint").alias("offset"),
        ),
    }
    if include_analytics:
        history["analytics"] = _history_analytics(star, theirs, user)
    return history


def _history_analytics(star: Star, theirs: DataFrame, user: DataFrame) -> DataFrame:
    """One row per user: totals, first and last purchase, favourite category, segment.

    The favourite is the category bought most often, the first by name among equals.
    """
    per_book = theirs.groupBy("user_id", "book_id").agg(
        F.count("transaction_id").alias("_n"),
        F.count("amount").alias("_amounts"),
        total("amount").alias("_spent"),
        F.min("transaction_timestamp").alias("_first"),
        F.max("transaction_timestamp").alias("_last"),
    )
    totals = per_book.groupBy("user_id").agg(
        F.sum("_n").alias("total_transactions"),
        total("_spent").alias("total_spent"),
        ratio(total("_spent"), F.sum("_amounts")).alias("average_transaction_value"),
        F.min("_first").alias("first_purchase_date"),
        F.max("_last").alias("last_purchase_date"),
        F.count("book_id").alias("unique_books_purchased"),
    )
    per_category = (
        per_book.join(star.books.select("book_id", "category"), "book_id")
        .filter(F.col("category").isNotNull())
        .groupBy("user_id", "category")
        .agg((-F.sum("_n")).alias("_minus_n"))
    )
    favourite = per_category.groupBy("user_id").agg(
        F.min(F.struct("_minus_n", "category")).getField("category").alias("favorite_category")
    )
    return (
        user.select("user_id", "user_segment")
        .join(totals, "user_id", "left")
        .join(favourite, "user_id", "left")
        .select(
            "user_id",
            F.coalesce("total_transactions", F.lit(0)).alias("total_transactions"),
            "total_spent",
            "average_transaction_value",
            "first_purchase_date",
            "last_purchase_date",
            F.coalesce("unique_books_purchased", F.lit(0)).alias("unique_books_purchased"),
            "favorite_category",
            "user_segment",
        )
    )


def _user_periods(star: Star, period: str) -> DataFrame:
    """One row per user and period with a sale.

    Periods are numbered: months since year 0, divided by the length of the period.
    """
    if period not in RETENTION_MONTHS:
        raise ValueError(f"period must be one of {sorted(RETENTION_MONTHS)}, got {period!r}")
    month = F.col("year") * 12 + F.col("month") - 1
    calendar = star.dates.select("date_id", _coarser(month, period).alias("_period"))
    active = star.sales.select("user_id", "date_id").join(calendar, "date_id").select("user_id", "_period")
    return active.filter(F.col("user_id").isNotNull()).distinct()


def _coarser(month: Column, period: str) -> Column:
    return F.floor(month / RETENTION_MONTHS[period]).cast("int")


def _activity(user_periods: DataFrame) -> DataFrame:
    """Whether each user is active in the following period too, as 0 or 1.

    The window runs per user over the periods of the calendar, never over the user's sales.
    """
    ahead = F.lead("_period").over(Window.partitionBy("user_id").orderBy("_period"))
    followed = F.coalesce(ahead == F.col("_period") + 1, F.lit(False))
    return user_periods.withColumn("_retained", followed.cast("int"))


def retention(star: Star, period: str = "monthly") -> DataFrame:
    """Share of the users active in each period who are active in the next one too.

    The last period with sales has no next one yet: its retained count and rate are NULL.
    """
    return _retention_of(_user_periods(star, period), period)


def _retention_of(user_periods: DataFrame, period: str) -> DataFrame:
    length = RETENTION_MONTHS[period]
    counts = (
        _activity(user_periods)
        .groupBy("_period")
        .agg(F.count("*").alias("active_users"), F.sum("_retained").alias("_retained"))
    )
    # One row per period of the calendar from here on.
    last = F.max("_period").over(Window.partitionBy())
    retained = F.when(F.col("_period") < last, F.col("_retained"))
    month = F.col("_period") * length
    start = F.make_date(F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"), F.lit(1))
    return (
        counts.withColumn("retained_users", retained)
        .select(
            start.alias("period_start"),
            "active_users",
            "retained_users",
            ratio(F.col("retained_users"), F.col("active_users")).alias("retention_rate"),
        )
        .orderBy("period_start")
    )


def retention_metrics(star: Star) -> DataFrame:
    """Overall retention per period length: retained over active, without the still open last period.

    Every length starts from the same user-months, so the sales are read and shuffled once.
    """
    months = _user_periods(star, "monthly")
    rows = []
    for period in RETENTION_MONTHS:
        longer = months.select("user_id", _coarser(F.col("_period"), period).alias("_period"))
        user_periods = months if period == "monthly" else longer.distinct()
        closed = _retention_of(user_periods, period).filter(F.col("retained_users").isNotNull())
        rate = closed.agg(ratio(F.sum("retained_users"), F.sum("active_users")).alias("retention_rate"))
        rows.append(rate.select(F.lit(f"{period}_retention").alias("metric"), "retention_rate"))
    stacked = rows[0]
    for row in rows[1:]:
        stacked = stacked.unionByName(row)
    return stacked
