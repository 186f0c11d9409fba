"""From raw feeds to a stored star."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.operators import cleaning, dimensions
from tallybook.operators.facts import fact_sales
from tallybook.operators.merging import insert_ignore, later_per_key, stamped
from tallybook.operators.quality import REASONS, not_null_rules, reject_counts, split_rejects
from tallybook.plans.summaries import book_performance, daily_sales_summary
from tallybook.schemas import NOT_NULL, TEXT_WIDTHS
from tallybook.sources.feeds import path_exists
from tallybook.sources.keyfilter import add_filters, filters_of, stored_keys
from tallybook.sources.manifest import Listing, commit, listing, merge_parts, new_load, read_table
from tallybook.sources.scratch import stored_once
from tallybook.sources.tables import read_star, write_dimension, write_fact
from tallybook.star import Star


def clean_feeds(
    raw: Mapping[str, DataFrame],
    lo: float = 0,
    hi: float = 10000,
    stored: Star | None = None,
    kept: Callable[[DataFrame, str], DataFrame] = lambda df, _: df,
) -> dict[str, DataFrame]:
    """Clean the three feeds and keep the transactions whose user and book survived or are stored already.

    ``kept`` is given each cleaned feed with its name, to store it before it is read several times.
    """
    users = kept(cleaning.clean_users(raw["users"]), "users")
    books = kept(cleaning.clean_books(raw["books"]), "books")
    transactions = cleaning.clean_transactions(raw["transactions"], lo, hi)
    known_users, known_books = users, books
    if stored is not None:
        known_users = users.select("id").union(stored.users.select("user_id")).distinct()
        known_books = books.select("book_id").union(stored.books.select("book_id")).distinct()
    return {
        "users": users,
        "books": books,
        "transactions": kept(cleaning.referential_filter(transactions, known_users, known_books), "transactions"),
    }


def _storable(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    fitted = cleaning.truncate_text(df, TEXT_WIDTHS.get(table, {}))
    return split_rejects(fitted, not_null_rules(NOT_NULL[table]))


#: The order in which the first row of a key is stored, per table.
FIRST_ROW = {
    "dim_users": ("user_id", "signup_date", "name", "email", "location"),
    "dim_books": ("book_id", "title", "isbn", "base_price", "author"),
    "fact_sales": ("transaction_id", "transaction_timestamp", "user_id", "book_id", "amount"),
}
DUPLICATE = "duplicate key"


def _split(df: DataFrame, table: str, target: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Rows to store and rejects. Both together are all rows of ``df``."""
    ok, rejected = _storable(df, table)
    key, *order = FIRST_ROW[table]
    firsts = insert_ignore(ok, key, *order)
    later = later_per_key(ok, firsts, key, target).withColumn(REASONS, F.array(F.lit(DUPLICATE)))
    fresh = firsts if target is None else firsts.join(target.select(key), key, "left_anti").select(*firsts.columns)
    return fresh, rejected.unionByName(later)


def build_star(
    feeds: Mapping[str, DataFrame],
    dates: DataFrame,
    as_of: date | None = None,
    stored: Star | None = None,
) -> tuple[Star, dict[str, DataFrame]]:
    """The star of cleaned feeds, and the rows each table rejects.

    Rows that miss a required column are rejected; of the rest the first row per key is kept: users by
    sign-up date, books by title, sales by time. Later rows of a key, and with ``stored`` all rows of a key that is
    stored, are rejected as duplicates, so for every table the rows of the feed are those kept and those rejected.
    """
    tables = {
        "dim_users": (dimensions.dim_users(feeds["users"], as_of), stored and stored.users),
        "dim_books": (dimensions.dim_books(feeds["books"], as_of), stored and stored.books),
        "fact_sales": (fact_sales(feeds["transactions"]), stored and stored.sales),
    }
    split = {name: _split(df, name, target) for name, (df, target) in tables.items()}
    star = Star(users=split["dim_users"][0], books=split["dim_books"][0], dates=dates, sales=split["fact_sales"][0])
    return star, {name: rejected for name, (_, rejected) in split.items()}


#: Parts of the stored summaries that are rewritten as a whole: the days of a month, and so many shares of the books.
DAILY_PART = "date_id DIV 100"
BOOK_PART = "pmod(xxhash64(book_id), 16)"


def _summaries(star: Star, fresh: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Daily and book summary of the stored sales, or of the days and books that ``fresh`` sales touch."""
    if fresh is None:
        return daily_sales_summary(star.sales), book_performance(star.sales, star.dates)
    of_days = star.sales.join(fresh.select("date_id").distinct(), "date_id", "left_semi")
    of_books = star.sales.join(fresh.select("book_id").distinct(), "book_id", "left_semi")
    return daily_sales_summary(of_days), book_performance(of_books, star.dates)


def load_all(
    spark: SparkSession,
    raw: Mapping[str, DataFrame],
    root: str,
    as_of: date | None = None,
    dates: DataFrame | None = None,
    lo: float = 0,
    hi: float = 10000,
    now: Column | None = None,
    mode: str = "overwrite",
) -> tuple[Star, dict[str, DataFrame]]:
    """Load everything below ``root``: calendar, users, books, sales, then the two summaries.

    ``mode="append"`` adds to what is stored there: stored rows win over new ones of the same key, and a first
    load is the same in both modes. A sale may name a user or book of this load or a stored one. Rejects are stored and returned
    as read back. All tables but the calendar carry ``created_at`` and ``updated_at``.

    Each cleaned feed is stored once and its rows are then told apart. All tables go to folders of this load, and the
    last step lists them (``sources.manifest``): until then readers see the load before, and a load that died can be run
    again as if it had never been. An append computes anew the summary rows of the days and books it touches, and rewrites the parts
    of the summaries that hold them. Which new sales are stored already it learns from key filters (``sources.keyfilter``), which it makes
    for loads that have none yet: the stored fact is not shuffled, and of its files only those that may hold a new key are read.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode must be 'overwrite' or 'append', got {mode!r}")
    root = root.rstrip("/")
    before = listing(spark, root)
    if mode == "append" and not before.version and path_exists(spark, f"{root}/fact_sales"):
        raise ValueError(f"{root} was not stored by a load: load it with mode='overwrite' first")
    appends = mode == "append" and before.version > 0
    stored = read_star(spark, root, summaries=False, listed=before) if appends else None
    listed = dict(before.tables) if appends else {}
    load = new_load()

    def add(name: str, df: DataFrame, write: Callable[[DataFrame, str], None] = write_dimension) -> DataFrame:
        write(df, f"{root}/{name}/{load}")
        listed[name] = [*listed.get(name, []), load]
        return read_table(spark, root, name, [load], df.schema)

    if not appends:
        add("dim_date", dimensions.dim_date(spark, style="mon1") if dates is None else dates)
    feeds = clean_feeds(raw, lo, hi, stored, kept=lambda df, name: stored_once(df, f"load-{name}"))
    shaped = {
        "dim_users": (dimensions.dim_users(feeds["users"], as_of), stored and stored.users, write_dimension),
        "dim_books": (dimensions.dim_books(feeds["books"], as_of), stored and stored.books, write_dimension),
        "fact_sales": (fact_sales(feeds["transactions"]), stored and stored.sales, write_fact),
    }

    def known_keys(name: str, new: DataFrame, key: str, target: DataFrame) -> DataFrame:
        """Keys that new rows may not have: of the fact those the key filters find, of a dimension all of them."""
        if name != "fact_sales":
            return target.select(key)
        loads, filters = before.tables.get(name, []), filters_of(name)
        listed[filters] = add_filters(spark, root, name, loads, before.tables.get(filters, []), key, target.schema)
        return stored_keys(spark, root, name, loads, new, key, target.schema)

    def load_table(name: str) -> DataFrame:
        df, target, write = shaped[name]
        ok, rejected = _storable(df, name)
        key, *order = FIRST_ROW[name]
        firsts = insert_ignore(ok, key, *order)
        held = None if target is None else known_keys(name, ok, key, target)
        fresh = firsts if held is None else firsts.join(held, key, "left_anti").select(*firsts.columns)
        added = add(name, stamped(fresh, now), write)
        # Later rows of a key are those that were not stored just now.
        later = later_per_key(ok, added.select(*ok.columns), key).withColumn(REASONS, F.array(F.lit(DUPLICATE)))
        add(f"rejects/{name}", rejected.unionByName(later))
        return added

    # The jobs of tables that do not wait for each other are submitted together.
    with ThreadPoolExecutor(len(shaped)) as pool:
        added = dict(zip(shaped, pool.map(inheritable_thread_target(spark)(load_table), shaped), strict=True))
    rejects = {name: f"rejects/{name}" for name in shaped}
    loaded = read_star(spark, root, summaries=False, listed=Listing(before.version + 1, listed))
    daily, per_book = _summaries(loaded, added["fact_sales"] if appends else None)
    stored_by_part = {
        "fact_daily_sales_summary": (daily, "date_id", DAILY_PART),
        "fact_book_performance": (per_book, "book_id", BOOK_PART),
    }

    def store_summary(name: str) -> list[str]:
        summary, key, part = stored_by_part[name]
        return merge_parts(spark, root, name, listed.get(name, []), summary, key, part, now)

    with ThreadPoolExecutor(len(stored_by_part)) as pool:
        listed |= dict(zip(stored_by_part, pool.map(inheritable_thread_target(spark)(store_summary), stored_by_part), strict=True))
    after = commit(spark, root, before, listed)
    return read_star(spark, root, listed=after), {name: read_table(spark, root, path, listed[path]) for name, path in rejects.items()}


def load_counts(star: Star, rejects: Mapping[str, DataFrame]) -> DataFrame:
    """Stored rows and rejected rows by table and reason."""
    stored = {"dim_users": star.users, "dim_books": star.books, "fact_sales": star.sales}
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), F.lit("stored").alias("outcome"), "row_count") for n, df in stored.items()]
    parts += [reject_counts(df).select(F.lit(n).alias("table_name"), F.col("reason").alias("outcome"), "row_count") for n, df in rejects.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
