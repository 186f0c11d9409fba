"""Exact distinct counts that can be merged: ids as bitmaps per day.

A day's ids are stored as one bitmap per bucket of 32,768 neighbouring ids. Bitmaps of any days, loads or sources are merged by OR, so
the distinct count of a week, a month or any other grain comes from the stored state without reading the sales, and a load
only adds its own bitmaps: a day stored twice is merged when it is read. The state suits ids that are given out densely, as
keys are: per day at most one row of 4 KiB for each bucket in use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.money import total
from tallybook.operators.combining import beside
from tallybook.star import Star


def distinct_state(sales: DataFrame, *ids: str) -> DataFrame:
    """(id_name, date_id, bucket, ids) of the whole-number columns ``ids``; null ids are left out, as a distinct count does.

    Repeated ids are combined in the map tasks, then over all tasks, so a hot day or id is spread; a bitmap is made of its at most
    32,768 bits in one place.
    """
    bit = [F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("bit")]
    named = [F.struct(F.lit(c).alias("id_name"), F.col(c).cast("bigint").alias("id")) for c in ids]
    return (
        sales.select("date_id", F.explode(F.array(*named)).alias("x"))
        .select("x.id_name", "date_id", "x.id")
        .filter(F.col("id").isNotNull())
        .select("id_name", "date_id", *bit)
        .distinct()
        .repartition("id_name", "date_id", "bucket")
        .groupBy("id_name", "date_id", "bucket")
        .agg(F.bitmap_construct_agg("bit").alias("ids"))
    )


def merged_state(*states: DataFrame) -> DataFrame:
    """One row per name, day and bucket of several states."""
    both = states[0]
    for state in states[1:]:
        both = both.unionByName(state)
    return both.groupBy("id_name", "date_id", "bucket").agg(F.bitmap_or_agg("ids").alias("ids"))


def distinct_by(state: DataFrame, dates: DataFrame, grain: Sequence[str], counts: dict[str, str]) -> DataFrame:
    """Distinct ids per grain of the calendar; ``counts`` names the result column of each id. ``grain`` may be empty."""
    keys = list(grain)
    of_grain = (
        state.filter(F.col("id_name").isin(*counts))
        .join(dates.select("date_id", *[c for c in keys if c != "date_id"]), "date_id")
        .groupBy(*keys, "id_name", "bucket")
        .agg(F.bitmap_count(F.bitmap_or_agg("ids")).alias("n"))
    )
    sums = [F.coalesce(F.sum(F.when(F.col("id_name") == c, F.col("n"))), F.lit(0)).alias(name) for c, name in counts.items()]
    return of_grain.groupBy(*keys).agg(*sums)


def monthly_from_state(star: Star, daily: DataFrame, state: DataFrame) -> DataFrame:
    """The monthly summary from the stored daily summary and the state of users and books: the sales are not read."""
    keys = ["year", "month"]
    measures = (
        daily.join(star.dates.select("date_id", *keys), "date_id")
        .groupBy(*keys)
        .agg(F.sum("transaction_count").alias("total_transactions"), total("total_revenue").alias("total_revenue"))
    )
    uniques = distinct_by(state, star.dates, keys, {"user_id": "unique_customers", "book_id": "unique_books_sold"})
    return beside(measures, uniques, on=keys).orderBy(*keys)
