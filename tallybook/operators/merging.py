"""Insert-if-absent and update-or-insert as DataFrame merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """The first row of each key in the given order.

    ``row_number() = 1`` is planned with a window group limit on both sides of the shuffle, so a map task
    sends at most one row per key and a key holding a third of the table costs nothing extra.
    """
    ranked = df.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("_nth") == 1).drop("_nth")


def later_per_key(df: DataFrame, firsts: DataFrame, key: str, target: DataFrame | None = None) -> DataFrame:
    """The rows that ``insert_ignore`` leaves out: every row but the first of its key, and all rows of keys that
    ``target`` holds. Equal rows are counted in the map tasks first, so copies of one row do not gather."""
    columns = df.columns
    counted = df.filter(F.col(key).isNotNull()).groupBy(*columns).agg(F.count("*").alias("_rows"))
    kept = firsts.withColumn("_kept", F.lit(1))
    if target is not None:
        kept = kept.join(target.select(key), key, "left_anti")
    same = [F.col(f"c.`{c}`").eqNullSafe(F.col(f"k.`{c}`")) for c in columns if c != key]
    # The key alone is an equality, so the join is on it; the other columns tell the first row from later ones.
    on = reduce(lambda a, b: a & b, same, F.col(f"c.{key}") == F.col(f"k.{key}"))
    left = counted.alias("c").join(kept.alias("k"), on, "left")
    over = F.col("_rows") - F.coalesce("_kept", F.lit(0))
    lost = left.filter(over > 0).select(*[F.col(f"c.`{c}`") for c in columns], over.cast("int").alias("_over"))
    return lost.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_over")))).drop("_over", "_copy")


def insert_ignore(
    new: DataFrame, key: str, *order: str | Column, target: DataFrame | None = None
) -> DataFrame:
    """``target`` plus the first new row of every key it does not hold yet.

    Input order is not defined in Spark, so "first" needs an explicit order. Rows without a key never
    conflict with anything and cannot be stored under a primary key; they are left out.
    """
    firsts = first_per_key(new.filter(F.col(key).isNotNull()), key, *order)
    if target is None:
        return firsts
    fresh = firsts.join(target.select(key), key, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def upsert(target: DataFrame, new: DataFrame, key: str, now: Column | None = None) -> DataFrame:
    """``new`` written over ``target`` by key.

    A key in both takes the new values, keeps ``created_at`` and gets ``updated_at = now``; a key only in
    ``new`` gets both stamps; a key only in ``target`` stays as it is. ``new`` holds one row per key. One
    full outer join, with both sides shuffled on the key at most once.
    """
    now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    measures = [c for c in new.columns if c != key]
    old = target.select("*", F.lit(True).alias("_old")).alias("o")
    fresh = new.select("*", F.lit(True).alias("_new")).alias("n")
    joined = old.join(fresh, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    is_new = F.col("_new").isNotNull()
    merged = {
        key: F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")),
        **{c: F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in measures},
        "created_at": F.when(F.col("_old").isNotNull(), F.col("o.created_at")).otherwise(now),
        "updated_at": F.when(is_new, now).otherwise(F.col("o.updated_at")),
    }
    return joined.select(*[merged.get(c, F.col(f"o.{c}")).alias(c) for c in target.columns])


def stamped(df: DataFrame, now: Column | None = None) -> DataFrame:
    """Add creation and update stamps to rows stored for the first time."""
    now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    return df.withColumns({"created_at": now, "updated_at": now})
