from __future__ import annotations

from datetime import datetime

from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallybook.operators import merging
from tallybook.operators.ranking import global_ranks, top_rank

EARLY, LATE = datetime(2024, 1, 1), datetime(2024, 2, 1)


def _at(moment):
    return F.lit(str(moment)).cast("timestamp_ntz")


def test_insert_ignore(spark):
    target = spark.createDataFrame([(1, "old")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (2, "b"), (2, "a"), (None, "n"), (3, "c")], "k int, v string")
    assert rows(merging.insert_ignore(new, "k", "v")) == [(1, "x"), (2, "a"), (3, "c")]
    merged = merging.insert_ignore(new, "k", "v", target=target)
    assert rows(merged) == [(1, "old"), (2, "a"), (3, "c")]
    assert rows(merging.insert_ignore(new, "k", "v", target=merged)) == rows(merged)


def test_upsert(spark):
    target = merging.stamped(spark.createDataFrame([(1, 10), (2, 20)], "k int, v int"), _at(EARLY))
    new = spark.createDataFrame([(2, None), (3, 30)], "k int, v int")
    once = merging.upsert(target, new, "k", _at(LATE))
    assert rows(once) == [(1, 10, EARLY, EARLY), (2, None, EARLY, LATE), (3, 30, LATE, LATE)]
    assert rows(merging.upsert(once, new, "k", _at(LATE))) == rows(once)


def test_global_ranks_match_plain_rank(spark):
    df = spark.range(5000).select(
        F.col("id"),
        F.when(F.col("id") % 50 == 0, None).otherwise(F.col("id") * 7919 % 701).alias("a"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") * 31 % 97).alias("b"),
    )
    plain = df.select(
        "id",
        F.rank().over(Window.orderBy(F.col("a").desc_nulls_first())).cast("bigint").alias("ra"),
        F.rank().over(Window.orderBy(F.col("b").desc())).cast("bigint").alias("rb"),
    )
    for slices in (2, 7, 64):
        ranked = global_ranks(df, {"a": "ra", "b": "rb"}, slices)
        assert ranked.count() == 5000
        assert ranked.select("id", "ra", "rb").exceptAll(plain).count() == 0


def test_rank_ties(spark):
    df = spark.createDataFrame([("x", 5), ("y", 5), ("z", 3)], "k string, v int")
    assert rows(global_ranks(df, {"v": "r"}), "k", "r") == [("x", 1), ("y", 1), ("z", 3)]
    assert rows(top_rank(df, "v", "k", 3), "k", "rank") == [("x", 1), ("y", 1), ("z", 3)]
