"""Row numbers by one range exchange."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.operators.numbering import numbered


def test_places_follow_the_order(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 > 0, F.col("id") % 37).alias("v"))
    found = {r["id"]: r["position"] for r in numbered(df, [F.col("v").desc(), F.col("id").asc()]).collect()}
    order = sorted(((r["v"] is None, -(r["v"] or 0), r["id"]) for r in df.collect()))
    assert found == {row[2]: place for place, row in enumerate(order, 1)}


def test_equal_rows_and_no_rows(spark):
    same = spark.range(3000).select(F.lit(1).alias("v"))
    assert sorted(r["position"] for r in numbered(same, [F.col("v").asc()]).collect()) == list(range(1, 3001))
    assert numbered(same.limit(0), [F.col("v").asc()]).count() == 0
