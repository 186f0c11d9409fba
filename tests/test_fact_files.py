"""Files of a fact that is sorted by day."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallybook.sources.tables import write_fact


def test_a_fact_sorted_by_day_is_not_exchanged(spark, tmp_path):
    path = str(tmp_path / "fact")
    day = (F.lit(20240101) + F.col("id") * 7 % 28).cast("int")
    sales = spark.range(0, 3000, 1, 3).select(F.col("id").alias("transaction_id"), (F.col("id") % 11).alias("user_id"), day.alias("date_id"))
    write_fact(sales, path, by_day=False)
    stored = spark.read.parquet(path)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, sales.collect()))
    # Each task stores its own rows, in order of day and user.
    place = F.struct("date_id", "user_id")
    named = stored.select("transaction_id", place.alias("place"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    files = [x["rows"] for x in named.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("at", "place", "transaction_id"))).alias("rows")).collect()]
    assert len(files) == 3
    for rows in files:
        assert len({r["transaction_id"] // 1000 for r in rows}) == 1
        assert [r["place"] for r in rows] == sorted(r["place"] for r in rows)
