"""Ranks over a whole table without sending the table through one task."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.sources.scratch import stored_once

def _ranks(df: DataFrame, measure: str, name: str, slices: int | None) -> DataFrame:
    """One row ``(_value, rank)`` per distinct value of the measure."""
    counts = df.groupBy(F.col(measure).alias("_value")).agg(F.count("*").alias("_rows"))
    high = F.col("_value").desc_nulls_first()
    ranges = counts.repartitionByRange(high) if slices is None else counts.repartitionByRange(slices, high)
    dealt = stored_once(ranges.withColumn("_slice", F.spark_partition_id()), "ranks")
    inside = Window.partitionBy("_slice").orderBy(high).rowsBetween(Window.unboundedPreceding, -1)
    higher = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("_slice")
        .agg(F.sum("_rows").alias("_slice_rows"))
        .select("_slice", F.coalesce(F.sum("_slice_rows").over(higher), F.lit(0)).alias("_offset"))
    )
    return (
        dealt.withColumn("_before", F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
        .join(offsets, "_slice")
        .select("_value", (F.col("_offset") + F.col("_before") + 1).cast("bigint").alias(name))
    )


def global_ranks(df: DataFrame, names: Mapping[str, str], slices: int | None = None) -> DataFrame:
    """Add ``rank() over (order by measure desc)`` under the given name for each measure.

    Ties share a rank and NULL ranks first, the warehouse default for a descending order. Per measure:

    1. count the rows of each distinct value (combined before the shuffle, so ties cost nothing);
    2. deal the values to ranges by one range exchange and write them: by default as many as the session shuffles to,
       which adaptive execution fits to their size;
    3. keep a running count inside each range and add the rows of all higher ranges, one row per range;
    4. join the ranks back by value; a frequent value is one row on the rank side, and adaptive
       execution splits it on the table side.

    The ranges are written because their borders come from a sample: read twice, they must be the same ranges.
    ``df`` is read once for itself and once per measure, so it should be a stored table.
    """
    ranked = df
    for measure, name in names.items():
        ranks = _ranks(df, measure, name, slices)
        ranked = ranked.join(ranks, ranked[measure].eqNullSafe(ranks["_value"])).drop("_value")
    return ranked


def top_rank(df: DataFrame, measure: str, key: str, limit: int, name: str = "rank") -> DataFrame:
    """The ``limit`` highest rows with their rank.

    Every row above a kept row is kept too, so the rank inside the kept rows is the rank overall, and the
    window sees ``limit`` rows only.
    """
    kept = df.orderBy(F.col(measure).desc(), F.col(key)).limit(limit)
    return kept.withColumn(name, F.rank().over(Window.orderBy(F.col(measure).desc())).cast("bigint"))
