"""Row numbers over a whole table by one range exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.sources.scratch import stored_once

#: Parts that rows of one key can be dealt to.
DEALS = 256


def numbered(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """The rows with their place (from 1) in the given order, written and read back.

    Rows are dealt by ranges of the order and sorted, so a row's place is its place in its range plus the rows of the ranges
    before, one number per range. Rows that the order leaves equal follow one another in no stated order and may
    lie in several ranges. ``df`` is computed twice, once for a sample of the order: give it as a stored table.
    """
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(DEALS)).alias("_spread")
    dealt = df.select("*", spread).repartitionByRange(*order, "_spread").sortWithinPartitions(*order, "_spread")
    stored = stored_once(dealt.drop("_spread").withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    rows = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    offsets = rows.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_at").bitwiseAND((1 << 33) - 1)
    placed = stored.withColumn("_part", part).join(offsets, "_part")
    return placed.withColumn(name, F.col("_offset") + inside + 1).drop("_part", "_at", "_offset")
