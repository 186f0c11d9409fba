"""The most frequent keys of a counted table, as many as fit a bound."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def most_frequent(counts: DataFrame, n: str, limit: int) -> pa.Table:
    """All rows whose count lies above a level, at most ``limit`` of them, collected.

    The level comes from a histogram of at most some hundred classes of counts (eight for each doubling), so no more
    than ``limit`` rows ever reach the driver. A class that does not fit as a whole is left out.
    """
    level = F.floor(8 * F.log2(F.col(n).cast("double")))
    histogram = counts.where(F.col(n) > 0).groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect()
    total, least = 0, None
    for row in sorted(histogram, key=lambda r: -r["level"]):
        total += row["rows"]
        if total > limit:
            break
        least = row["level"]
    chosen = counts.where((F.col(n) > 0) & (level >= F.lit(least))) if least is not None else counts.limit(0)
    return chosen.toArrow()
