"""Putting separately computed aggregates side by side."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def beside(*parts: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of aggregates of the same groups, NULL groups included.

    Several distinct counts in one aggregate multiply every input row before the shuffle. One aggregate
    per distinct column reads only its own columns from the file, and the results are small.
    """

    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        renamed = right.withColumnsRenamed({c: f"_{c}" for c in on})
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on])
        return left.join(renamed, same).drop(*[f"_{c}" for c in on])

    return reduce(join, parts)


def grouped(
    df: DataFrame, keys: list[str], additive: list[Column], distinct: Mapping[str, str]
) -> DataFrame:
    """Additive measures and distinct counts per group, each computed on its own.

    Additive measures shrink to one row per group in every map task. In one aggregate with a distinct
    count they would instead be carried along with every (group, value) pair through the shuffle.
    ``distinct`` maps the name of each count to the column counted.
    """
    counts = [
        df.select(*keys, col).groupBy(*keys).agg(F.countDistinct(col).alias(name))
        for name, col in distinct.items()
    ]
    return beside(df.groupBy(*keys).agg(*additive), *counts, on=keys)


def one_row(*parts: DataFrame) -> DataFrame:
    """One-row aggregates with different columns merged into a single row.

    The parts run side by side as one union and are folded by ``max``, which skips the NULLs that stand
    for the columns of the other parts.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    names = [c for part in parts for c in part.columns]
    return stacked.agg(*[F.max(c).alias(c) for c in names])
