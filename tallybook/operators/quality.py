"""Constraint checks. Each returns the offending rows or keys; nothing is enforced by the file format."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.rules import met

REASONS = "reject_reasons"


def tag_rejects(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``reject_reasons``: the names of the rules each row breaks, in rule order."""
    broken = [F.when(~met(rule), F.lit(name)) for name, rule in rules.items()]
    return df.withColumn(REASONS, F.array_compact(F.array(*broken)))


def split_rejects(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet every rule, and the others with their reasons. A row-wise pass, no shuffle.

    The filters are plain conditions: reasons are put together only for the rows that have one.
    """
    whole = reduce(lambda a, b: a & b, map(met, rules.values()), F.lit(True))
    return df.filter(whole), tag_rejects(df.filter(~whole), rules)


def reject_counts(rejected: DataFrame) -> DataFrame:
    """Rejected rows per reason; a row broken in two ways counts under both."""
    return rejected.select(F.explode(REASONS).alias("reason")).groupBy("reason").agg(
        F.count("*").alias("row_count")
    )


def not_null_rules(cols: Iterable[str]) -> dict[str, Column]:
    return {f"{c} is null": F.col(c).isNotNull() for c in cols}


def check_not_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Rows missing a required column, with the columns they miss."""
    return split_rejects(df, not_null_rules(cols))[1]


def check_unique(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once. Counts are combined before the shuffle, so a hot key is one row."""
    return df.groupBy(*key).agg(F.count("*").alias("row_count")).filter("row_count > 1")


def check_foreign_key(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key is set but not found in the parent."""
    present = child.filter(F.col(key).isNotNull())
    return present.join(parent.select(key), key, "left_anti")


def check_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break a CHECK rule, with the names of the rules."""
    return split_rejects(df, rules)[1]
