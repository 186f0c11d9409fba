"""Writing a table and counting it in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallybook.sources.scratch import stored_once


def stored_and_counted(df: DataFrame, label: str, code: Column | None = None) -> tuple[DataFrame, tuple]:
    """The stored table, and its number of rows with the given aggregate, observed while it is written."""
    seen = Observation()
    aggregates = [F.count(F.lit(1)).alias("rows")] + ([code.alias("code")] if code is not None else [])
    stored = stored_once(df.observe(seen, *aggregates), label)
    found = seen.get
    return stored, (found["rows"], found.get("code"))
