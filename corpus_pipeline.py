"""A training corpus in five stages: documents in, a deduplicated, decontaminated, masked and mixed corpus out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of ``docs``; the last one returns each
document as often as the mix takes it. ``run`` writes the result of every stage to the shared folder and reads it back, so a
stage is computed once and a lost executor costs no more than tasks of the stage that runs.

An empty table passes through all stages; nulls, repeated rows and other columns are handled as the operators say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallybook.llm import mixing, prefix_join, quality_rules, secret_scan, wu_manber
from tallybook.sources.scratch import stored_once


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return prefix_join.unique(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item."""
    return wu_manber.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with owner-specific secrets masked."""
    return secret_scan.masked(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("prefix_join", near_duplicates),
    ("wu_manber", decontamination),
    ("secret_scans", secrets),
    ("source_mix", source_mix),
]

#: Robust estimates and set similarity are beyond plain SQL: tests compare ``run`` with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored_once(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
