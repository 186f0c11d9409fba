from __future__ import annotations

import os
from datetime import date

import pytest
from pyspark.sql import SparkSession

from tallybook.bindings import events_star, lines_star

DATA = os.environ.get("TESTDATA", "/root/testdata")
AS_OF = date(2024, 1, 30)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tallybook-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def events(spark):
    return events_star(spark, f"{DATA}/sf0.01")


@pytest.fixture(scope="session")
def lines(spark):
    return lines_star(spark, f"{DATA}/sf0.001")


def rows(df, *cols):
    """Collected rows as sorted tuples."""
    picked = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in picked.collect()), key=str)
