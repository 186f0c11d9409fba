"""Every registered query against its SQL on a second engine."""

from __future__ import annotations

import os

import pytest
from compare import connect, differences
from conftest import DATA

import __spark_entry__ as entry_module

SF_DIR = f"{DATA}/{os.environ.get('ORACLE_SF', 'sf0.001')}"
QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR).toArrow()
    assert differences(got, duck.sql(ORACLE[name]).to_arrow_table()) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() == 30 and df.columns[0] == "date"
