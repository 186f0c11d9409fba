"""Run a registered query on Spark and its SQL on DuckDB, and compare column names, types and values."""

from __future__ import annotations

import glob
import os

import duckdb
import pyarrow as pa


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _kind(t: pa.DataType) -> str:
    if pa.types.is_timestamp(t):
        return "timestamp" if t.tz is None else "timestamp with zone"
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "string"
    if pa.types.is_decimal(t):
        return f"decimal({t.precision},{t.scale})"
    return str(t)


def _rows(table: pa.Table, names: list[str]) -> list[tuple]:
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(zip(*columns), key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(spark_table: pa.Table, duck_table: pa.Table) -> list[str]:
    names = sorted(spark_table.column_names)
    if names != sorted(duck_table.column_names):
        return [f"columns {names} vs {sorted(duck_table.column_names)}"]
    found = []
    for n in names:
        left, right = _kind(spark_table.schema.field(n).type), _kind(duck_table.schema.field(n).type)
        if left != right:
            found.append(f"type of {n}: {left} vs {right}")
    if spark_table.num_rows != duck_table.num_rows:
        found.append(f"rows {spark_table.num_rows} vs {duck_table.num_rows}")
        return found
    for left, right in zip(_rows(spark_table, names), _rows(duck_table, names)):
        if left != right:
            found.append(f"values {dict(zip(names, left))} vs {dict(zip(names, right))}")
            break
    return found
