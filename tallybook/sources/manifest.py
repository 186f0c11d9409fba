"""Stored tables of several folders, switched together by one versioned list.

Every load writes each of its tables to a folder of its own, ``<root>/<table>/load=<id>``, and at the end the next version of
the list of folders that make up each table, ``<root>/manifest/v<number>``. Readers take the newest complete version, so
they see all of a load or nothing of it; a load that dies leaves folders that no list names. A version is written once:
of two loads that started from the same version, the second to end fails and can be run again.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallybook.operators.merging import stamped, upsert
from tallybook.sources.scratch import stored_once

#: Columns that come from folder names.
PLACES = ("load", "part")


@dataclass(frozen=True)
class Listing:
    """Version 0 is that of an empty store."""

    version: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)


def _files(spark: SparkSession, pattern: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    return [f.getPath().toString() for f in found]


def versions(spark: SparkSession, root: str) -> list[int]:
    """The complete versions, oldest first."""
    return sorted(int(p.split("/")[-2][1:]) for p in _files(spark, f"{root}/manifest/v*/_SUCCESS"))


def listing(spark: SparkSession, root: str, version: int | None = None) -> Listing:
    """A version of the list, by default the newest."""
    known = versions(spark, root)
    if not known:
        return Listing()
    version = known[-1] if version is None else version
    tables: dict[str, list[str]] = {}
    for row in spark.read.schema("table string, path string").json(f"{root}/manifest/v{version:08d}").collect():
        tables.setdefault(row["table"], []).append(row["path"])
    return Listing(version, {name: sorted(paths) for name, paths in tables.items()})


def commit(spark: SparkSession, root: str, before: Listing, tables: Mapping[str, Sequence[str]]) -> Listing:
    """Make ``tables`` the content of the store, on top of ``before``."""
    rows = [(name, path) for name, paths in tables.items() for path in paths]
    version = before.version + 1
    spark.createDataFrame(rows, "table string, path string").coalesce(1).write.json(f"{root}/manifest/v{version:08d}")
    return Listing(version, {name: sorted(paths) for name, paths in tables.items()})


def new_load() -> str:
    return f"load=l{uuid.uuid4().hex}"


def read_table(spark: SparkSession, root: str, name: str, paths: Sequence[str], schema: StructType | None = None) -> DataFrame:
    """The table made of these folders. With ``schema`` they may hold no file at all."""
    base = f"{root}/{name}"
    if not paths and schema is not None:
        return spark.createDataFrame([], schema)
    reader = spark.read.option("basePath", base)
    df = (reader if schema is None else reader.schema(schema)).parquet(*[f"{base}/{p}" for p in paths])
    return df.drop(*PLACES)


def merge_parts(
    spark: SparkSession, root: str, name: str, paths: Sequence[str], new: DataFrame, key: str, part: str, now: Column | None = None
) -> list[str]:
    """Upsert ``new`` into a table stored in one folder per ``part`` of the key: the folders that make up the table now.

    Only the parts that ``new`` touches are read and written anew, in a load of their own; the others keep their files.
    ``part`` is an SQL expression of the key and has few values: their list passes the driver.
    """
    load, old, touched = new_load(), [], set()
    if paths:
        new = stored_once(new, f"new-{name}")
        touched = {str(r["part"]) for r in new.select(F.expr(part).alias("part")).distinct().collect()}
        old = [p for p in paths if p.rpartition("part=")[2] in touched]
    merged = upsert(read_table(spark, root, name, old), new, key, now) if old else stamped(new, now)
    placed = merged.withColumn("part", F.expr(part)).hint("rebalance", F.col("part"))
    placed.write.partitionBy("part").parquet(f"{root}/{name}/{load}")
    written = {f"{load}/{p.rpartition('/')[2]}" for p in _files(spark, f"{root}/{name}/{load}/part=*")}
    return sorted({*paths} - {*old} | written)


def drop_unlisted(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Remove what no list of the newest version and the ``keep`` before it names: superseded folders and those of dead loads.

    Not while a load runs: its folders are not listed yet.
    """
    known = versions(spark, root)
    if not known:
        return []
    used, recent = set(), known[-1 - keep :]
    for version in recent:
        used |= {f"{name}/{p}" for name, paths in listing(spark, root, version).tables.items() for p in paths}
    jvm = spark.sparkContext._jvm
    folder = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files = folder(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    removed = []
    for path in _files(spark, f"{root}/*/load=*") + [p for group in ("rejects", "keys") for p in _files(spark, f"{root}/{group}/*/load=*")]:
        name = path[path.index(root.split("://")[-1]) + len(root.split("://")[-1]) + 1 :]
        inside = [u for u in used if u == name or u.startswith(f"{name}/")]
        # Of a folder in parts, single parts may be superseded.
        parts = _files(spark, f"{path}/part=*") if inside and name not in used else []
        for gone in [path] if not inside else [p for p in parts if f"{name}/{p.rpartition('/')[2]}" not in used]:
            files.delete(folder(gone), True)
            removed.append(gone)
    for version in set(known) - set(recent):
        files.delete(folder(f"{root}/manifest/v{version:08d}"), True)
    return removed
