"""Stored tables: creating the star, materialised aggregates, upserts, views and listings.

A stored aggregate is an external Parquet table whose files live in a fresh folder per version. A refresh
writes the next version and then moves the table's location to it, so readers never see half a table and
nothing overwrites files it is reading.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.operators.merging import stamped, upsert
from tallybook.schemas import STAR_SCHEMAS
from tallybook.sources.manifest import Listing, listing, read_table
from tallybook.sources.scratch import new_folder
from tallybook.star import Star


def write_dimension(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def write_fact(sales: DataFrame, path: str, mode: str = "overwrite", by_day: bool = True) -> None:
    """Sales in folders by day, or with ``by_day`` off in files that are sorted by day.

    ``rebalance`` lets adaptive execution gather the rows of a day into few files and split a day that
    holds far more rows than the others, instead of writing it from one task. Rows are sorted by user inside a
    day, so that the statistics of row groups prune lookups of one user. Sorted files suit a fact of many small
    days: every task stores the rows it has, without an exchange of the whole fact, and the statistics of
    pages prune by day inside each file.
    """
    if by_day:
        days = sales.hint("rebalance", F.col("date_id")).sortWithinPartitions("date_id", "user_id")
        days.write.mode(mode).partitionBy("date_id").parquet(path)
    else:
        sales.sortWithinPartitions("date_id", "user_id").write.mode(mode).parquet(path)


def create_star(star: Star, root: str, overwrite: bool = True, by_day: bool = True) -> Star:
    """Write the star below ``root`` and return it as read back."""
    root = root.rstrip("/")
    mode = "overwrite" if overwrite else "errorifexists"
    spark = star.sales.sparkSession
    stored = star.tables()
    for name, df in stored.items():
        path = f"{root}/{name}"
        write_fact(df, path, mode, by_day) if name == "fact_sales" else write_dimension(df, path, mode)
    return read_star(spark, root, summaries="fact_daily_sales_summary" in stored)


def read_star(spark: SparkSession, root: str, summaries: bool = True, listed: Listing | None = None) -> Star:
    """The star stored below ``root``, as its newest list says, or as it lies there if it has none. Column order follows the
    schemas, wherever the partition column is."""
    listed = listing(spark, root) if listed is None else listed

    def table(name: str) -> DataFrame:
        if listed.version:
            stamps = [] if name == "dim_date" else [T.StructField(c, T.TimestampNTZType()) for c in ("created_at", "updated_at")]
            df = read_table(spark, root, name, listed.tables.get(name, []), T.StructType([*STAR_SCHEMAS[name].fields, *stamps]))
        else:
            df = spark.read.parquet(f"{root}/{name}")
        known = [c for c in STAR_SCHEMAS[name].names if c in df.columns]
        return df.select(*known, *[c for c in df.columns if c not in known])

    return Star(
        users=table("dim_users"),
        books=table("dim_books"),
        dates=table("dim_date"),
        sales=table("fact_sales"),
        daily=table("fact_daily_sales_summary") if summaries else None,
        book_performance=table("fact_book_performance") if summaries else None,
    )


def _store_version(df: DataFrame, name: str, root: str) -> str:
    path = new_folder(df.sparkSession, name, root)
    df.write.parquet(path)
    return path


def location(spark: SparkSession, name: str) -> str:
    """The folder a stored table points at."""
    row = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'").first()
    return row["data_type"]


def _point_table(spark: SparkSession, name: str, path: str, root: str, keep: int = 1) -> None:
    """Move a table to its next version. ``keep`` superseded versions stay for readers that still use them."""
    if not spark.catalog.tableExists(name):
        spark.catalog.createTable(name, path=path, source="parquet")
        return
    before = location(spark, name)
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
    spark.catalog.refreshTable(name)
    _drop_versions(spark, name, root, {path.rpartition("/")[2], before.rpartition("/")[2]}, keep)


def _drop_versions(spark: SparkSession, name: str, root: str, recent: set[str], keep: int) -> None:
    """Remove superseded version folders of a table, the oldest first, beside the newest and its predecessor."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(jvm.org.apache.hadoop.fs.Path(root, f"{name}-*")) or []
    old = [(f.getModificationTime(), f.getPath()) for f in found if f.getPath().getName() not in recent]
    old.sort(key=lambda x: x[0])
    for _, path in old[: max(0, len(old) - max(0, keep - 1))]:
        files.delete(path, True)


def drop_stored(spark: SparkSession, *names: str) -> None:
    """Take stored tables out of the catalog; external files stay."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def materialize(df: DataFrame, name: str, root: str) -> DataFrame:
    """Store an aggregate under ``name`` unless it is stored already."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        _point_table(spark, name, _store_version(df, name, root), root)
    return spark.table(name)


def refresh(df: DataFrame, name: str, root: str, keep: int = 1) -> DataFrame:
    """Recompute a stored aggregate: write the next version, then switch the table to it. Of the versions before,
    ``keep`` stay."""
    spark = df.sparkSession
    _point_table(spark, name, _store_version(df, name, root), root, keep)
    return spark.table(name)


def upsert_table(new: DataFrame, name: str, key: str, root: str, now: Column | None = None) -> DataFrame:
    """Upsert into a stored table, creating it on first use."""
    spark = new.sparkSession
    if spark.catalog.tableExists(name):
        return refresh(upsert(spark.table(name), new, key, now), name, root)
    return refresh(stamped(new, now), name, root)


def register_views(views: Mapping[str, DataFrame]) -> None:
    """Publish named views in the session."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def drop_views(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.catalog.dropTempView(name)


def list_tables(spark: SparkSession, pattern: str = "%") -> DataFrame:
    """Names of the tables and views present that match a LIKE pattern, ordered."""
    names = spark.sql("SHOW TABLES").select(F.col("tableName").alias("table_name"))
    return names.filter(F.col("table_name").like(pattern)).orderBy("table_name")


def result_envelope(df: DataFrame, query_type: str) -> dict[str, DataFrame]:
    """A result with its envelope: ``data`` are the rows as they are, ``header`` is one row with the type, the time and
    the number of rows. Both stay with Spark, whatever the size of the result."""
    header = df.agg(F.count("*").alias("row_count")).select(
        F.lit(query_type).alias("query_type"), F.current_timestamp().alias("timestamp"), "row_count"
    )
    return {"header": header, "data": df}
