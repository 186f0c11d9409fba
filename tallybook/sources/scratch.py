"""Where intermediate files go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only with a local master, where driver and executors are one process, a folder of this machine stands in.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share (master is {master})")
    return tempfile.mkdtemp(prefix="tallybook-")


def new_folder(spark: SparkSession, label: str, root: str | None = None) -> str:
    """A path nobody has used yet."""
    base = (root or scratch_root(spark)).rstrip("/")
    return f"{base}/{label}-{uuid.uuid4().hex}"


def stored_once(df: DataFrame, label: str, root: str | None = None) -> DataFrame:
    """Write a result that several steps read, and read it back: computed once, safe from lost executors."""
    path = new_folder(df.sparkSession, label, root)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
