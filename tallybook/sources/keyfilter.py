"""Which stored files may hold a key: Bloom filters as bitmaps, built and asked with DataFrames.

A filter is a set of blocks of 32,768 bits. A key sets ``PROBES`` bits of the one block its hash names; it may be among the keys of a
filter only if all of them are set. There is a filter for every file of a load, and one for the load as a whole. A lookup asks
the loads first, then, with the few keys that some load may hold, their files, and reads just the files that answer. What it finds
there is exact: a false positive costs a read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallybook.sources.manifest import read_table
from tallybook.sources.scratch import stored_once

#: Bits of a block, as ``bitmap_construct_agg`` makes them.
BLOCK = 32_768
#: Bits a key gets, and how many of them it sets: about one false positive in a thousand.
BITS_PER_KEY = 16
PROBES = 8
#: File name under which the filter of a whole load is stored.
WHOLE = ""


def _bit(key: Column, probe: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(probe), key), F.lit(BLOCK))


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), key), blocks)


def key_filters(keys: DataFrame, key: str, file: str) -> DataFrame:
    """(file, blocks, block, bits) of the keys in each file and, under ``WHOLE``, of all files together.

    The number of blocks of a filter is a power of two, so few sizes occur. Null keys are left out.
    """
    pairs = keys.select(F.col(key).alias("key"), F.explode(F.array(F.col(file), F.lit(WHOLE))).alias("file")).filter("key IS NOT NULL")
    need = F.count("*") * BITS_PER_KEY / BLOCK
    sizes = pairs.groupBy("file").agg(F.pow(F.lit(2), F.ceil(F.log2(F.greatest(need, F.lit(1.0))))).cast("bigint").alias("blocks"))
    place, probes = ["file", "blocks", "block"], [f"bit_{i}" for i in range(1, PROBES + 1)]
    bits = [_bit(F.col("key"), i).alias(p) for i, p in enumerate(probes, 1)]
    # Keys are shuffled, not bitmaps: a task has few keys of each block.
    dealt = pairs.join(sizes, "file").withColumn("block", _block(F.col("key"), F.col("blocks"))).repartition(*place)
    # One row per key is sorted, not one per bit: every probe has a bitmap of its own, and the few bitmaps of a block are joined.
    apart = dealt.select(*place, *bits).groupBy(*place).agg(F.array(*[F.bitmap_construct_agg(p) for p in probes]).alias("apart"))
    return apart.select(*place, F.explode("apart").alias("bits")).groupBy(*place).agg(F.bitmap_or_agg("bits").alias("bits"))


def possible(keys: DataFrame, key: str, filters: DataFrame) -> DataFrame:
    """(key, file) for every filter that may hold the key."""
    # At most one size per power of two.
    sizes = [r["blocks"] for r in filters.select("blocks").distinct().collect()]
    if not sizes:
        return keys.select(F.col(key), F.lit(WHOLE).alias("file")).limit(0)
    asked = keys.select(F.col(key).alias("key"), F.explode(F.array(*[F.lit(int(s)) for s in sizes])).alias("blocks"))
    asked = asked.withColumn("block", _block(F.col("key"), F.col("blocks")))
    byte = lambda bit: F.conv(F.hex(F.substring(F.col("bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.lit(True)
    for i in range(1, PROBES + 1):
        bit = _bit(F.col("key"), i)
        hit = hit & (F.getbit(byte(bit), (bit % 8).cast("int")) == 1)
    return asked.join(filters, ["blocks", "block"]).filter(hit).select(F.col("key").alias(key), "file")


SCHEMA = "file string, blocks bigint, block bigint, bits binary"


def filters_of(name: str) -> str:
    """Where the filters of a stored table are listed."""
    return f"keys/{name}"


def add_filters(spark: SparkSession, root: str, name: str, loads: Sequence[str], have: Sequence[str], key: str, schema: StructType) -> list[str]:
    """Store the filters of the loads of a table that have none yet, each in a folder named as the load; all folders now.

    Only the key column of those loads is read.
    """
    for load in [x for x in loads if x not in have]:
        base = f"{root}/{name}"
        stored = spark.read.option("basePath", base).schema(schema).parquet(f"{base}/{load}")
        file = F.substring_index(F.col("_metadata.file_path"), f"/{name}/", -1).alias("_file")
        filters = key_filters(stored.select(key, file), key, "_file")
        # A load that died may have left filters of this load behind: they are equal, and are written anew.
        filters.sortWithinPartitions("file").write.mode("overwrite").parquet(f"{root}/{filters_of(name)}/{load}")
    return sorted(loads)


def stored_keys(spark: SparkSession, root: str, name: str, loads: Sequence[str], new: DataFrame, key: str, schema: StructType) -> DataFrame:
    """Those keys of ``new`` that the loads of a table hold, each once: what a semi-join with the table gives.

    Of the table only the files are read whose filter may hold a new key; their names pass the driver, as those of
    a scan do. If no filter does, no file is read.
    """
    filters = read_table(spark, root, filters_of(name), loads, StructType.fromDDL(SCHEMA))
    keys = new.select(key).filter(F.col(key).isNotNull()).distinct()
    maybe = stored_once(possible(keys, key, filters.filter(F.col("file") == WHOLE)).select(key).distinct(), "maybe-stored")
    files = candidate_files(maybe, key, filters)
    if not files:
        return maybe.limit(0)
    base = f"{root}/{name}"
    found = spark.read.option("basePath", base).schema(schema).parquet(*[f"{base}/{f}" for f in files])
    return maybe.join(found.select(key), key, "left_semi")


def candidate_files(keys: DataFrame, key: str, filters: DataFrame) -> list[str]:
    """Files below the table's folder that may hold one of the keys."""
    of_files = filters.filter(F.col("file") != WHOLE)
    return sorted(r["file"] for r in possible(keys, key, of_files).select("file").distinct().collect())
