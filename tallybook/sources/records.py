"""Records of CSV files with line breaks inside quoted fields, read by many tasks per file.

A file is read in its usual byte ranges, line by line. Whether a line begins inside a quoted field depends on everything before it,
but one bit tells: each line maps "begins a record" and "begins inside quotes" to the same two states at its end. First, every task composes the
maps of its range, one row per range, and the maps are combined in file order (windows over these few rows), which gives the
state that each range begins in. Then every task cuts its range into records. A record that crosses ranges comes as fragments,
at most two per range, which are joined afterwards. The text is read twice and never shuffled.

The rules are those of Spark's reader with doubled quotes: only a field that begins with a quote is quoted; text after its closing
quote up to the next comma belongs to the field. A record ends at a line feed, with or without a carriage return before it; files that
end records with a carriage return alone are not read. Lines without any character are no records.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_QUOTED = rb'[^"]*+(?:""[^"]*+)*+'
_FIELD = rb'(?:"' + _QUOTED + rb'"[^,]*+|[^",][^,]*+|)'
_OPEN = re.compile(rb"(?:" + _FIELD + rb',)*+"' + _QUOTED)
_INSIDE = re.compile(_QUOTED)
_RANGE = ["file", "block"]


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line."""
    if inside:
        closing = _INSIDE.match(line).end()
        comma = line.find(b",", closing) if closing < len(line) else -1
        if closing == len(line) or comma < 0:
            return closing == len(line)
        line = line[comma + 1 :]
    return _OPEN.fullmatch(line) is not None


def _by_range(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The parts of a batch that belong to one byte range. Rows of a range follow one another."""
    keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    at = 0
    for key, rows in groupby(keys):
        n = sum(1 for _ in rows)
        yield key, batch.slice(at, n)
        at += n


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per byte range: the state at its end if it begins with a record, and if it begins inside quotes."""
    now, states = None, (False, True)

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"file": [now[0]], "block": [now[1]], "fresh": [states[0]], "inside": [states[1]]})

    for batch in batches:
        for key, part in _by_range(batch):
            if key != now:
                if now is not None:
                    yield row()
                now, states = key, (False, True)
            lines = part.column(2)
            # A line without a quote leaves both states as they are.
            for line in lines.filter(pc.match_substring(lines, '"')).to_pylist():
                states = tuple(ends_inside(line, s) for s in states)
    if now is not None:
        yield row()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records (piece 0), the end of a record of an earlier range (1, or 2 if it goes on) and the start of one (3).

    ``head`` is true for the first record of a file.
    """
    names = ["file", "block", "piece", "record", "head"]
    now, inside, piece, held, head = None, False, 0, [], False

    def rows(pieces: list[int], records: list[bytes], heads: list[bool]) -> pa.RecordBatch:
        n = len(records)
        columns = [pa.array([now[0]] * n, pa.string()), pa.array([now[1]] * n, pa.int64()), pa.array(pieces, pa.int32())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(records, pa.binary()), pa.array(heads, pa.bool_())], names)

    def rest() -> Iterator[pa.RecordBatch]:
        if held:
            yield rows([2 if piece else 3], [b"\n".join(held)], [head])

    for batch in batches:
        for key, part in _by_range(batch):
            if key != now:
                yield from rest()
                now, held, head = key, [], key[1] == 0
                inside = part.column(3)[0].as_py()
                piece = 1 if inside else 0
            lines = part.column(2)
            if not inside and not head and not pc.any(pc.match_substring(lines, '"')).as_py():
                found = [line.removesuffix(b"\r") for line in lines.to_pylist()]
                found = [line for line in found if line]
                yield rows([0] * len(found), found, [False] * len(found))
                continue
            pieces, records, heads = [], [], []
            for line in lines.to_pylist():
                held.append(line)
                inside = ends_inside(line, inside)
                if not inside:
                    record = b"\n".join(held).removesuffix(b"\r")
                    if record or piece:
                        pieces.append(piece)
                        records.append(record)
                        heads.append(head and not piece)
                        head = head and bool(piece)
                    piece, held = 0, []
            yield rows(pieces, records, heads)
    yield from rest()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, head, open) of every record: its text, whether it is the first of its file, and whether its last quote is never closed."""
    source = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(source["file_path"].alias("file"), source["file_block_start"].alias("block"), F.col("value").cast("binary").alias("line"))
    maps = lines.mapInArrow(_maps, "file string, block bigint, fresh boolean, inside boolean")

    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    swapped = (F.col("fresh") & ~F.col("inside")).cast("int")
    fixed = F.when(F.col("fresh") == F.col("inside"), F.struct(F.col("fresh").cast("int").alias("state"), F.col("swaps").alias("swaps")))
    # The state after the last range that ends in one state whatever it begins in, turned over by the ranges since that swap both.
    last = F.last("fixed", ignorenulls=True).over(before)
    since = F.coalesce(F.sum("swap").over(before), F.lit(0)) - F.coalesce(last["swaps"], F.lit(0))
    states = maps.withColumn("swap", swapped).withColumn("swaps", F.sum("swap").over(order)).withColumn("fixed", fixed)
    states = states.select(*_RANGE, ((F.coalesce(last["state"], F.lit(0)) + since) % 2 == 1).alias("begins_inside"))

    placed = lines.withColumn("at", F.monotonically_increasing_id()).join(states, _RANGE)
    ordered = placed.sortWithinPartitions(*_RANGE, "at").select(*_RANGE, "line", "begins_inside")
    cut = ordered.mapInArrow(_cut, "file string, block bigint, piece int, record binary, head boolean")

    whole = cut.where("piece = 0").select("record", "head", F.lit(False).alias("open"))
    pieces = Window.partitionBy("file").orderBy("block", "piece")
    parts = cut.where("piece > 0").withColumn("of", F.sum((F.col("piece") == 3).cast("int")).over(pieces))
    text = F.transform(F.array_sort(F.collect_list(F.struct("block", "piece", "record"))), lambda x: x["record"].cast("string"))
    joined = parts.groupBy("file", "of").agg(
        F.array_join(text, "\n").cast("binary").alias("record"), F.max("head").alias("head"), (~F.max(F.col("piece") == 1)).alias("open")
    )
    every = whole.union(joined.select("record", "head", "open"))
    return every.select(F.col("record").cast("string").alias("record"), "head", "open")
