"""Benchmark decontamination by multi-pattern search in the manner of Wu and Manber, on words.

A pattern is a window of ``size`` consecutive words of a benchmark item (an item of fewer words is one shorter pattern).
Patterns of equal length share a table: for the block of the last two words under the search position it holds how
far the position may move without passing an occurrence. Where it may not move, the block is the suffix of patterns;
its bucket lists them and all their words are compared. Texts are cut into lanes of positions which move at
once, lane by lane in numpy; a lane never looks at words of another text.

The tables depend on the benchmark only. They are built in slices of at most ``MAX_PATTERNS`` patterns, each
broadcast and searched in a pass of its own, so a benchmark of any size runs in bounded memory; hits of several
passes are united by document.

Words are compared by 64-bit codes, pattern word by pattern word. Defined cases: a null or empty text has no words and no
hits; a null or wordless item has no windows; equal windows of several items count for each of them; rows that
repeat are searched like any other; an empty table gives no rows, an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.shipping import ship
from tallybook.llm.words import ALNUM, chunks, mixed, word_codes
from tallybook.sources.scratch import stored_once

#: Patterns searched in one pass at most: a window of ten words needs about 100 bytes.
MAX_PATTERNS = 400_000
#: Positions of a lane.
LANE = 64
BLOCK_BITS = 18

_U = np.uint64


def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mixed(a * _U(0x9E3779B97F4A7C15) + b) >> _U(64 - BLOCK_BITS)).astype(np.int64)


class Patterns:
    """Patterns of one length with their block shift table, suffix buckets and the items that hold them."""

    def __init__(self, words: np.ndarray, items: np.ndarray):
        n, m = words.shape
        self.length = m
        tail = _block(words[:, -2], words[:, -1]) if m > 1 else (words[:, 0] >> _U(64 - BLOCK_BITS)).astype(np.int64)
        order = np.argsort(tail, kind="stable")
        self.words, self.items, tail = words[order], items[order], tail[order]
        self.bucket = np.searchsorted(tail, np.arange((1 << BLOCK_BITS) + 1)).astype(np.int32)
        self.shift = np.full(1 << BLOCK_BITS, max(1, m - 1), np.uint8 if m < 256 else np.int32)
        for j in range(1, m):
            np.minimum.at(self.shift, _block(words[:, j - 1], words[:, j]), m - 1 - j)
        if m == 1:
            self.shift[tail] = 0

    def find(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end position, pattern) of every occurrence that lies within one text."""
        m = self.length
        lengths = np.diff(bounds)
        lanes = np.where(lengths >= m, (lengths - m) // LANE + 1, 0)
        lane = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = np.repeat(bounds[:-1], lanes) + m - 1 + lane * LANE
        end = np.minimum(at + LANE, np.repeat(bounds[1:], lanes))
        stops = []
        while len(at):
            block = _block(codes[at - 1], codes[at]) if m > 1 else (codes[at] >> _U(64 - BLOCK_BITS)).astype(np.int64)
            shift = self.shift[block].astype(np.int64)
            stopped = shift == 0
            if stopped.any():
                stops.append((at[stopped], block[stopped]))
            at = at + np.maximum(shift, 1)
            open_ = at < end
            at, end = at[open_], end[open_]
        if not stops:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, block = np.concatenate([x for x, _ in stops]), np.concatenate([x for _, x in stops])
        found = []
        while len(place):
            low, n = self.bucket[block], self.bucket[block + 1] - self.bucket[block]
            turn = int(max(1, np.searchsorted(np.cumsum(n), 1_000_000)))
            low, n, here = low[:turn], n[:turn], place[:turn]
            who = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            where = np.repeat(here, n)
            for j in range(m):
                same = self.words[who, m - 1 - j] == codes[where - j]
                who, where = who[same], where[same]
            found.append((where, who))
            place, block = place[turn:], block[turn:]
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def windows(words: list[str] | np.ndarray, size: int) -> list:
    """The windows of an item: all runs of ``size`` words, or the whole if it is shorter."""
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if len(words) else []


def _slices(benchmark: DataFrame, size: int, item: str, text: str, limit: int) -> Iterator[tuple[list[Patterns], list]]:
    """Tables of at most about ``limit`` patterns each, with the item ids that their numbers stand for."""
    lots: dict[int, tuple[list, list]] = {}
    names: list = []
    count = 0

    def built():
        return [Patterns(np.array(w, _U), np.array(i, np.int64)) for w, i in lots.values()], list(names)

    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    for row in rows.toLocalIterator():
        for _, _, raw, offsets in chunks(pa.array([row["text"]], pa.string())):
            codes, _ = word_codes(raw, offsets, ALNUM)
            found = set(windows(codes.tolist(), size))
            if found:
                names.append(row["item"])
            for w in sorted(found):
                lot = lots.setdefault(len(w), ([], []))
                lot[0].append(w)
                lot[1].append(len(names) - 1)
            count += len(found)
        if count >= limit:
            yield built()
            lots, names, count = {}, [], 0
    if count or not names:
        yield built()


def search(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 10,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    max_patterns: int = MAX_PATTERNS,
) -> DataFrame:
    """All columns of the documents and ``__hits``: n_words, n_hit (words inside occurrences), items (sorted strings)."""
    slices = _slices(benchmark, size, item, item_text, max_patterns)
    first, second = next(slices), next(slices, None)
    if second is None:
        return _finished(_searched(docs, first, text))
    # Rows are numbered in a stored copy, searched once for each slice, and hits are united by row.
    numbered = stored_once(docs.withColumn("__row", F.monotonically_increasing_id()), "search-rows")
    parts = [_searched(numbered.select("__row", text), x, text).select("__row", "__found") for x in chain([first, second], slices)]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    united = union.groupBy("__row").agg(
        F.struct(
            F.max("__found.n_words").alias("n_words"),
            F.flatten(F.collect_list("__found.hits")).alias("hits"),
            F.flatten(F.collect_list("__found.items")).alias("items"),
        ).alias("__found")
    )
    return _finished(numbered.join(united, "__row").drop("__row"))


_FOUND = "__found struct<n_words: bigint, hits: array<struct<start: int, end: int>>, items: array<string>>"


def _searched(docs: DataFrame, tables: tuple[list[Patterns], list], text: str) -> DataFrame:
    """Documents with the intervals of words inside occurrences (disjoint, in order) and the items found."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tables)
    place = docs.columns.index(text)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, names = shared.value
        for batch in batches:
            counts, hits, items = [], [], []
            for first, end, raw, offsets in chunks(batch.column(place)):
                codes, bounds = word_codes(raw, offsets, ALNUM)
                counts.extend(np.diff(bounds).tolist())
                mine: list[list] = [[] for _ in range(end - first)]
                held: list[set] = [set() for _ in range(end - first)]
                for p in patterns:
                    at, who = p.find(codes, bounds)
                    row = np.searchsorted(bounds, at, "right") - 1
                    pairs = np.unique(np.stack([row, p.items[who]], 1), axis=0) if len(at) else np.zeros((0, 2), int)
                    for r, i in pairs.tolist():
                        held[r].add(i)
                    for r, e in np.unique(np.stack([row, at - bounds[row] + 1], 1), axis=0).tolist() if len(at) else []:
                        mine[r].append((e - p.length, e))
                hits.extend(_merged(x) for x in mine)
                items.extend(sorted(names[i] for i in x if names[i] is not None) for x in held)
            cells = [{"n_words": n, "hits": [{"start": a, "end": b} for a, b in h], "items": i} for n, h, i in zip(counts, hits, items, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, _ARROW)], names=[*batch.schema.names, "__found"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), _FOUND])
    return docs.mapInArrow(found, schema)


_ARROW = pa.struct(
    [("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))]
)


def _merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _finished(df: DataFrame) -> DataFrame:
    """Hits of all passes united: sorted by start, each word counted once."""
    reach = F.aggregate(
        F.array_sort("__found.hits"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda s, h: F.struct(
            (s["n"] + F.greatest(F.lit(0), h["end"] - F.greatest(h["start"], s["to"]))).cast("long").alias("n"),
            F.greatest(s["to"], h["end"]).alias("to"),
        ),
    )
    return df.withColumn(
        "__hits",
        F.struct(
            F.col("__found.n_words").alias("n_words"),
            reach["n"].alias("n_hit"),
            F.array_sort(F.array_distinct("__found.items")).alias("items"),
        ),
    ).drop("__found")


def decontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, **how) -> DataFrame:
    """The documents without any occurrence of a benchmark window, with their own columns."""
    return search(docs, benchmark, size, **how).where(F.col("__hits.n_hit") == 0).drop("__hits")
