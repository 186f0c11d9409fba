"""Words of a batch of texts as 64-bit codes, computed on the UTF-8 bytes of many texts at once.

Used inside ``mapInArrow`` tasks. A chunk holds whole texts of about two megabytes (a longer text is a chunk of
its own), so memory follows the chunk and the longest text, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000
#: Bytes up to which spans are told apart by sums over all bytes.
SUM_BYTES = 1 << 21

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of a code spread over all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of the words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, after A-Z went to lower case.
ALNUM = _class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_CODE = mixed((np.arange(256, dtype=_U) + _U(1)) * _STEP)
_BASE = 0x5851F42D4C957F2D
_powers = np.ones(1, _U)


def _accumulated(base: int, n: int) -> np.ndarray:
    cells = np.full(n, base, _U)
    cells[0] = 1
    return np.multiply.accumulate(cells)


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = _accumulated(_BASE, max(n, min(2 * n, SUM_BYTES)))
    return _powers


@cache
def _inverse() -> np.ndarray:
    """The powers of the inverse of the odd base modulo 2^64."""
    return _accumulated(pow(_BASE, -1, 1 << 64), SUM_BYTES + 1)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in the bytes) of whole texts; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        end = min(end, len(texts), first + 20_000)
        yield first, end, raw[ends[first] : ends[end]], ends[first : end + 1] - ends[first]
        first = end


def spans(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes, and the first word of each row with the total at the end."""
    inside = kind[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    if len(raw):
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[edge[:-1]] = False
        after[edge[1:]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_codes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit code of each span of bytes. Spans are in order and do not overlap."""
    lengths = ends - starts
    if not len(lengths):
        return np.zeros(0, _U)
    if len(raw) <= SUM_BYTES:
        # A difference of two running sums, brought back to power 0, is the sum below.
        running = np.zeros(len(raw) + 1, _U)
        np.cumsum(_CODE[raw] * _powers_to(len(raw))[: len(raw)], out=running[1:])
        return mixed((running[ends] - running[starts]) * _inverse()[starts] + lengths.astype(_U) * _STEP)
    at = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(at, lengths)
    power = _powers_to(int(lengths.max()) + 1)
    values = _CODE[raw[place + np.repeat(starts, lengths)]] * power[place]
    return mixed(np.add.reduceat(values, at) + lengths.astype(_U) * _STEP)


def word_codes(
    raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE, fold: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all words (A-Z in lower case if ``fold``), and where each row's words begin."""
    if fold:
        raw = _LOWER[raw]
    starts, ends, first = spans(raw, offsets, kind)
    return span_codes(raw, starts, ends), first


def shingles(codes: np.ndarray, size: int) -> np.ndarray:
    """Codes of the runs of ``size`` words; shorter sequences give one code for the whole, none give none."""
    if not len(codes):
        return codes
    size = min(size, len(codes))
    n = len(codes) - size + 1
    total = np.full(n, size, _U) * _STEP
    for i in range(size):
        total = mixed(total + codes[i : i + n])
    return total


def shingle_sets(codes: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The distinct shingles of every row, in order of their codes. Runs are coded for all rows at once."""
    runs = shingles(codes, size) if len(codes) >= size else codes[:0]
    edges = bounds.tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield np.unique(runs[a : b - size + 1]) if b - a >= size else shingles(codes[a:b], size)
