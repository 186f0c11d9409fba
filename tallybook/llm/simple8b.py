"""Simple-8b word-aligned coding: a 64-bit word holds a selector of 4 bits and as many numbers as fit the other 60.

A stream is cut into blocks of ``BLOCK`` numbers that are coded apart; a table has the first word and the first escape of every
block, so any block can be decoded alone and all of them at once. A number of more than 60 bits is an escape: its word has
the selector ``ESCAPE`` and the number stands whole in the escape list. The last word of a block may reach past the block's end; what it holds
there is zero and is cut off.

Stream, in little-endian 64-bit words: count of numbers, blocks, words and escapes; first word of each block; first escape of
each block; words; escapes.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
BLOCK = 1024
#: Numbers a word holds and bits of each, by selector; selector 1 is taken for escapes.
COUNTS = np.array([240, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 1


def _selectors(bits: np.ndarray) -> np.ndarray:
    """At each place the selector that holds the most numbers from there on, by the largest width among so many numbers."""
    best = np.full(bits.shape, ESCAPE, np.uint8)
    widest, count = bits, 1
    for selector in np.argsort(COUNTS, kind="stable")[1:] if len(bits) else ():
        while count < COUNTS[selector]:
            step = min(count, int(COUNTS[selector]) - count)
            widest = np.append(np.maximum(widest[:-step], widest[step:]), np.full(step, 64, np.uint8))
            count += step
        best[widest <= BITS[selector]] = selector
    return best


def encode(values: np.ndarray) -> bytes:
    """The stream of unsigned numbers of at most 64 bits."""
    values = np.ascontiguousarray(values, dtype=_U)
    blocks = -(-len(values) // BLOCK)
    wide = np.zeros((blocks, BLOCK + int(COUNTS[0])), _U)
    for_all = np.zeros(blocks * BLOCK, _U)
    for_all[: len(values)] = values
    wide[:, :BLOCK] = for_all.reshape(blocks, BLOCK)
    # Beyond 53 bits a width may come out one too large, which only makes an escape.
    selectors = _selectors(np.frexp(wide.ravel().astype(np.float64))[1].astype(np.uint8))
    ends = np.minimum(len(values) - np.arange(blocks) * BLOCK, BLOCK)
    # All blocks go on by one word at a time.
    at, live, found = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        found.append(live * wide.shape[1] + at[live])
        at[live] += COUNTS[selectors[found[-1]]]
        live = live[at[live] < ends[live]]
    place = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    chosen, flat = selectors[place], wide.ravel()
    words = chosen.astype(_U) << _U(60)
    for selector in np.unique(chosen):
        if selector != ESCAPE:
            of = np.flatnonzero(chosen == selector)
            for i in range(COUNTS[selector] if BITS[selector] else 0):
                words[of] |= flat[place[of] + i] << _U(int(BITS[selector]) * i)
    block, escaped = place // wide.shape[1], chosen == ESCAPE
    every = np.arange(blocks)
    head = [len(values), blocks, len(words), int(escaped.sum())]
    firsts = [np.searchsorted(block, every), np.searchsorted(block[escaped], every)]
    return b"".join(np.asarray(x).astype("<u8").tobytes() for x in (head, *firsts, words, flat[place[escaped]]))


def decode(cells: np.ndarray, first: int = 0, last: int | None = None) -> tuple[np.ndarray, int]:
    """The numbers of the blocks ``first`` to ``last`` (all without it) of the stream at the start of ``cells``, and the stream's length in words."""
    n, blocks, n_words, n_escapes = (int(x) for x in cells[:4])
    length = 4 + 2 * blocks + n_words + n_escapes
    last = blocks if last is None else min(last, blocks)
    starts = np.append(cells[4 : 4 + blocks], n_words).astype(np.int64)
    escapes = np.append(cells[4 + blocks : 4 + 2 * blocks], n_escapes).astype(np.int64)
    body = cells[4 + 2 * blocks : length]
    words, raw = body[starts[first] : starts[last]], body[n_words + escapes[first] : n_words + escapes[last]]
    selector = (words >> _U(60)).astype(np.int64)
    counts, at = COUNTS[selector], starts[first : last + 1] - starts[first]
    running = np.append(0, np.cumsum(counts))
    # Where each word's numbers go: on from the start of its block.
    block = np.repeat(np.arange(last - first), np.diff(at))
    place = running[:-1] - running[at[:-1]][block] + block * BLOCK
    size = max(min(n, last * BLOCK) - first * BLOCK, 0)
    ends = np.minimum((block + 1) * BLOCK, size)
    out = np.zeros(size + int(COUNTS[0]), _U)
    for s in np.unique(selector):
        of = np.flatnonzero(selector == s)
        if s == ESCAPE:
            out[place[of]] = raw
        elif BITS[s]:
            mask = (_U(1) << _U(int(BITS[s]))) - _U(1)
            for i in range(COUNTS[s]):
                inside = of[place[of] + i < ends[of]]
                out[place[inside] + i] = (words[inside] >> _U(int(BITS[s]) * i)) & mask
    return out[:size], length
