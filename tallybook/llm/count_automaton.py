"""Counts of word sequences as a weighted acyclic automaton.

Paths are sequences of 64-bit codes. An arc carries how often the sequence up to it begins a path, so the count of any
sequence is the weight of the last arc on its way. Automata are built from sorted paths, level by level and from the ends
upwards: a state whose arcs (code, weight, next state) are already in the register of its level is shared, so equal endings
are kept once. All steps work on whole arrays.

Two states are taken for one by 128 bits of signature. A path has no code 0 (it marks the end of shorter rows).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from tallybook.llm.words import mixed

_U = np.uint64
_SALTS = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F))


def path_codes(paths: np.ndarray, depth: int | None = None) -> np.ndarray:
    """One code for the first ``depth`` codes of each path, the same whatever zeros follow the path."""
    total = np.full(len(paths), _SALTS[0], _U)
    for column in range(paths.shape[1] if depth is None else min(depth, paths.shape[1])):
        total = np.where(paths[:, column] != 0, mixed(total + paths[:, column]), total)
    return total


def summed(paths: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct paths in order, with the sums of their weights."""
    if not len(paths):
        return paths, weights
    order = np.lexsort(paths.T[::-1])
    paths = paths[order]
    first = np.flatnonzero(np.append(True, (paths[1:] != paths[:-1]).any(axis=1)))
    return paths[first], np.add.reduceat(weights[order], first)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


@dataclass
class Level:
    """The states at one distance from the start: state i has the arcs ``first[i]`` to ``first[i + 1]``, by code."""

    first: np.ndarray
    code: np.ndarray
    weight: np.ndarray
    target: np.ndarray

    def arcs_of(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arcs of the given states, and for each the place of its state."""
        sizes = self.first[states + 1] - self.first[states]
        return _ranges(self.first[states], sizes), np.repeat(np.arange(len(states)), sizes)

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The arc with the code at each state, -1 where there is none: a binary search in all states at once."""
        low, end = self.first[states], self.first[states + 1]
        high = end.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            below = np.zeros(len(states), bool)
            below[open_] = self.code[middle[open_]] < codes[open_]
            low = np.where(open_ & below, middle + 1, low)
            high = np.where(open_ & ~below, middle, high)
        found = low < end
        found[found] = self.code[low[found]] == codes[found]
        return np.where(found, low, -1)


@dataclass
class CountAutomaton:
    width: int
    levels: list[Level]

    @classmethod
    def of(cls, paths: np.ndarray, weights: np.ndarray) -> CountAutomaton:
        """From any paths (rows of codes, shorter ones end in zeros) and their weights."""
        width = paths.shape[1]
        paths, weights = summed(paths, weights)
        total = np.append(0, np.cumsum(weights))
        fresh, nodes, edges = np.zeros(len(paths), bool), [], []
        fresh[:1] = True
        for depth in range(width):
            fresh[1:] |= paths[1:, depth] != paths[:-1, depth]
            nodes.append(np.flatnonzero(fresh & (paths[:, depth] != 0)))
            edges.append(np.append(np.flatnonzero(fresh), len(paths)))
        levels: list[Level] = []
        target, signs = np.zeros(len(nodes[-1]), np.int64), [np.zeros(len(nodes[-1]), _U) for _ in _SALTS]
        for depth in range(width - 1, -1, -1):
            starts = nodes[depth]
            ends = edges[depth][np.searchsorted(edges[depth], starts, "right")] if len(starts) else starts
            weight, code = total[ends] - total[starts], paths[starts, depth]
            if depth:
                parents = nodes[depth - 1]
                owner = np.searchsorted(parents, starts, "right") - 1
                count = len(parents)
            else:
                owner, count = np.zeros(len(starts), np.int64), 1
            sizes = np.bincount(owner, minlength=count)
            sums = []
            for salt, sign in zip(_SALTS, signs, strict=True):
                arc = mixed(mixed(code + salt) + mixed(weight.astype(_U) * salt + sign))
                running = np.append(_U(0), np.cumsum(arc, dtype=_U))
                ends_at = np.cumsum(sizes)
                sums.append(running[ends_at] - running[ends_at - sizes])
            order = np.lexsort(sums)
            new = np.ones(count, bool)
            new[1:] = (sums[0][order][1:] != sums[0][order][:-1]) | (sums[1][order][1:] != sums[1][order][:-1])
            chosen, state = order[new], np.empty(count, np.int64)
            state[order] = np.cumsum(new) - 1
            begin = np.cumsum(sizes) - sizes
            arcs = _ranges(begin[chosen], sizes[chosen])
            first = np.append(0, np.cumsum(sizes[chosen]))
            levels.append(Level(first, code[arcs], weight[arcs], target[arcs]))
            target, signs = state, sums
        return cls(width, levels[::-1])

    @classmethod
    def union(cls, automata: Sequence[CountAutomaton]) -> CountAutomaton:
        """All paths of all, weights of equal paths added."""
        parts = [a.paths() for a in automata]
        return cls.of(np.concatenate([p for p, _ in parts]), np.concatenate([w for _, w in parts]))

    def sequences(self, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All sequences of a count of at least ``least`` that begin a path, their counts, and how often the path ends there."""
        rows, counts, own = [np.zeros((0, self.width), _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        so_far, states = np.zeros((1, self.width), _U), np.zeros(1, np.int64)
        for depth, level in enumerate(self.levels):
            arcs, back = level.arcs_of(states)
            keep = level.weight[arcs] >= least
            arcs, back = arcs[keep], back[keep]
            so_far = so_far[back]
            so_far[:, depth] = level.code[arcs]
            weight, states = level.weight[arcs], level.target[arcs]
            inside = np.zeros(len(arcs), np.int64)
            if depth + 1 < self.width:
                below = self.levels[depth + 1]
                running = np.append(0, np.cumsum(below.weight))
                inside = running[below.first[states + 1]] - running[below.first[states]]
            rows.append(so_far)
            counts.append(weight)
            own.append(weight - inside)
        return np.concatenate(rows), np.concatenate(counts), np.concatenate(own)

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """The paths and their weights."""
        rows, _, own = self.sequences()
        return rows[own > 0], own[own > 0]

    def pruned(self, least: int) -> CountAutomaton:
        """Only the sequences of a count of at least ``least``; their counts stay."""
        rows, counts, _ = self.sequences(least)
        inside = np.zeros(len(rows), np.int64)
        # What a kept sequence counts beyond its kept continuations ends at it.
        depth = (rows != 0).sum(axis=1)
        keys, parents = path_codes(rows), rows.copy()
        parents[np.arange(len(rows)), depth - 1] = 0
        order = np.argsort(keys)
        above = path_codes(parents)
        child = depth > 1
        np.add.at(inside, order[np.searchsorted(keys, above[child], sorter=order)], counts[child])
        return CountAutomaton.of(rows, counts - inside)

    def compose(self, wanted: CountAutomaton) -> tuple[np.ndarray, np.ndarray]:
        """The paths of ``wanted`` that are sequences here, with their counts here: both are followed side by side."""
        rows, counts = [np.zeros((0, self.width), _U)], [np.zeros(0, np.int64)]
        so_far, here, there = np.zeros((1, self.width), _U), np.zeros(1, np.int64), np.zeros(1, np.int64)
        for depth, (mine, other) in enumerate(zip(self.levels, wanted.levels, strict=True)):
            arcs, back = other.arcs_of(there)
            met = mine.step(here[back], other.code[arcs])
            arcs, back, met = arcs[met >= 0], back[met >= 0], met[met >= 0]
            so_far = so_far[back]
            so_far[:, depth] = other.code[arcs]
            here, there = mine.target[met], other.target[arcs]
            ends = other.weight[arcs]
            if depth + 1 < self.width:
                below = wanted.levels[depth + 1]
                running = np.append(0, np.cumsum(below.weight))
                ends = ends - (running[below.first[there + 1]] - running[below.first[there]])
            rows.append(so_far[ends > 0])
            counts.append(mine.weight[met[ends > 0]])
        return np.concatenate(rows), np.concatenate(counts)

    def states(self) -> int:
        return sum(len(level.first) - 1 for level in self.levels)

    def to_bytes(self) -> bytes:
        head = [self.width] + [x for level in self.levels for x in (len(level.first), len(level.code))]
        parts = [np.array(head, np.int64)]
        for level in self.levels:
            parts += [level.first.astype(np.int64), level.code.view(np.int64), level.weight, level.target]
        return b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> CountAutomaton:
        cells = np.frombuffer(data, np.int64)
        width = int(cells[0])
        at, levels = 1 + 2 * width, []
        for depth in range(width):
            states, arcs = int(cells[1 + 2 * depth]), int(cells[2 + 2 * depth])
            cut = [cells[at : at + states]]
            at += states
            for _ in range(3):
                cut.append(cells[at : at + arcs])
                at += arcs
            levels.append(Level(cut[0], cut[1].view(_U), cut[2], cut[3]))
        return cls(width, levels)

