"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SECRET = re.compile(
    r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)


def remainder(doc_id, modulus: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def base_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in SECRET.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def listed(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def statistics(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(runs)
    covered = {i + j for i, r in enumerate(runs) if many[r] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def shingle_set(text: str | None, size: int) -> frozenset:
    words = WORD.findall((text or "").translate(FOLD))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def component_of(sets: dict, percent: int) -> dict:
    """Least key of each key's component, by comparing all pairs that share a shingle."""
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            holders[g].append(k)
    for a, b in {tuple(sorted(p)) for h in holders.values() for p in combinations(h, 2)}:
        x, y = sets[a], sets[b]
        if 100 * len(x & y) >= percent * len(x | y):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in sets}


def decontamination(text: str | None, windows: dict[tuple, set]) -> tuple[int, int, list[str]]:
    words = PLAIN.findall((text or "").translate(FOLD))
    hit, items = set(), set()
    for m in {len(w) for w in windows}:
        for i in range(len(words) - m + 1):
            if found := windows.get(tuple(words[i : i + m])):
                hit |= set(range(i, i + m))
                items |= found
    return len(words), len(hit), sorted(items)


def windows_of(items, size: int = 10) -> dict[tuple, set]:
    out = defaultdict(set)
    for item_id, text in items:
        words = PLAIN.findall((text or "").translate(FOLD))
        for i in range(max(1, len(words) - size + 1) if words else 0):
            out[tuple(words[i : i + size])].add(str(item_id))
    return out


def unigram_scores(docs, trains) -> dict:
    tokens = {i: [*WORD.findall((t or "").translate(FOLD)), None] for i, t in docs}
    counts = Counter(w for i, ws in tokens.items() if trains(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    base = {i: sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws) for i, ws in tokens.items()}
    return {i: (len(ws), sum(counts[w] > 0 for w in ws), n, base[i]) for i, ws in tokens.items()}


def auc(pairs) -> float:
    """Share of (good, bad) pairs in which the good one scores higher."""
    good, bad = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
