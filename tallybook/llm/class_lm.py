"""Language-model scores from a class-based bigram model whose classes come from exchange clustering.

P(w_i | w_{i-1}) = P(class(w_i) | context(w_{i-1})) * P(w_i | class(w_i)). Every word that occurs ``MIN_COUNT`` times is clustered
by itself; all rarer words, and unknown ones, are clustered by their form (one of ``FORMS`` hashes of the last two bytes). The
end of a text has a class of its own.

Clustering. A seed clusters the ``ITEMS`` most frequent words and the forms one by one. Then Spark counts how often each word
follows each context class, one row per word, and rounds of exchange run over these rows: the table of classes, of fixed size,
is broadcast, every word of the part whose turn it is moves to the class that raises the likelihood most, and the table is
summed anew. At first half of the words have their turn; a round after which the likelihood is lower, because many words went
the same way at once, is undone and the part halved. Rounds end when all parts together gain less than ``LEAST_GAIN`` a token.
The contexts are then counted again with the new classes and the exchange goes on from there, ``SWEEPS`` times in all, unless the likelihood is then lower than before.

A context is the class of the word before, for the ``FREQUENT`` most frequent words (a broadcast of bounded size), and the class
of its form for others; it decides only how sharply a word is foretold. Which words are clustered, and how words are foretold,
has no such bound: classes of words are a stored table as long as the vocabulary, joined like the counts. Emissions use the
count of the very word, known or not, with half a count added, so a class shares its mass with one unknown word.

What reaches the driver is bounded: the frequent words, the pairs of seed items and the tables of classes.

Words are known by 64-bit codes. Defined cases: a null text is empty and is scored as one end; without training
documents all counts are 0; rows that repeat are scored alike and each is counted in training; ties go to the lower class;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.frequent import most_frequent
from tallybook.llm.shipping import ship
from tallybook.llm.words import _LOWER, NOT_SPACE, chunks, mixed, span_codes, spans
from tallybook.sources.scratch import stored_once

FREQUENT = 1 << 17
ITEMS = 768
FORMS = 128
CLASSES = 64
PASSES = 8
MIN_COUNT = 5
SWEEPS = 2
#: Rounds of one sweep at most; it ends by the likelihood long before.
ROUNDS = 40
MOST_PARTS = 16
LEAST_GAIN = 1e-2
_U = np.uint64
#: The code of the end of a text.
END = -1
#: The form of the last byte and the one before.
_FORM = np.arange(1 << 16) * 40503 % 65521 % FORMS


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and forms of the words of every row, each row followed by an end, and where the rows begin."""
    low = _LOWER[raw]
    starts, ends, bounds = spans(low, offsets, NOT_SPACE)
    rows = len(offsets) - 1
    last = low[ends - 1].astype(np.int64)
    before = np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    form = _FORM[last * 256 + before]
    at = bounds[1:] + np.arange(rows)
    inner = np.ones(len(starts) + rows, bool)
    inner[at] = False
    codes, forms = np.full(len(inner), END, np.int64), np.full(len(inner), FORMS, np.int64)
    codes[inner], forms[inner] = span_codes(low, starts, ends).view(np.int64), form
    return codes, forms, bounds + np.arange(rows + 1)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with the place where each is first, and the sum of ``n`` for each."""
    back, found = pd.factorize(keys)
    first = np.empty(len(found), np.int64)
    first[back[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return found, first, np.bincount(back, weights=n, minlength=len(found)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for _, _, raw, offsets in chunks(batch.column(0)):
            codes, forms, _ = _tokens(raw, offsets)
            found, first, n = _summed(codes, np.ones(len(codes)))
            parts.append((found, forms[first], n))
        if parts:
            codes, forms, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            found, first, n = _summed(codes, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found), pa.array(forms[first].astype(np.int32)), pa.array(n)], ["word", "form", "n"]
            )


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, form, n): all words of the documents and the end."""
    ship(docs.sparkSession)
    parts = docs.select(F.col(text).cast("string")).mapInArrow(_counted, "word bigint, form int, n bigint")
    return parts.groupBy("word", "form").agg(F.sum("n").alias("n"))


class Places:
    """Where codes stand among sorted words: codes are even over all 64 bits, so their first bits tell the place but for a few words."""

    BITS = 20

    def __init__(self, words: np.ndarray):
        self.words = words

    @cached_property
    def begin(self) -> np.ndarray:
        half = 1 << (self.BITS - 1)
        return np.searchsorted(self.words >> (64 - self.BITS), np.arange(-half, half + 1)).astype(np.int32)

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of every code, and whether it is one of the words; other codes have any place."""
        if not len(self.words):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        slot = (codes >> (64 - self.BITS)) + (1 << (self.BITS - 1))
        at = np.minimum(self.begin[slot], len(self.words) - 1).astype(np.int64)
        known = self.words[at] == codes
        rest = np.flatnonzero(~known)
        while len(rest):
            rest = rest[at[rest] + 1 < self.begin[slot[rest] + 1]]
            at[rest] += 1
            known[rest] = self.words[at[rest]] == codes[rest]
            rest = rest[~known[rest]]
        return at, known


class Items:
    """The item of every word: looked up for frequent words, its form for the others."""

    def __init__(self, words: np.ndarray, n: np.ndarray):
        order = np.argsort(words)
        self.words, self.n = words[order], n[order]
        rank = np.lexsort((self.words, -self.n))
        rank = rank[self.words[rank] != END][:ITEMS]
        self.item = np.full(len(words), -1, np.int64)
        self.item[rank] = 1 + np.arange(len(rank))
        self.named = self.words[rank]
        self.places = Places(self.words)

    def of(self, codes: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item and count of every token; the count is -1 where the word is not a frequent one."""
        item = np.where(codes == END, 0, 1 + ITEMS + forms)
        n = np.full(len(codes), -1, np.int64)
        at, known = self.places.of(codes)
        if len(self.words):
            n = np.where(known, self.n[at], n)
            own = self.item[at]
            item = np.where(known & (own > 0), own, item)
        return item, n


SIZE = 1 + ITEMS + FORMS


def _before(item: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The item before each token; a text begins after an end."""
    before = np.zeros(len(item), np.int64)
    before[1:] = item[:-1]
    before[bounds[:-1]] = 0
    return before


def item_pairs(docs: DataFrame, items: Items, text: str = "text") -> np.ndarray:
    """How often each item follows each other one: a matrix of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE * SIZE, np.int64)
        for batch in batches:
            for _, _, raw, offsets in chunks(batch.column(0)):
                codes, forms, bounds = _tokens(raw, offsets)
                item, _ = shared.value.of(codes, forms)
                total += np.bincount(_before(item, bounds) * SIZE + item, minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["pair", "n"])

    pairs = docs.select(F.col(text).cast("string")).mapInArrow(paired, "pair bigint, n bigint")
    rows = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(SIZE * SIZE)
    matrix[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return matrix.reshape(SIZE, SIZE)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """The class of every item; the end keeps class 0 for itself."""
    weight = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-weight, kind="stable")
    order = order[(order != 0) & (weight[order] > 0)]
    own = np.ones(len(pairs), np.int64)
    own[0] = 0
    own[order] = 1 + np.arange(len(order)) % (classes - 1)
    member = np.eye(classes)[own]
    table = member.T @ pairs @ member
    for _ in range(passes):
        moved = 0
        for w in order.tolist():
            a = own[w]
            right = np.bincount(own, pairs[w], classes)
            left = np.bincount(own, pairs[:, w], classes)
            self_ = pairs[w, w]
            table[a] -= right
            table[:, a] -= left
            table[a, a] += self_
            right[a] -= self_
            left[a] -= self_
            now = _xlogx(table)
            down, across = _xlogx(table + right[None, :]) - now, _xlogx(table + left[:, None]) - now
            corner = _xlogx(table.diagonal() + right + left + self_) - now.diagonal()
            rows, cols = table.sum(1), table.sum(0)
            gain = down.sum(1) - down.diagonal() + across.sum(0) - across.diagonal() + corner
            gain -= _xlogx(rows + right.sum() + self_) - _xlogx(rows) + _xlogx(cols + left.sum() + self_) - _xlogx(cols)
            gain[0] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[a] + 1e-9:
                best = a
            moved += best != a
            own[w] = best
            table[best] += right
            table[:, best] += left
            table[best, best] += self_
        if not moved:
            break
    return own


class Classes:
    """The classes of all words as tasks see them: those of frequent words, with their counts, and those of the forms."""

    def __init__(self, words: np.ndarray, n: np.ndarray, own: np.ndarray, forms: np.ndarray):
        order = np.argsort(words)
        self.words, self.n, self.own, self.forms = words[order], n[order], own[order], forms
        self.places = Places(self.words)

    def at(self, at: np.ndarray, known: np.ndarray, forms: np.ndarray) -> np.ndarray:
        """The class of every token, by its place among the frequent words."""
        return np.where(known, self.own[at], self.forms[forms]) if len(self.words) else self.forms[forms]

    def of(self, codes: np.ndarray, forms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and count of every token; the count is -1 where the word is not a frequent one."""
        at, known = self.places.of(codes)
        n = np.where(known, self.n[at], -1) if len(self.words) else np.full(len(codes), -1, np.int64)
        return self.at(at, known, forms), n


#: Rows of a batch for Spark, and tokens that a task counts before it hands the counts on.
ROWS, MOST_HELD = 1 << 18, 1 << 30


def _starts(*sorted_: np.ndarray) -> np.ndarray:
    """Where runs of equal rows of sorted columns begin."""
    if not len(sorted_[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(sorted_[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_])
    return np.flatnonzero(new)


def _runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted column, and how often each is there."""
    first = _starts(sorted_)
    return sorted_[first], np.diff(np.append(first, len(sorted_)))


_UNIT = "word bigint, form int, n bigint, words bigint, own int, moved int, contexts binary, counts binary"


def context_counts(docs: DataFrame, classes: Classes, text: str = "text") -> DataFrame:
    """(word, form, n, contexts, counts): how often each word follows each context class; at most one entry per class, as bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)

    def rows(codes: np.ndarray, place: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One row per word: codes come one after another, and all places of a word have its form."""
        first = _starts(codes)
        edges = np.append(first, len(codes))
        for low in range(0, len(first), ROWS):
            at = first[low : low + ROWS]
            cut = slice(at[0], edges[min(low + ROWS, len(first))])
            columns = [pa.array(codes[at]), pa.array((place[at] // CLASSES).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*columns, *_packed(at - at[0], place[cut] % CLASSES, n[cut])], ["word", "form", "contexts", "counts"])

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        # Frequent words are counted over the whole task, others in each chunk.
        total, shape, held = np.zeros(len(classes.words) * CLASSES, np.int32), np.zeros(len(classes.words), np.int16), 0

        def frequent() -> Iterator[pa.RecordBatch]:
            found = np.flatnonzero(total)
            at = found // CLASSES
            yield from rows(classes.words[at], shape[at] * np.int64(CLASSES) + found % CLASSES, total[found].astype(np.int64))

        for batch in batches:
            for _, _, raw, offsets in chunks(batch.column(0)):
                codes, forms, bounds = _tokens(raw, offsets)
                if not len(codes):
                    continue
                if held + len(codes) > MOST_HELD:
                    yield from frequent()
                    total[:], held = 0, 0
                held += len(codes)
                at, known = classes.places.of(codes)
                context = _before(classes.at(at, known, forms), bounds)
                shape[at[known]] = forms[known]
                found, n = _runs(np.sort((at[known] * CLASSES + context[known]).astype(np.int32)))
                total[found] += n.astype(np.int32)
                codes, place = codes[~known], forms[~known] * CLASSES + context[~known]
                order = np.lexsort((place, codes))
                codes, place = codes[order], place[order]
                first = _starts(codes, place)
                yield from rows(codes[first], place[first], np.diff(np.append(first, len(codes))))
        yield from frequent()

    pairs = docs.select(F.col(text).cast("string")).mapInArrow(paired, "word bigint, form int, contexts binary, counts binary")
    dealt = pairs.repartition("word").sortWithinPartitions("word")
    return dealt.mapInArrow(_merged, "word bigint, form int, n bigint, contexts binary, counts binary")


def _packed(first: np.ndarray, context: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """Contexts and counts of units as bytes: one and eight for each entry. ``first`` has where units begin."""
    edges = np.append(first, len(context)).astype(np.int32)
    buffers = [(edges, context.astype(np.uint8)), (8 * edges, n.astype("<i8"))]
    return [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(e), pa.py_buffer(x)]) for e, x in buffers]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per word from its rows, each with contexts of its own, which come one after another; the last word waits for the next batch."""

    def summed(word: np.ndarray, place: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((place, word))
        word, place, n = word[order], place[order], n[order]
        first = _starts(word, place)
        word, place, n = word[first], place[first], np.add.reduceat(n, first)
        first = _starts(word)
        columns = [pa.array(word[first]), pa.array((place[first] // CLASSES).astype(np.int32)), pa.array(np.add.reduceat(n, first))]
        return pa.RecordBatch.from_arrays([*columns, *_packed(first, place % CLASSES, n)], ["word", "form", "n", "contexts", "counts"])

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, context, n = _cells(batch)
        word, form = (np.repeat(batch.column(c).to_numpy(), np.diff(offsets)) for c in ("word", "form"))
        columns = (word, form * np.int64(CLASSES) + context, n)
        last = int(np.searchsorted(columns[0], columns[0][-1]))
        if held and (last or held[0][0][0] != columns[0][0]):
            yield summed(*(np.concatenate(x) for x in zip(*held, tuple(c[:last] for c in columns), strict=True)))
            held = []
        elif last:
            yield summed(*(c[:last] for c in columns))
        held.append(tuple(c[last:] for c in columns))
    if held:
        yield summed(*(np.concatenate(x) for x in zip(*held, strict=True)))


def units(counted: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """What is clustered: words of ``min_count`` (form -1) and, as one for each form, the rarer words (word 0)."""
    own = (F.col("n") >= min_count) | (F.col("word") == END)
    one = F.lit(1).cast("long").alias("words")
    words = counted.where(own).select("word", F.lit(-1).alias("form"), "n", one, "contexts", "counts")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last column has the number of words.
        total = np.zeros((FORMS + 1, CLASSES + 1), np.int64)
        for batch in batches:
            form = batch.column("form").to_numpy()
            offsets, context, n = _cells(batch)
            np.add.at(total, (np.repeat(form, np.diff(offsets)), context), n)
            total[:, CLASSES] += np.bincount(form, minlength=FORMS + 1)
        form, context = np.nonzero(total)
        columns = [pa.array(form.astype(np.int32)), pa.array(context.astype(np.int32)), pa.array(total[form, context])]
        yield pa.RecordBatch.from_arrays(columns, ["form", "context", "n"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            form, cells = batch.column(0).to_numpy(), [sorted((c["context"], c["n"]) for c in x) for x in batch.column(1).to_pylist()]
            entries = [c[:-1] for c in cells]
            sizes = np.array([len(x) for x in entries])
            context, n = (np.array([c[i] for x in entries for c in x], np.int64) for i in range(2))
            sums = [pa.array([sum(c[1] for c in x) for x in entries], pa.int64()), pa.array([x[-1][1] for x in cells], pa.int64())]
            columns = [pa.array(np.zeros(len(form), np.int64)), pa.array(form), *sums, *_packed(np.cumsum(sizes) - sizes, context, n)]
            yield pa.RecordBatch.from_arrays(columns, ["word", "form", "n", "words", "contexts", "counts"])

    cells = counted.where(~own).select("form", "contexts", "counts").mapInArrow(summed, "form int, context int, n bigint")
    entry = F.collect_list(F.struct("context", "n")).alias("cells")
    forms = cells.groupBy("form", "context").agg(F.sum("n").alias("n")).groupBy("form").agg(entry)
    return words.unionByName(forms.mapInArrow(packed, "word bigint, form int, n bigint, words bigint, contexts binary, counts binary"))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of a binary column begin and end, and their bytes."""
    _, edges, data = column.buffers()
    offsets = np.frombuffer(edges, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], whole[offsets[0] : offsets[-1]]


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the contexts of each unit begin and end, the contexts, and their counts."""
    if not batch.num_rows:
        return np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets, context = _bytes(batch.column("contexts"))
    return offsets, context.astype(np.int64), _bytes(batch.column("counts"))[1].view("<i8")


def class_table(found: DataFrame) -> tuple[np.ndarray, int]:
    """How often each class follows each context, and how many units the last round moved."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES + 1)
        for batch in batches:
            offsets, context, n = _cells(batch)
            own = np.repeat(batch.column("own").to_numpy().astype(np.int64), np.diff(offsets))
            total[:-1] += np.bincount(context * CLASSES + own, weights=n, minlength=CLASSES * CLASSES)
            total[-1] += batch.column("moved").to_numpy().sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64))], ["cell", "n"])

    cells = found.select("own", "moved", "contexts", "counts").mapInArrow(summed, "cell bigint, n bigint")
    rows = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(CLASSES * CLASSES + 1)
    total[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return total[:-1].reshape(CLASSES, CLASSES), int(total[-1])


def likelihood(table: np.ndarray) -> float:
    """The part of the log likelihood of the training tokens that depends on the classes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def best_classes(own: np.ndarray, n: np.ndarray, offsets: np.ndarray, context: np.ndarray, held: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The class of each unit that raises the likelihood most if it alone moves there; class 0 stays apart."""
    size, now = table.sum(0), _xlogx(table)
    out = own.copy()
    for low in range(0, len(own), 1000):
        high = min(low + 1000, len(own))
        cut = slice(offsets[low], offsets[high])
        c, v, starts = context[cut], held[cut].astype(float), offsets[low:high] - offsets[low]
        at, mine, own_n = np.arange(high - low), own[low:high], n[low:high].astype(float)
        here = np.repeat(mine, np.diff(offsets[low : high + 1]))
        gain = np.add.reduceat(_xlogx(table[c] + v[:, None]) - now[c], starts) - (_xlogx(size + own_n[:, None]) - _xlogx(size))
        stay = np.add.reduceat(now[c, here] - _xlogx(table[c, here] - v), starts) - (_xlogx(size[mine]) - _xlogx(size[mine] - own_n))
        gain[:, 0] = -np.inf
        gain[at, mine] = stay
        best = gain.argmax(1)
        out[low:high] = np.where(gain[at, best] > stay + 1e-6, best, mine)
    return out


def exchanged(found: DataFrame, table: np.ndarray, turn: int, parts: int) -> DataFrame:
    """The units after one round, in which one of so many parts may move."""
    shared = found.sparkSession.sparkContext.broadcast(table)

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, form = batch.column("word").to_numpy(), batch.column("form").to_numpy()
            own = batch.column("own").to_numpy().astype(np.int64)
            part = (mixed(word.view(_U) + form.astype(np.int64).view(_U)) % _U(parts)).astype(np.int64)
            offsets, context, n = _cells(batch)
            now, mine = own.copy(), (part == turn % parts) & (word != END)
            if mine.any():
                sizes, entries = np.diff(offsets), np.repeat(mine, np.diff(offsets))
                starts = np.append(0, np.cumsum(sizes[mine]))
                now[mine] = best_classes(own[mine], batch.column("n").to_numpy()[mine], starts, context[entries], n[entries], shared.value)
            columns = {"own": pa.array(now.astype(np.int32)), "moved": pa.array((now != own).astype(np.int32))}
            yield pa.RecordBatch.from_arrays([columns.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    return found.mapInArrow(moved, _UNIT)


def settled(found: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The units with their classes after rounds of exchange, and the table of classes."""
    found = stored_once(found, "lm-units")
    table, _ = class_table(found)
    value, tokens, parts, gains = likelihood(table), max(table.sum(), 1.0), 2, []
    for turn in range(ROUNDS):
        after = stored_once(exchanged(found, table, turn, parts), "lm-units")
        new, count = class_table(after)
        gain = likelihood(new) - value
        if gain < 0:
            parts, gains = 2 * parts, []
        else:
            found, table, value = after, new, value + gain
            gains = [*gains, gain if count else 0.0][-parts:]
        if parts > MOST_PARTS or (len(gains) == parts and sum(gains) < LEAST_GAIN * tokens):
            break
    return found, table


@dataclass
class Model:
    """Counts of words, classes of units, the classes as contexts and as broadcast classes, and the table between them."""

    counts: DataFrame
    units: DataFrame
    contexts: Classes
    classes: Classes
    table: np.ndarray
    step: np.ndarray
    tokens: int
    distinct: int


def _classes(found: DataFrame, top: pa.Table) -> Classes:
    """Classes of the frequent words and of the forms, taken from the units; a form without rare words has class 1."""
    forms = np.ones(FORMS + 1, np.int64)
    forms[FORMS] = 0
    for row in found.where(F.col("form") >= 0).select("form", "own").collect():
        forms[row["form"]] = row["own"]
    words, n, form = (top[c].to_numpy() for c in ("word", "n", "form"))
    own = forms[form]
    least = int(n.min()) if len(n) else 0
    named = found.where((F.col("form") < 0) & (F.col("n") >= least)).select("word", "own").toArrow() if len(n) else top.slice(0, 0)
    if len(named):
        order = np.argsort(words)
        own[order[np.searchsorted(words, named["word"].to_numpy(), sorter=order)]] = named["own"].to_numpy()
    return Classes(words, n, own, forms)


def fitted(training: DataFrame, text: str = "text", min_count: int = MIN_COUNT) -> Model:
    """The model of all training documents."""
    counts = stored_once(word_counts(training, text), "lm-counts")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts, "n", FREQUENT)
    items = Items(top["word"].to_numpy(), top["n"].to_numpy())
    seed = exchange(item_pairs(training, items, text))
    forms = np.append(seed[1 + ITEMS :], 0)
    item, _ = items.of(items.words, np.zeros(len(items.words), np.int64))
    own = seed[item]
    loose = (items.item < 0) & (items.words != END)
    order = np.argsort(top["word"].to_numpy())
    own[loose] = forms[top["form"].to_numpy()[order][loose]]
    contexts = Classes(items.words, items.n, own, forms)

    first = training.sparkSession.sparkContext.broadcast(contexts)

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, _ = first.value.of(batch.column("word").to_numpy(), batch.column("shape").to_numpy().astype(np.int64))
            rest = {"own": pa.array(own.astype(np.int32)), "moved": pa.array(np.zeros(len(own), np.int32))}
            names = ["word", "form", "n", "words", "own", "moved", "contexts", "counts"]
            yield pa.RecordBatch.from_arrays([rest[c] if c in rest else batch.column(c) for c in names], names)

    found, table = None, None
    for _ in range(SWEEPS):
        counted = stored_once(context_counts(training, contexts, text), "lm-contexts")
        fresh = units(counted, min_count)
        if found is None:
            shapes = counts.select("word", F.col("form").alias("shape"))
            fresh = fresh.join(shapes, "word", "left").withColumn("shape", F.coalesce("shape", F.greatest("form", F.lit(0))))
            fresh = fresh.mapInArrow(begun, _UNIT)
        else:
            fresh = fresh.join(found.select("word", "form", "own"), ["word", "form"]).withColumn("moved", F.lit(0))
            fresh = fresh.select("word", "form", "n", "words", "own", "moved", "contexts", "counts")
        after, new = settled(fresh)
        if found is not None and likelihood(new) < likelihood(table):
            break
        found, table, classes, used = after, new, _classes(after, top), contexts
        contexts = classes

    kinds = np.zeros(CLASSES)
    for row in found.groupBy("own").agg(F.sum("words").alias("words")).collect():
        kinds[row["own"]] = row["words"]
    smooth = table + 0.5
    mass = table.sum(0) + 0.5 * (kinds + 1)
    step = np.log10(smooth / smooth.sum(1, keepdims=True)) - np.log10(mass)[None, :]
    return Model(counts, found, used, classes, table, step, int(totals[0]), int(totals[1]))


_RARE = pa.list_(pa.struct([("w", pa.int64()), ("p", pa.int32()), ("n", pa.int32())]))


def _rare(codes: np.ndarray, place: np.ndarray, rare: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """How many distinct (word, place) of rare words each row has, then these with their counts."""
    rows = len(bounds) - 1
    row = np.repeat(np.arange(rows), np.diff(bounds))[rare]
    codes, place = codes[rare], place[rare]
    order = np.lexsort((place, codes, row))
    row, codes, place = row[order], codes[order], place[order]
    new = (row[1:] != row[:-1]) | (codes[1:] != codes[:-1]) | (place[1:] != place[:-1])
    first = np.flatnonzero(np.append(True, new)) if len(row) else np.zeros(0, np.int64)
    return np.bincount(row[first], minlength=rows), codes[first], place[first], np.diff(np.append(first, len(row)))


def scored(docs: DataFrame, training: DataFrame, text: str = "text") -> DataFrame:
    """The documents with n_tokens, n_known, train_tokens, base_score and score instead of their text."""
    spark = docs.sparkSession
    ship(spark)
    model = fitted(training, text)
    tokens, distinct = model.tokens, model.distinct
    shared = spark.sparkContext.broadcast((model.contexts, model.classes, model.step))

    others = [c for c in docs.columns if c not in (text, "n_tokens", "n_known", "train_tokens", "base_score", "score")]
    cut = docs.select(*[f"`{c}`" for c in others], F.col(text).cast("string").alias("__text"))
    extra = [("__tokens", pa.int64()), ("__known", pa.int64()), ("__logs", pa.float64()), ("__steps", pa.float64()), ("__rare", _RARE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, classes, step = shared.value
        logs = np.log10(classes.n + 0.5)
        for batch in batches:
            out: list[list] = [[] for _ in extra]
            for _, _, raw, offsets in chunks(batch.column(batch.num_columns - 1)):
                codes, forms, bounds = _tokens(raw, offsets)
                # Both have the same words.
                at, known = classes.places.of(codes)
                context, own = _before(contexts.at(at, known, forms), bounds), classes.at(at, known, forms)
                log = np.where(known, logs[at], 0.0) if len(logs) else np.zeros(len(codes))
                per = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: B023, E731  every row has its end
                out[0].append(np.diff(bounds))
                out[1].append(per(known.astype(np.int64)))
                out[2].append(per(log))
                out[3].append(per(np.where(known, step[context, own], 0.0)))
                out[4].append(_rare(codes, forms * CLASSES + context, ~known, bounds))
            columns = [pa.array(np.concatenate(x) if x else np.zeros(0), t) for x, (_, t) in zip(out[:4], extra, strict=False)]
            joined = [np.concatenate([x[i] for x in out[4]]) if out[4] else np.zeros(0, np.int64) for i in range(4)]
            lengths = joined[0]
            cells = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(joined[1:], _RARE.value_type, strict=True)], ["w", "p", "n"])
            rare = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)).astype(np.int32)), cells)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns, rare], names=[*batch.schema.names[:-1], *[x for x, _ in extra]])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields[:-1]]
    schema = ", ".join([*fields, "__tokens bigint, __known bigint, __logs double, __steps double, __rare array<struct<w: bigint, p: int, n: int>>"])
    local = stored_once(cut.mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id()), "lm-local")
    rare = local.select("__row", F.explode("__rare").alias("r")).select(
        "__row", F.col("r.w").alias("word"), F.floor(F.col("r.p") / CLASSES).cast("int").alias("form"), (F.col("r.p") % CLASSES).alias("context"),
        F.col("r.n").alias("k"),
    )
    own = model.units.where(F.col("form") < 0).select("word", "own")
    known = rare.join(model.counts.select("word", "n").join(own, "word", "left"), "word", "left")
    by_form = F.array(*[F.lit(int(c)) for c in model.classes.forms])
    cells = [(g, c, float(model.step[g, c])) for g in range(CLASSES) for c in range(CLASSES)]
    steps = spark.createDataFrame(pa.table({k: [x[i] for x in cells] for i, k in enumerate(("context", "own", "step"))}))
    steps = steps.select(F.col("context").cast("int"), F.col("own").cast("int"), "step")
    known = known.withColumn("own", F.coalesce("own", F.get(by_form, F.col("form")))).join(steps, ["context", "own"])
    log = lambda n: F.log10(F.coalesce(n, F.lit(0)).cast("double") + 0.5)
    sums = known.groupBy("__row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("__more"),
        F.sum(F.col("k") * log(F.col("n"))).alias("__rest"),
        F.sum(F.col("k") * F.col("step")).alias("__path"),
    )
    logs: Column = F.col("__logs") + F.coalesce("__rest", F.lit(0.0))
    return local.join(sums, "__row", "left").select(
        *[f"`{c}`" for c in others],
        F.col("__tokens").alias("n_tokens"),
        (F.col("__known") + F.coalesce("__more", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (logs - F.col("__tokens") * float(np.log10(tokens + 0.5 * (distinct + 1)))).alias("base_score"),
        (logs + F.col("__steps") + F.coalesce("__path", F.lit(0.0))).alias("score"),
    )
