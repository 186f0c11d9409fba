"""Phrases whose words occur together more often than their parts explain, mined with weighted acyclic automata.

Three passes over the texts, each over all of them: words, pairs of frequent words, and runs of three to ``longest`` words
whose pairs are all frequent. A phrase can only be frequent if its words and pairs are, so nothing is lost. In a pass every
task turns what it has read into sorted paths (language, words...) and builds count automata of them
(``count_automaton``), one per prefix range: a range of the codes of the first words of a path (two in the pass for pairs,
three in that for runs). The automata of a range meet in one task, which adds them up and prunes what is rare. Their number
follows the number of words of the corpus, so a range holds about ``RANGE_WORDS`` occurrences, and a phrase that fills a third
of the corpus is one path per shard. The parts of the candidates go to the automaton of their own range as an automaton too, and
composing both gives their counts.

What is frequent is handed to the tasks as a Bloom filter of a fixed size (``FILTER_BITS``). What passes it wrongly only makes
work: every count is taken from the sums. Words and phrases are compared by 64-bit codes.

Counts and scores are exact (decimals of up to 38 digits). Defined cases: a null language is ``und``, as is a language of that
name; null or wordless texts give nothing; other columns are ignored, whatever their names; repeated rows count as often as they
are there; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.count_automaton import CountAutomaton, path_codes, summed
from tallybook.llm.shipping import ship
from tallybook.llm.words import _LOWER, _class, chunks, span_codes, spans
from tallybook.sources.scratch import stored_once

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
#: Occurrences that one prefix range holds, about, and those that a task holds before it builds automata.
RANGE_WORDS = 2_000_000
SHARD_PATHS = 1_500_000
FILTER_BITS = 1 << 25
#: Parts into which the rows of a language are dealt before its best are chosen.
DEALS = 32

_U = np.uint64
#: Bytes that end a piece, and those of words.
SPLITS = _class((0x0A, 0x0D), *[(ord(c), ord(c)) for c in ".,;:!?"])
WORDS = ~(SPLITS | _class((0x20, 0x20), (0x09, 0x09)))


class Text:
    """The words of a chunk of texts: codes, the piece of each word, and the code of its language."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        self.raw = _LOWER[raw]
        self.starts, self.ends, first = spans(self.raw, offsets, WORDS)
        self.codes = _positive(span_codes(self.raw, self.starts, self.ends))
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        splits = np.append(0, np.cumsum(SPLITS[self.raw]))
        self.piece = splits[self.starts] + row
        self.row, self.langs = row, langs[row] if len(row) else np.zeros(0, _U)

    def same_piece(self, size: int) -> np.ndarray:
        """Whether the ``size`` words from each one on lie in one piece."""
        n = max(len(self.codes) - size + 1, 0)
        last = slice(size - 1, size - 1 + n)
        return (self.piece[:n] == self.piece[last]) & (self.row[:n] == self.row[last])


def _positive(codes: np.ndarray) -> np.ndarray:
    codes[codes == 0] = 1
    return codes


def _codes_of(values: list[str]) -> np.ndarray:
    parts = [v.encode() for v in values]
    # A mark before each value: an empty one has a code too.
    raw = np.frombuffer(b"".join(b"\x00" + p for p in parts), np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
    return _positive(span_codes(raw, np.append(0, ends[:-1]), ends)) if parts else np.zeros(0, _U)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[Text, list[str], np.ndarray]]:
    """The chunks of a batch of (lang, text), with the languages and the number of the language of each row."""
    coded = batch.column(0).dictionary_encode()
    names = coded.dictionary.to_pylist()
    of_row, codes = coded.indices.to_numpy(), _codes_of(names)
    for first, end, raw, offsets in chunks(batch.column(1)):
        yield Text(raw, offsets, codes[of_row[first:end]]), names, of_row[first:end]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text, names, of_row in _texts(batch):
            paths = np.stack([text.langs, text.codes], axis=1)
            key, at, n = np.unique(path_codes(paths), return_index=True, return_counts=True)
            data = text.raw.tobytes()
            a, b = text.starts[at].tolist(), text.ends[at].tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[i] for i in of_row[text.row[at]].tolist()], pa.string()),
                    pa.array([data[x:y].decode() for x, y in zip(a, b, strict=True)], pa.string()),
                    *[pa.array(x.view(np.int64)) for x in (text.langs[at], text.codes[at], key)],
                    pa.array(n.astype(np.int64)),
                ],
                ["lang", "word", "lang_code", "code", "key", "n"],
            )


def _filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the codes in the column ``key``."""
    bits = keys.select(F.explode(F.array(F.col("key").bitwiseAND(FILTER_BITS - 1), F.shiftrightunsigned("key", 32).bitwiseAND(FILTER_BITS - 1))).alias("bit"))
    flag = F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS INT)))")
    found = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(flag.alias("flags")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[found["word"].to_numpy()] = found["flags"].to_numpy()
    return table.view(_U)


def _passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    ok = np.ones(len(keys), bool)
    for bit in (keys & _U(FILTER_BITS - 1), (keys >> _U(32)) & _U(FILTER_BITS - 1)):
        ok &= (table[(bit >> _U(6)).astype(np.int64)] >> (bit & _U(63))) & _U(1) == 1
    return ok


def _range(paths: np.ndarray, depth: int, ranges: int) -> np.ndarray:
    """The prefix range of each path: the interval that the code of its first ``depth`` codes lies in."""
    return ((path_codes(paths, depth) >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)


def _pairs(text: Text, table: np.ndarray, longest: int) -> np.ndarray:
    near = text.same_piece(2)
    known = _passes(table, path_codes(np.stack([text.langs, text.codes], axis=1)))
    at = np.flatnonzero(near & known[:-1] & known[1:]) if len(near) else np.zeros(0, np.int64)
    return np.stack([text.langs[at], text.codes[at], text.codes[at + 1]], axis=1)


def _runs(text: Text, table: np.ndarray, longest: int) -> np.ndarray:
    near = np.flatnonzero(text.same_piece(2))
    pairs = np.zeros(len(text.codes), bool)
    pairs[near] = _passes(table, path_codes(np.stack([text.langs[near], text.codes[near], text.codes[near + 1]], axis=1)))
    held = np.append(pairs, np.zeros(longest, bool))
    at = np.flatnonzero(pairs & held[1 : len(pairs) + 1])
    paths = np.zeros((len(at), longest + 1), _U)
    paths[:, 0], paths[:, 1] = text.langs[at], text.codes[at]
    going = np.ones(len(at), bool)
    for step in range(longest - 1):
        going &= held[at + step]
        paths[going, step + 2] = text.codes[at[going] + step + 1]
    return paths


def _cut(waiting: list[np.ndarray], whole: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Automata of the gathered paths, one per prefix range."""
    paths = np.concatenate(waiting)
    keys, at, n = np.unique(path_codes(paths), return_index=True, return_counts=True)
    paths, n = paths[at], n.astype(np.int64)
    of = _range(paths, whole, ranges)
    order = np.argsort(of, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(of[order]) > 0)) if len(of) else []
    numbers, blobs = [], []
    for a, b in zip(edges, np.append(edges[1:], len(of)), strict=True):
        numbers.append(int(of[order[a]]))
        blobs.append(CountAutomaton.of(paths[order[a:b]], n[order[a:b]]).to_bytes())
    for first in range(0, len(numbers), 200):
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers[first : first + 200], pa.int64()), pa.array(blobs[first : first + 200], pa.binary())], ["range", "automaton"]
        )


def _counted(docs: DataFrame, kind: int, paths_of, keys: DataFrame, whole: int, ranges: int, longest: int, least: int) -> DataFrame:
    """The summed and pruned automata (kind, range, automaton) of a pass."""
    shared = docs.sparkSession.sparkContext.broadcast(_filter(keys))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, pending = [], 0
        for batch in batches:
            for text, _, _ in _texts(batch):
                waiting.append(paths_of(text, shared.value, longest))
                pending += len(waiting[-1])
                if pending >= SHARD_PATHS:
                    yield from _cut(waiting, whole, ranges)
                    waiting, pending = [], 0
        if pending:
            yield from _cut(waiting, whole, ranges)

    def union(key: tuple, found: pa.Table) -> pa.Table:
        paths, weights, held = [], [], 0
        for blob in found["automaton"]:
            p, w = CountAutomaton.from_bytes(blob.as_buffer()).paths()
            paths.append(p)
            weights.append(w)
            held += len(p)
            if held > 2 * RANGE_WORDS:
                p, w = summed(np.concatenate(paths), np.concatenate(weights))
                paths, weights, held = [p], [w], 0
        every = CountAutomaton.of(np.concatenate(paths), np.concatenate(weights)).pruned(least)
        return pa.table({"kind": pa.array([kind], pa.int32()), "range": pa.array([key[0].as_py()], pa.int64()), "automaton": pa.array([every.to_bytes()], pa.binary())})

    cut = docs.mapInArrow(shards, "range bigint, automaton binary")
    return stored_once(cut.groupBy("range").applyInArrow(union, "kind int, range bigint, automaton binary"), f"phrases-{kind}")


def _word_automata(frequent: DataFrame, ranges: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = _matrix(batch, ("lang_code", "code"))
            yield pa.RecordBatch.from_arrays([pa.array(_range(paths, 2, ranges)), *batch.columns], ["range", *batch.schema.names])

    def build(key: tuple, found: pa.Table) -> pa.Table:
        blob = CountAutomaton.of(_matrix(found, ("lang_code", "code")), found["n"].to_numpy()).to_bytes()
        return pa.table({"kind": pa.array([1], pa.int32()), "range": pa.array([key[0].as_py()], pa.int64()), "automaton": pa.array([blob], pa.binary())})

    dealt = frequent.select("lang_code", "code", "n").mapInArrow(cut, "range bigint, lang_code bigint, code bigint, n bigint")
    return stored_once(dealt.groupBy("range").applyInArrow(build, "kind int, range bigint, automaton binary"), "phrases-1")


def _matrix(table, names: tuple[str, ...]) -> np.ndarray:
    columns = [np.asarray(table.column(x).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table[x].to_numpy()) for x in names]
    return np.stack([c.astype(np.int64).view(_U) for c in columns], axis=1)


def _lists(rows: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The first ``sizes`` codes of every row as a list."""
    inside = np.arange(rows.shape[1]) < sizes[:, None]
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(rows[inside].view(np.int64)))


def _phrase_rows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Frequent phrases of two or more words: language, words, count, own key, those of its ends, and those of both sides of its cuts."""
    for batch in batches:
        for kind, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows, n, _ = CountAutomaton.from_bytes(blob.as_buffer()).sequences(least)
            size = (rows != 0).sum(axis=1) - 1
            good = size == 2 if kind == 2 else size >= 3
            rows, n, size = rows[good], n[good], size[good]
            width = rows.shape[1]
            head, tail = rows.copy(), np.zeros_like(rows)
            head[np.arange(len(rows)), size] = 0
            tail[:, 0], tail[:, 1 : width - 1] = rows[:, 0], rows[:, 2:]
            firsts, rests = np.zeros((2, len(rows), width - 2), _U)
            for k in range(1, width - 1):
                firsts[:, k - 1] = path_codes(rows, k + 1)
                rests[:, k - 1] = path_codes(_rest(rows, k))
            for a in range(0, len(rows), 20_000):
                cut = slice(a, a + 20_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows[cut, 0].view(np.int64)),
                        _lists(rows[cut, 1:], size[cut]),
                        *[pa.array(x[cut]) for x in (n, *[path_codes(p).view(np.int64) for p in (rows, head, tail)])],
                        _lists(firsts[cut], size[cut] - 1),
                        _lists(rests[cut], size[cut] - 1),
                    ],
                    ["lang_code", "words", "a", "key", "head", "tail", "firsts", "rests"],
                )


def _rest(rows: np.ndarray, k: int) -> np.ndarray:
    """Paths without their first ``k`` words."""
    out = np.zeros_like(rows)
    out[:, 0], out[:, 1 : rows.shape[1] - k] = rows[:, 0], rows[:, 1 + k :]
    return out


def _part_rows(batches: Iterator[pa.RecordBatch], longest: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """The parts of phrases, with the kind and range of the automaton that counts them."""
    for batch in batches:
        words = batch.column(1)
        size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.zeros((len(size), longest + 1), _U)
        rows[:, 0] = batch.column(0).to_numpy(zero_copy_only=False).view(_U)
        rows[:, 1:][np.arange(longest) < size[:, None]] = words.flatten().to_numpy(zero_copy_only=False).view(_U)
        parts = []
        for k in range(1, longest):
            whole = rows[size > k]
            first = whole.copy()
            first[:, k + 1 :] = 0
            parts += [first, _rest(whole, k)]
        parts, _ = summed(np.concatenate(parts), np.ones(sum(map(len, parts)), np.int64))
        kind = np.minimum((parts != 0).sum(axis=1) - 1, 3)
        of = np.where(kind == 1, _range(parts, 2, ranges), np.where(kind == 2, _range(parts, 3, ranges), _range(parts, 4, ranges)))
        columns = [pa.array(parts[:, i].view(np.int64)) for i in range(longest + 1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind.astype(np.int32)), pa.array(of), pa.array(path_codes(parts).view(np.int64)), *columns],
            ["kind", "range", "key", *[f"c{i}" for i in range(longest + 1)]],
        )


def _composed(parts: DataFrame, automata: DataFrame, longest: int) -> DataFrame:
    """(key, n) of the parts: in each prefix range the automaton of the wanted parts is composed with that of the counts."""
    names = tuple(f"c{i}" for i in range(longest + 1))

    def look_up(wanted: pa.Table, counts: pa.Table) -> pa.Table:
        rows, n = np.zeros((0, longest + 1), _U), np.zeros(0, np.int64)
        if wanted.num_rows and counts.num_rows:
            automaton = CountAutomaton.from_bytes(counts["automaton"][0].as_buffer())
            asked = _matrix(wanted, names)[:, : automaton.width]
            rows, n = automaton.compose(CountAutomaton.of(asked, np.ones(len(asked), np.int64)))
        return pa.table({"key": pa.array(path_codes(rows).view(np.int64)), "n": pa.array(n)})

    sides = parts.groupBy("kind", "range").cogroup(automata.groupBy("kind", "range"))
    return sides.applyInArrow(look_up, "key bigint, n bigint")


def collocations(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    longest: int = LONGEST,
    min_count: int = MIN_COUNT,
    top: int = TOP,
    range_words: int = RANGE_WORDS,
) -> DataFrame:
    """The ``top`` phrases of two to ``longest`` words per language: lang, rank, phrase, a, l, r, n, score.

    ``a`` is the count of the phrase, ``l`` and ``r`` those of both sides of its worst cut, ``n`` the words of the language, and
    the score ``1000 * a * n / (l * r)`` rounded down. A phrase inside a longer one of the same count is left out.
    """
    ship(docs.sparkSession)
    read = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    found = read.mapInArrow(_word_counts, "lang string, word string, lang_code bigint, code bigint, key bigint, n bigint")
    words = stored_once(found.groupBy("lang", "word", "lang_code", "code", "key").agg(F.sum("n").alias("n")), "phrases-words")
    totals = words.groupBy("lang_code").agg(F.sum("n").alias("n"))
    ranges = 1 + (totals.agg(F.sum("n")).first()[0] or 0) // range_words
    frequent = words.where(F.col("n") >= min_count)

    pairs = _counted(read, 2, _pairs, frequent, 3, ranges, longest, min_count)
    rows_schema = "lang_code bigint, words array<bigint>, a bigint, key bigint, head bigint, tail bigint, firsts array<bigint>, rests array<bigint>"

    def phrases(automata: DataFrame) -> DataFrame:
        return automata.select("kind", "automaton").mapInArrow(lambda b: _phrase_rows(b, min_count), rows_schema)

    automata, every = _word_automata(frequent, ranges).union(pairs), phrases(pairs)
    if longest > 2:
        runs = _counted(read, 3, _runs, every.select("key"), 4, ranges, longest, min_count)
        automata, every = automata.union(runs), every.union(phrases(runs))
    every = stored_once(every, "phrases-found")

    schema = ", ".join(["kind int", "range bigint", "key bigint", *[f"c{i} bigint" for i in range(longest + 1)]])
    parts = every.select("lang_code", "words").mapInArrow(lambda b: _part_rows(b, longest, ranges), schema)
    counts = stored_once(_composed(parts.dropDuplicates(["kind", "range", "key"]), automata, longest), "phrases-parts")

    def side(name: str) -> Column:
        return F.transform(name, lambda key, k: F.struct((k + 1).alias("k"), F.lit(name).alias("side"), key.alias("part")))

    sides = F.concat(side("firsts"), side("rests"))
    cuts = every.join(totals, "lang_code").select("key", "a", F.col("n").alias("total"), F.explode(sides).alias("s")).select("key", "a", "total", "s.*")
    cut = (
        cuts.join(counts.select(F.col("key").alias("part"), "n"), "part")
        .groupBy("key", "k", "a", "total")
        .agg(F.max(F.when(F.col("side") == "firsts", F.col("n"))).alias("l"), F.max(F.when(F.col("side") == "rests", F.col("n"))).alias("r"))
    )
    wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    cut = cut.withColumn("_over", F.lit(1000).cast("decimal(4,0)") * wide("a", 16) * wide("total", 16)).withColumn("_under", wide("l", 16) * wide("r", 16))
    worst = cut.withColumn("score", F.expr("_over div _under")).groupBy("key").agg(F.min(F.struct("score", "k", "l", "r", F.col("total").alias("n"))).alias("s"))

    longer = every.where(F.size("words") > 2)
    covered = longer.select(F.col("head").alias("key"), "a").union(longer.select(F.col("tail").alias("key"), "a"))
    covered = covered.groupBy("key").agg(F.max("a").alias("inside"))
    kept = every.join(covered, "key", "left").where("inside IS NULL OR inside < a").join(worst, "key").select("lang_code", "words", "key", "a", "s.*")
    # Every row of the first ranks is kept with its ties, which the words then tell apart.
    order = [F.col("score").desc(), F.col("a").desc()]
    best = kept.withColumn("deal", F.pmod("key", F.lit(DEALS)))
    for dealt in (["lang_code", "deal"], ["lang_code"]):
        best = best.withColumn("place", F.rank().over(Window.partitionBy(*dealt).orderBy(*order))).where(F.col("place") <= top)
    best = stored_once(best.drop("deal", "place"), "phrases-best")
    spelled = (
        best.select("key", "lang_code", F.posexplode("words").alias("at", "code"))
        .join(frequent.select("lang_code", "code", "lang", "word"), ["lang_code", "code"])
        .groupBy("key", "lang")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    )
    named = best.join(spelled, "key").select("lang", "phrase", "a", "l", "r", "n", "score")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
