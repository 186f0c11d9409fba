"""Quality classifier: a factorisation machine on hashed words, structure statistics and metadata.

score = sigmoid(b + sum_j w_j x_j + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise part is computed in time linear in the
features of a text, as half of sum_f (sum_j v_jf x_j)^2 - sum_j v_jf^2 x_j^2. A word is hashed to one of ``WORDS`` features
with the root of its share of the text's words; every statistic is cut into bins, one feature each.

The machine is fitted with Adagrad on at most ``SAMPLE`` labelled documents, those of the least seeded hash of
their id. It has a fixed number of weights, which are broadcast; scoring is one pass over all documents.

Defined cases: a null text counts as empty and is scored by its statistics alone; null metadata has a bin of its own; documents
with several labels count with the highest; rows that repeat get equal scores; without labels every score is 0.5; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.shipping import ship
from tallybook.llm.words import NOT_SPACE, chunks, span_codes, spans, word_codes

WORDS = 1 << 14
BINS = 16
RANK = 8
SAMPLE = 6000
#: Statistics of the structure; metadata columns follow.
STATS = 8
_U = np.uint64

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[0x41:0x5B] = True
_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def _repeats(codes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row, how many codes are equal to another one of the row before them."""
    order = np.lexsort((codes, row))
    c, r = codes[order], row[order]
    same = (c[1:] == c[:-1]) & (r[1:] == r[:-1])
    return np.bincount(r[1:][same], minlength=rows)


def features(raw: np.ndarray, offsets: np.ndarray, metadata: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of all features that are not 0, in row order."""
    rows = len(offsets) - 1
    codes, bounds = word_codes(raw, offsets, NOT_SPACE)
    n = np.diff(bounds)
    word_row = np.repeat(np.arange(rows), n)
    key, count = np.unique(word_row.astype(_U) * _U(WORDS) + (codes >> _U(64 - 14)), return_counts=True)
    row, feature = (key // _U(WORDS)).astype(np.int64), (key % _U(WORDS)).astype(np.int64)
    value = np.sqrt(count / np.maximum(n, 1)[row])

    size = np.maximum(np.diff(offsets), 1)
    per = lambda table: np.diff(np.append(0, np.cumsum(table[raw]))[offsets]) / size
    starts, ends, line_bounds = spans(raw, offsets, _LINE)
    lines = np.diff(line_bounds)
    repeated = _repeats(span_codes(raw, starts, ends), np.repeat(np.arange(rows), lines), rows)
    distinct = np.bincount(row, minlength=rows)
    share = lambda x: np.clip(np.where(x > 0, 1 + np.log2(np.maximum(x, 1e-9) * 256) * 1.6, 0), 0, BINS - 1)
    stats = [
        np.log2(1 + n), size / np.maximum(n, 1), share(per(_SYMBOL)), share(per(_DIGIT)), share(per(_CAPITAL)),
        share(repeated / np.maximum(lines, 1)), 15 * distinct / np.maximum(n, 1), np.log2(1 + size / np.maximum(lines, 1)),
    ]
    stats += [np.where(np.isnan(m), BINS - 1, np.log2(1 + np.maximum(m, 0)) * 0.7) for m in metadata]
    bins = np.stack([np.clip(s, 0, BINS - 1).astype(np.int64) + WORDS + i * BINS for i, s in enumerate(stats)], 1)
    all_rows = np.concatenate([row, np.repeat(np.arange(rows), len(stats))])
    order = np.argsort(all_rows, kind="stable")
    every = np.concatenate([feature, bins.ravel()])[order]
    return all_rows[order], every, np.concatenate([value, np.full(bins.size, 0.4)])[order]


def scores(model: dict, row: np.ndarray, feature: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """The machine's output before the sigmoid, by the identity of the sum of squares."""
    heads = np.searchsorted(row, np.arange(rows))
    vx = model["v"][feature] * value[:, None]
    whole, squares = np.add.reduceat(vx, heads, 0), np.add.reduceat(vx * vx, heads, 0)
    return model["b"] + np.add.reduceat(model["w"][feature] * value, heads) + 0.5 * (whole * whole - squares).sum(1)


def trained(examples: list[tuple[np.ndarray, np.ndarray, float]], size: int, epochs: int = 6, seed: int = 3) -> dict:
    """The machine after some passes over (features, values, label) in batches."""
    rng = np.random.default_rng(seed)
    y = np.array([e[2] for e in examples])
    model = {"b": float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), "w": np.zeros(size), "v": rng.normal(0, 0.02, (size, RANK))}
    grown = {k: np.full_like(model[k], 1e-3) for k in ("w", "v")}
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for at in range(0, len(order), 100):
            batch = [examples[i] for i in order[at : at + 100]]
            lengths = np.array([len(e[0]) for e in batch])
            feature, value = np.concatenate([e[0] for e in batch]), np.concatenate([e[1] for e in batch])
            row = np.repeat(np.arange(len(batch)), lengths)
            heads = np.cumsum(lengths) - lengths
            vx = model["v"][feature] * value[:, None]
            out = scores(model, row, feature, value, len(batch))
            error = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - np.array([e[2] for e in batch]))[row]
            whole = np.repeat(np.add.reduceat(vx, heads, 0), lengths, 0)
            found, place = np.unique(feature, return_inverse=True)
            for name, slope in (("w", error * value), ("v", error[:, None] * value[:, None] * (whole - vx))):
                g = np.zeros((len(found), *slope.shape[1:]))
                np.add.at(g, place, slope)
                g = g / len(batch) + 1e-5 * model[name][found]
                grown[name][found] += g * g
                model[name][found] -= 0.1 * g / np.sqrt(grown[name][found])
            model["b"] -= 0.05 * float(error[heads].mean())
    return {"b": model["b"], "w": model["w"].astype(np.float32), "v": model["v"].astype(np.float32)}


def _numbers(batch: pa.RecordBatch, places: list[int]) -> list[np.ndarray]:
    return [np.array([np.nan if x is None else float(x) for x in batch.column(i).to_pylist()]) for i in places]


def fitted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", metadata: tuple[str, ...] = (), sample: int = SAMPLE) -> dict:
    """A machine from the labelled documents."""
    spark = docs.sparkSession
    ship(spark)
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("doc_id"))
        .agg(F.max(label).cast("double").alias("label"))
        .orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id")
        .limit(sample)
    )
    named = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), *[F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(metadata)])
    rows = named.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text", *[f"m{i}" for i in range(len(metadata))])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            extra = _numbers(batch, list(range(3, batch.num_columns)))
            f_out, v_out = [], []
            for first, end, raw, offsets in chunks(batch.column(2)):
                row, feature, value = features(raw, offsets, [m[first:end] for m in extra])
                at = np.searchsorted(row, np.arange(1, end - first))
                f_out.extend(x.astype(np.int32) for x in np.split(feature, at))
                v_out.extend(x.astype(np.float32) for x in np.split(value, at))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(f_out, pa.list_(pa.int32())), pa.array(v_out, pa.list_(pa.float32()))],
                ["doc_id", "label", "feature", "value"],
            )

    kind = named.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(built, f"doc_id {kind}, label double, feature array<int>, value array<float>").dropDuplicates(["doc_id"])
    table = found.toArrow().sort_by("doc_id")
    examples = [
        (np.array(f, np.int64), np.array(v), y)
        for f, v, y in zip(table["feature"].to_pylist(), table["value"].to_pylist(), table["label"].to_pylist(), strict=True)
    ]
    size = WORDS + BINS * (STATS + len(metadata))
    if not examples:
        return {"b": 0.0, "w": np.zeros(size, np.float32), "v": np.zeros((size, RANK), np.float32)}
    return trained(examples, size)


def scored(docs: DataFrame, model: dict, text: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """The documents with ``score`` instead of their text."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in (text, "score")]
    cut = docs.select(
        *[f"`{c}`" for c in others], F.col(text).cast("string").alias("__text"), *[F.col(c).cast("double").alias(f"__m{i}") for i, c in enumerate(metadata)]
    )
    place = len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            extra = _numbers(batch, list(range(place + 1, batch.num_columns)))
            out = np.zeros(batch.num_rows)
            for first, end, raw, offsets in chunks(batch.column(place)):
                out[first:end] = scores(machine, *features(raw, offsets, [m[first:end] for m in extra]), end - first)
            share = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], pa.array(share, pa.float64())], names=[*batch.schema.names[:place], "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields[:place]]
    return cut.mapInArrow(run, ", ".join([*fields, "score double"]))
