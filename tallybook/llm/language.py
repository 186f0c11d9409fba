"""Language identification with a string kernel.

Two texts are compared by the byte n-grams of one to three bytes (A-Z in lower case) that both contain: the blended-spectrum
presence kernel, divided by the root of the product of their own counts. N-grams are hashed to ``BITS`` bits. Nyström landmarks,
drawn evenly from the languages of a bounded sample of labelled texts, stand for the kernel; one ridge regression per
language against the rest is solved on them. Scoring multiplies the presence matrix of a batch of texts with the landmarks
and the result with the coefficients.

The model is fitted on at most ``SAMPLE`` labelled texts in all, ``SAMPLE`` / languages of each, those of the least seeded hash.
It holds ``LANDMARKS`` rows of ``BITS`` flags, whatever the size of the corpus.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any labelled text every prediction is
``und``; ties go to the language first in order; rows that repeat get the same prediction; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.shipping import ship
from tallybook.llm.words import _LOWER, chunks

BITS = 1 << 13
SAMPLE = 2400
LANDMARKS = 256
RIDGE = 1e-3
UNKNOWN = "und"
_ROWS = 256


def presence(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, flags of the n-grams of up to ``_ROWS`` texts)."""
    low = _LOWER[raw].astype(np.uint32)
    for first in range(0, len(offsets) - 1, _ROWS):
        bounds = offsets[first : first + _ROWS + 1]
        b = low[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(b))
        flags = np.zeros((len(bounds) - 1, BITS), bool)
        code = np.zeros(len(b), np.uint32)
        for n in (1, 2, 3):
            code = code[: len(b) - n + 1] * np.uint32(256) + b[n - 1 :] if n <= len(b) else code[:0]
            inside = left[: len(code)] >= n
            spread = ((code + np.uint32(n << 24)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
            flags[row[: len(code)][inside], spread[inside]] = True
        yield first, flags


def kernel(flags: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    x, z = flags.astype(np.float32), landmarks.astype(np.float32)
    own = np.sqrt(np.maximum(x.sum(1), 1))[:, None] * np.sqrt(np.maximum(z.sum(1), 1))[None, :]
    return (x @ z.T) / own


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = []
        for _, _, raw, offsets in chunks(batch.column(1)):
            for _, flags in presence(raw, offsets):
                bits.extend(x.tobytes() for x in np.packbits(flags, axis=1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["lang", "bits"])


def sample_of(docs: DataFrame, key: str, text: str, lang: str, sample: int) -> DataFrame:
    """(lang, text) of at most ``sample`` labelled documents. Only ids are ranked; texts are fetched for those chosen."""
    named = docs.select(F.col(key).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
    )
    ids = named.select("doc_id", "lang")
    each = max(4, sample // max(1, ids.select("lang").distinct().count()))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(6), "doc_id"), "doc_id")
    chosen = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).select("doc_id", "lang").distinct().limit(sample)
    return named.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("lang", "text")


def fitted(sample: DataFrame, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, landmark flags and coefficients from (lang, text)."""
    ship(sample.sparkSession)
    rows = sorted((r["lang"], bytes(r["bits"])) for r in sample.mapInArrow(_packed, "lang string, bits binary").collect())
    names = sorted({x for x, _ in rows})
    if not names:
        return [], np.zeros((0, BITS), bool), np.zeros((0, 0))
    flags = np.unpackbits(np.array([np.frombuffer(b, np.uint8) for _, b in rows]), axis=1).astype(bool)
    known = np.array([names.index(x) for x, _ in rows])
    # Every language gives as many landmarks, spread over its rows.
    each = max(1, landmarks // len(names))
    picks = [np.flatnonzero(known == i) for i in range(len(names))]
    z = flags[np.concatenate([p[np.linspace(0, len(p) - 1, min(each, len(p))).astype(int)] for p in picks])]
    near, own = kernel(flags, z).astype(float), kernel(z, z).astype(float)
    values, vectors = np.linalg.eigh(own + 1e-6 * np.eye(len(z)))
    half = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    phi = near @ half
    weight = 1.0 / np.bincount(known)[known]
    y = np.where(known[:, None] == np.arange(len(names)), 1.0, -1.0)
    gram = phi.T @ (phi * weight[:, None]) + ridge * np.eye(len(z))
    return names, z, half @ np.linalg.solve(gram, phi.T @ (y * weight[:, None]))


def predicted(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """The documents with ``lang_pred`` and ``score`` instead of their text."""
    ship(docs.sparkSession)
    names, z, coefficients = model
    shared = docs.sparkSession.sparkContext.broadcast((names, np.packbits(z, axis=1), coefficients.astype(np.float32)))
    others = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    cut = docs.select(*[f"`{c}`" for c in others], F.col(text).cast("string").alias("__text"), letter.alias("__letter"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, packed, w = shared.value
        z = np.unpackbits(packed, axis=1).astype(bool) if len(names) else packed
        for batch in batches:
            best = np.full(batch.num_rows, -1)
            score = np.zeros(batch.num_rows)
            letters = np.array(batch.column(batch.num_columns - 1).to_pylist(), bool)
            if names:
                for first, _, raw, offsets in chunks(batch.column(batch.num_columns - 2)):
                    for more, flags in presence(raw, offsets):
                        value = 4.0 * (kernel(flags, z) @ w)
                        share = np.exp(value - value.max(1, keepdims=True))
                        at = slice(first + more, first + more + len(flags))
                        best[at], score[at] = value.argmax(1), share.max(1) / share.sum(1)
            best[~letters], score[~letters] = -1, 0.0
            label = pa.array([names[i] if i >= 0 else UNKNOWN for i in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], label, pa.array(score, pa.float64())], names=[*batch.schema.names[:-2], "lang_pred", "score"]
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields[:-2]]
    return cut.mapInArrow(scored, ", ".join([*fields, "lang_pred string", "score double"]))
