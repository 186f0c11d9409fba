"""Target-distribution importance resampling on hashed word n-grams, counted by batch concatenation.

The texts of a batch are joined with a separator that is no part of a word, one pass of a regular expression finds all words of
all texts, and the place of each word among the texts' offsets (``searchsorted``) tells its document. Runs of words that begin and
end in different documents are masked; what is left is counted into buckets with one ``bincount``. A first pass counts the buckets of the
corpus and of the target, a second one adds up the logarithmic gains of each document's features. Adding Gumbel noise, which
depends on the document's id alone, and taking the highest scores draws without replacement in proportion to the weights.

Only bucket counts pass the driver: one number per bucket. Ranks come from one range exchange (``numbered``), so neither the
draw nor its order meets in one task. Reruns draw the same documents.

Defined cases: a null or wordless text has no features and weight 0; a null id draws the noise of an empty id and sorts first among
ties; repeated rows have equal scores and follow one another; an empty corpus gives an empty result, an empty target gains from
smoothing alone; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.shipping import ship
from tallybook.llm.words import chunks
from tallybook.operators.numbering import numbered
from tallybook.sources.scratch import stored_once

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Words a worker remembers at most, before it starts anew.
CACHE_WORDS = 1 << 20
#: Fixed value: words after A-Z went to lower case, as bytes of UTF-8. The separator is none of them.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SEPARATOR = b"\n"


class _Codes(dict):
    """crc32 of the words a worker has met."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = code = crc32(word)
        return code


_codes = _Codes()


def features(raw: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, and the document and bucket of every run of one to ``longest`` words."""
    data, edges = raw.tobytes(), offsets.tolist()
    joined = SEPARATOR.join([data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]).lower()
    found = list(WORD.finditer(joined))
    words = [m[0] for m in found]
    starts = np.fromiter((m.start() for m in found), np.int64, len(found))
    begins = offsets[:-1] + np.arange(len(offsets) - 1) * len(SEPARATOR)
    document = np.searchsorted(begins, starts, "right") - 1
    codes = [_codes[w] for w in words]
    of, hashed = [document], [np.array(codes, np.int64)]
    for size in range(2, longest + 1):
        codes = [crc32(w, crc32(b" ", c)) for c, w in zip(codes, words[size - 1 :], strict=False)]
        inside = document[: len(codes)] == document[size - 1 :]
        of.append(document[: len(codes)][inside])
        hashed.append(np.array(codes, np.int64)[inside])
    return np.bincount(document, minlength=len(begins)), np.concatenate(of), np.concatenate(hashed) % buckets


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, raw, offsets in chunks(batch.column(0)):
                total += np.bincount(features(raw, offsets, longest, buckets)[2], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    counted = docs.select(F.col(text).cast("string")).mapInArrow(count, "bucket bigint, n bigint")
    found = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(buckets, np.int64)
    total[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier a bucket is in the target, both smoothed by one, rounded down."""
    s, t = corpus.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = 1) -> DataFrame:
    """(key, n_words, n_features, weight) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((3, batch.num_rows), np.int64)
            for first, end, raw, offsets in chunks(batch.column(1)):
                words, of, bucket = features(raw, offsets, longest, len(shared.value))
                # Sums of whole numbers below 2^53 are exact in doubles.
                weight = np.bincount(of, weights=shared.value[bucket], minlength=end - first)
                rows[:, first:end] = words, np.bincount(of, minlength=end - first), weight
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows)], ["key", "n_words", "n_features", "weight"])

    read = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(weigh, f"key {read.schema['key'].dataType.simpleString()}, n_words bigint, n_features bigint, weight bigint")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    longest: int = 1,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: key, n_words, n_features, weight, score, and the rank of those that are drawn."""
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, target_text, longest, buckets))
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = stored_once(weighed(docs, gain, key, text, longest).withColumn("score", F.col("weight") + noise), "resampling-scores")
    able = F.col("n_words") >= min_words
    drawn = scored.where(able).count() * percent // 100
    placed = numbered(scored, [able.desc(), F.col("score").desc(), F.col("key").asc()])
    rank = F.when(able & (F.col("position") <= drawn), F.col("position"))
    return placed.select("key", "n_words", "n_features", "weight", "score", rank.alias("rank"))
