"""Token counts by a two-tier lookup on the map side; no pre-token is shuffled.

A pre-token is a run of blanks with the non-blank run after it. No piece of the vocabulary has a blank after another
character (checked when the model is loaded), so merges never cross a pre-token and the count of a text is the sum
over its pre-tokens. Tier one is a table of the lengths of frequent pre-tokens, fitted on a bounded sample and
broadcast; tier two is a cache in each Python worker, filled by encoding what tier one lacks. The table decides speed
only: every count comes from the tokenizer's own library.

Defined cases: a null text counts as empty and has 0 bytes and 0 tokens; a text of blanks only is one pre-token;
the character U+2581 is a blank, as the tokenizer has it; strings of special tokens inside a text are ordinary text; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.shipping import ship
from tallybook.llm.words import chunks, span_codes

#: Entries of the broadcast table at most: 10 bytes each.
TABLE_ENTRIES = 1 << 16
#: Documents from which the table is fitted at most, and the longest that is taken for it: they pass the driver.
SAMPLE_DOCS = 2048
SAMPLE_BYTES = 1 << 16
#: Pre-tokens a Python worker remembers at most, before it starts anew.
CACHE_ENTRIES = 1 << 20

_BLANK = 0x20
_ONE_BLANK, _NOTHING = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
_models: dict[int, tuple] = {}


def _model(proto: bytes) -> tuple:
    """The tokenizer and the cache of this worker."""
    import sentencepiece

    key = hash(proto)
    if key not in _models:
        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        if any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size())):
            raise ValueError("a piece of this vocabulary crosses a blank")
        _models[key] = model, {}
    return _models[key]


def _pretokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: first and end row, bytes, starts and ends of the pre-tokens, and each row's first pre-token."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.replace_substring(texts, "▁", " ")
    marked = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(_ONE_BLANK, texts, _NOTHING))
    for first, end, raw, offsets in chunks(marked):
        blank = raw == _BLANK
        opens = blank.copy()
        opens[1:] &= ~blank[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        opens[heads] = True
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(raw)) if len(starts) else starts
        yield first, end, raw, starts, ends, np.searchsorted(starts, offsets)


def _lengths(model, found: list[bytes]) -> list[int]:
    """Tokens of pre-tokens. The library puts one blank in front of a text, so one is left off here."""
    coded = model.encode([x[1:].decode() for x in found], num_threads=1)
    return [len(x) or 1 for x in coded]


def frequent_table(docs: DataFrame, proto: bytes, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of frequent pre-tokens and their lengths in tokens."""
    few = docs.select(F.col(text).cast("string").alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES).limit(sample_docs).collect()
    seen: Counter = Counter()
    for _, _, raw, starts, ends, _ in _pretokens(pa.array([r["text"] for r in few], pa.string())):
        data = raw.tobytes()
        seen.update(data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    found = sorted(x for x, _ in seen.most_common(TABLE_ENTRIES))
    model, _ = _model(proto)
    lengths = np.array(_lengths(model, found), np.int64).astype(np.uint16) if found else np.zeros(0, np.uint16)
    raw = np.frombuffer(b"".join(found), np.uint8)
    ends = np.cumsum([len(x) for x in found], dtype=np.int64)
    starts = np.append(0, ends[:-1]) if found else ends
    codes = span_codes(raw, starts, ends)
    codes, at = np.unique(codes, return_index=True)
    return codes, lengths[at]


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The documents with ``n_bytes`` and ``n_tokens`` (in place of columns of those names)."""
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        proto = f.read()
    shared = spark.sparkContext.broadcast((proto, *frequent_table(docs, proto, text, sample_docs)))
    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", text)]
    out = docs.select(*[f"`{c}`" for c in kept], F.col(text).cast("string").alias(text), F.lit(0).cast("long").alias("n_tokens"))
    schema = out.schema

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proto, codes, lengths = shared.value
        model, cache = _model(proto)
        for batch in batches:
            place = len(batch.schema) - 1
            total = np.zeros(batch.num_rows, np.int64)
            for first, end, raw, starts, ends, bounds in _pretokens(batch.column(place - 1)):
                keys = span_codes(raw, starts, ends)
                n = np.zeros(len(keys), np.int64)
                known = np.zeros(len(keys), bool)
                if len(codes) and len(keys):
                    at = np.minimum(np.searchsorted(codes, keys), len(codes) - 1)
                    known = codes[at] == keys
                    n[known] = lengths[at[known]]
                rest, pick, back = np.unique(keys[~known], return_index=True, return_inverse=True)
                if len(rest):
                    if len(cache) > CACHE_ENTRIES:
                        cache.clear()
                    where = np.flatnonzero(~known)[pick]
                    names = rest.tolist()
                    new = [i for i, k in enumerate(names) if k not in cache]
                    if new:
                        data = raw.tobytes()
                        a, b = starts[where[new]].tolist(), ends[where[new]].tolist()
                        found = _lengths(model, [data[x:y] for x, y in zip(a, b, strict=True)])
                        cache.update(zip([names[i] for i in new], found, strict=True))
                    n[~known] = np.array([cache[k] for k in names], np.int64)[back]
                running = np.append(0, np.cumsum(n))
                total[first:end] = running[bounds[1:]] - running[bounds[:-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total)], schema=batch.schema)

    result = out.mapInArrow(counted, schema)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return result.select(*[f"`{c}`" for c in docs.columns if c not in ("n_bytes", "n_tokens")], size.alias("n_bytes"), "n_tokens")
