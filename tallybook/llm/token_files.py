"""Token ids of a corpus in binary files, in order of the documents' ids, coded with Simple-8b.

The texts are dealt by ranges of the id and sorted, then every task encodes its range and hands on frames of some hundred
thousand ids, which Spark's text writer commits as they are: one file per range, any file system, and a task that runs again
replaces its own file. A frame is a whole number of 64-bit words, so a file can be mapped into memory:

    ``MAGIC``, words of the frame, documents, ids of the documents, flags of null ids (64 a word),
    stream of the documents' lengths, stream of all their tokens, ``END`` (as line end)

Streams are those of ``simple8b``: a reader decodes whole frames or single blocks.

Encoding: a text is cut before white space that follows a visible character, and before one of ``.,;:!?`` that follows a
letter or digit: no pre-token of a byte-level vocabulary can cross these places. Pieces that a worker has met before are looked up by
64-bit codes, the others go to the library. A full memory keeps the pieces that were met again since it was last full. Special strings with such places are not accepted, so one always stays in one piece. ``token_files`` rejects tokenizers of another kind.

Order: null ids first, then ascending; rows of one id by a hash of their text. Equal rows that make up much of the table are
dealt to several ranges. Defined cases: a null text is empty and gives the end id alone; repeated rows are all written; an
empty table gives no document; other columns are ignored. Ids are integers of at most 64 bits.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.llm import simple8b
from tallybook.llm.shipping import ship
from tallybook.llm.words import _class, chunks, mixed, span_codes

MAGIC, END = b"tokens-1", "s8b-end\n"
FRAME_IDS = 1 << 19
#: Pieces a worker remembers at most, before it drops those met only once.
CACHE_PIECES = 1_500_000
PIECES_A_CALL = 5_000
#: Pieces in one text for the library, which takes more time for each where a text is long.
PIECES_A_TEXT = 50
#: Bytes of a chunk up to which its pieces are told apart by sums over the whole chunk.
POWERS = 1 << 21
_U = np.uint64
_SPREAD = mixed(np.arange(1, 257, dtype=_U))
_BLANKS, _MARKS = _class((0x20, 0x20), (0x09, 0x0D)), _class(*[(ord(c), ord(c)) for c in ".,;:!?"])
_PLAIN = _class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A))
_encoders: dict[int, Encoder] = {}


class Encoder:
    """Ids of texts by a byte-level tokenizer of the tokenizers library, with a memory of pieces.

    The library gets the pieces that are new in texts of some pieces, with a special string of its vocabulary between them: it cuts
    texts there before anything else, so the ids between two of its ids are those of one piece.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        special = [t for t in json.loads(model).get("added_tokens", []) if t["special"]]
        self.mark, self.mark_id = (special[0]["content"].encode(), special[0]["id"]) if special else (None, -1)
        self.type = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        """Keep the pieces met again since the last time, or none if they are most of all."""
        again = getattr(self, "again", np.zeros(0, bool))
        kept = np.flatnonzero(again) if 2 * again.sum() <= CACHE_PIECES else np.zeros(0, np.int64)
        if not len(kept):
            # Codes of the known pieces in order, and the number of each piece: 16 bytes a piece.
            self.codes, self.numbers = np.zeros(0, _U), np.zeros(0, np.int64)
            self.flat, self.starts = np.zeros(0, self.type), np.zeros(1, np.int64)
        else:
            stays = again[self.numbers]
            self.codes, self.numbers = self.codes[stays], (np.cumsum(again) - 1)[self.numbers[stays]]
            self.flat, self.starts = self._of(kept)
        self.again = np.zeros(len(kept), bool)

    def _of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of so many pieces, and where those of each begin."""
        sizes = self.starts[which + 1] - self.starts[which]
        running = np.append(0, np.cumsum(sizes))
        return self.flat[np.arange(running[-1]) + np.repeat(self.starts[which] - running[:-1], sizes)], running

    def _ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, and how many each has."""
        if self.mark is not None:
            texts = [self.mark.join(pieces[i : i + PIECES_A_TEXT]).decode() for i in range(0, len(pieces), PIECES_A_TEXT)]
            # One text a call: for several the library starts threads, and a task has its core already.
            found = [self.library.encode_batch_fast([t], add_special_tokens=False)[0].ids for t in texts]
            every = np.array([i for x in found for i in (*x, self.mark_id)], np.uint32)
            marks = np.flatnonzero(every == self.mark_id)
            # More of them: a piece holds the string itself.
            if len(marks) == len(pieces):
                return np.delete(every, marks), np.diff(marks, prepend=-1) - 1
        found = [e.ids for e in self.library.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)

    def _learn(self, pieces: list[bytes]) -> None:
        parts = [self._ids(pieces[i : i + PIECES_A_CALL]) for i in range(0, len(pieces), PIECES_A_CALL)]
        self.flat = np.concatenate([self.flat, *[ids.astype(self.type) for ids, _ in parts]])
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(np.concatenate([n for _, n in parts])))
        self.again = np.append(self.again, np.zeros(len(pieces), bool))

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in the bytes, and how many each text has."""
        starts = _cuts(raw, offsets)
        ends = np.append(starts[1:], len(raw)) if len(starts) else starts
        codes, back, first = _distinct(raw, starts, ends)
        if len(self.codes) > CACHE_PIECES:
            self._forget()
        at = np.searchsorted(self.codes, codes)
        # A code past the last one has none to be compared with.
        fresh = (at == len(self.codes)) | (np.append(self.codes, _U(0))[at] != codes)
        new = np.flatnonzero(fresh)
        numbers = np.append(self.numbers, 0)[at]
        self.again[numbers[~fresh]] = True
        if len(new):
            numbers[new] = len(self.codes) + np.arange(len(new))
            content = raw.tobytes()
            self._learn([content[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            order = new[np.argsort(codes[new])]
            self.codes, self.numbers = np.insert(self.codes, at[order], codes[order]), np.insert(self.numbers, at[order], numbers[order])
        ids, running = self._of(numbers[back])
        bounds = np.searchsorted(starts, offsets)
        return ids.astype(np.uint32), running[bounds[1:]] - running[bounds[:-1]]


def _distinct(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of the distinct pieces, the number of each piece among them, and one place of each. Pieces are compared by 64-bit codes."""
    if len(raw) > POWERS:
        # Kept apart from the codes of shorter chunks, which are made in another way.
        codes = mixed(span_codes(raw, starts, ends))
    else:
        # Sums of the powers of an odd base over all bytes; a difference of two, brought back to power 0, tells a piece.
        powers, inverse = _powers()
        running = np.append(_U(0), np.cumsum(_SPREAD[raw] * powers[: len(raw)], dtype=_U))
        codes = mixed((running[ends] - running[starts]) * inverse[starts] + (ends - starts).astype(_U))
    back, found = pd.factorize(codes)
    first = np.empty(len(found), np.int64)
    first[back[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return found.astype(_U), back.astype(np.int64), first


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd base modulo 2^64, and those of its inverse."""
    tables = []
    for base in (0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)):
        cells = np.full(POWERS, base, _U)
        cells[0] = 1
        tables.append(np.multiply.accumulate(cells))
    return tables[0], tables[1]


def _cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin: at each text, at white space after a character that is surely visible, and at a mark after a letter or digit."""
    opens = np.zeros(len(raw), bool)
    if len(raw) > 1:
        before = raw[:-1]
        visible = (before > 0x20) & (before < 0x7F)
        # The second byte of a character from U+00C0 to U+07FF, none of which is white space.
        visible[1:] |= (before[1:] >= 0x80) & (raw[:-2] >= 0xC3) & (raw[:-2] <= 0xDF)
        opens[1:] = (visible & _BLANKS[raw[1:]]) | (_PLAIN[before] & _MARKS[raw[1:]])
    opens[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(opens)


def frame(keys: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    nulls = np.packbits(np.array([k is None for k in keys] + [False] * (-len(keys) % 64), bool), bitorder="little")
    parts = [np.array([k or 0 for k in keys], "<i8").tobytes(), nulls.tobytes(), simple8b.encode(sizes), simple8b.encode(ids)]
    words = 3 + sum(map(len, parts)) // 8
    return MAGIC + np.array([words, len(keys)], "<u8").tobytes() + b"".join(parts)


def frames(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids of documents, null flags, lengths, tokens) of each frame of a file."""
    cells, at = np.frombuffer(content, "<u8"), 0
    magic, end = np.frombuffer(MAGIC, "<u8")[0], np.frombuffer(END.encode(), "<u8")[0]
    while at < len(cells):
        words, docs = int(cells[at + 1]), int(cells[at + 2])
        if cells[at] != magic or cells[at + words] != end:
            raise ValueError("not a file of tokens")
        keys = cells[at + 3 : at + 3 + docs].view(np.int64)
        flags = at + 3 + docs
        body = flags + -(-docs // 64)
        nulls = np.unpackbits(cells[flags:body].view(np.uint8), bitorder="little")[:docs].astype(bool)
        sizes, length = simple8b.decode(cells[body : at + words])
        tokens, _ = simple8b.decode(cells[body + length : at + words])
        yield keys, nulls, sizes.astype(np.int64), tokens
        at += words + 1


def _encoder(model: str) -> Encoder:
    key = hash(model)
    if key not in _encoders:
        _encoders[key] = Encoder(model)
    return _encoders[key]


def write(docs: DataFrame, tokenizer_path: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Write the files. Every document ends with ``end_id``."""
    ship(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        model = f.read()
    kind = json.loads(model)
    if (kind.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or kind["pre_tokenizer"].get("add_prefix_space") or kind.get("normalizer"):
        raise ValueError("only byte-level tokenizers without a normaliser or a blank in front can be cut at blanks")
    if any(set(" .,;:!?\t\n\v\f\r") & set(t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in kind.get("added_tokens", [])):
        raise ValueError("an added token of this vocabulary crosses a blank")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        keys, sizes, tokens, held = [], [], [], 0

        def full() -> pa.RecordBatch:
            whole = frame(keys, np.concatenate(sizes), np.concatenate(tokens))
            return pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], ["frame"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, end, raw, offsets in chunks(batch.column(1)):
                ids, n = encoder.encode(raw, offsets)
                keys += names[first:end]
                sizes.append(n + 1)
                tokens.append(np.insert(ids, np.cumsum(n), end_id))
                held += len(tokens[-1])
                if held >= FRAME_IDS:
                    yield full()
                    keys, sizes, tokens, held = [], [], [], 0
        if keys:
            yield full()

    order = ["key", "tie", "deal"]
    read = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    dealt = read.withColumn("tie", F.xxhash64("text")).withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
    sorted_ = dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    found = sorted_.mapInArrow(run, "frame binary")
    found.select(F.col("frame").cast("string")).write.option("lineSep", END).text(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(key, part, at, n_tokens, ids) of every document in the files: its file's number, its first token in that file, and its ids as little-endian unsigned 32-bit numbers."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                before = 0
                for keys, nulls, sizes, tokens in frames(content.as_buffer()):
                    edges = np.append(0, np.cumsum(sizes))
                    cells = pa.py_buffer(tokens.astype("<u4"))
                    ids = pa.Array.from_buffers(pa.large_binary(), len(keys), [None, pa.py_buffer(4 * edges), cells]).cast(pa.binary())
                    columns = [pa.array(keys, mask=nulls), pa.array([part] * len(keys), pa.int64()), pa.array(before + edges[:-1]), pa.array(sizes), ids]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "part", "at", "n_tokens", "ids"])
                    before += int(edges[-1])

    number = F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(number.alias("part"), "content")
    return files.mapInArrow(run, "key bigint, part bigint, at bigint, n_tokens bigint, ids binary")


def with_starts(rows: DataFrame) -> DataFrame:
    """``rows`` of documents (part, at, n_tokens) with ``start``, the tokens of all documents before. Rows should be stored: they are read twice."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file.
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("_ids"))
    offsets = files.select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_offset"))
    return rows.join(offsets, "part").withColumn("start", F.col("_offset") + F.col("at")).drop("_offset")
