"""Collocations, token files and importance resampling against plain versions, with the edge cases of each."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallybook.llm import collocations, importance, simple8b, token_files
from tallybook.llm.count_automaton import CountAutomaton
from tallybook.llm.words import chunks

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"Word{i % 7919}," for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, rank string, score string, n string, key string, part string, start string, code string"


def table(spark, cases: list[tuple]):
    return spark.createDataFrame([(*c, *["x"] * 7) for c in cases], SCHEMA)


EDGES = [
    (1, None, "en"), (2, "", "en"), (3, " \t\n\x0b .,;", None), (4, LONG, "en"), (5, "Same text. same TEXT", "und"), (5, "Same text. same TEXT", "und"),
    (5, "other text of this id", "de"), (None, "no id at all " * 9, None), (None, None, None), (-7, "é ß́, 日本  x<|endoftext|>y", "de"), (2**62, "\x00\x01 a", ""),
]


# --- automata


def random_paths(seed: int, rows: int, width: int, words: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    paths = rng.integers(1, words + 1, (rows, width)).astype(np.uint64)
    paths[np.arange(width) >= rng.integers(1, width + 1, rows)[:, None]] = 0
    return paths


def plain_counts(paths: np.ndarray) -> Counter:
    found = Counter()
    for row in paths.tolist():
        row = [x for x in row if x]
        found.update(tuple(row[:k]) for k in range(1, len(row) + 1))
    return found


@pytest.mark.parametrize("rows, width, words", [(0, 3, 5), (1, 1, 1), (400, 4, 3), (3000, 5, 6), (2000, 3, 500)])
def test_automaton_counts(rows, width, words):
    paths = random_paths(rows, rows, width, words)
    half = rows // 2
    parts = [CountAutomaton.of(p, np.ones(len(p), np.int64)) for p in (paths[:half], paths[half:])]
    whole = CountAutomaton.union([CountAutomaton.from_bytes(p.to_bytes()) for p in parts])
    want = plain_counts(paths)
    seqs, n, _ = whole.sequences()
    assert {tuple(x for x in r if x): c for r, c in zip(seqs.tolist(), n.tolist())} == want
    cut = whole.pruned(3)
    seqs, n, _ = cut.sequences()
    assert {tuple(x for x in r if x): c for r, c in zip(seqs.tolist(), n.tolist())} == {k: c for k, c in want.items() if c >= 3}
    asked = random_paths(rows + 1, 300, width, words + 1)
    met, counts = whole.compose(CountAutomaton.of(asked, np.ones(len(asked), np.int64)))
    got = {tuple(x for x in r if x): c for r, c in zip(met.tolist(), counts.tolist())}
    assert got == {k: want[k] for k in {tuple(x for x in r if x) for r in asked.tolist()} if k in want}


def test_equal_endings_are_kept_once():
    paths = np.array([[i, 900, 901, 902] for i in range(1, 200)], np.uint64)
    assert CountAutomaton.of(paths, np.ones(len(paths), np.int64)).states() == 4


# --- collocations


def plain_collocations(rows: list[tuple], least: int, top: int, longest: int) -> set[tuple]:
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        mine = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for i in range(len(words)):
                mine.update(tuple(words[i : i + k]) for k in range(1, min(longest, len(words) - i) + 1))
    out = set()
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        scored = []
        for p, a in good.items():
            if not any(len(q) > len(p) and b >= a and inside(p, q) for q, b in good.items()):
                score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out |= {(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)}
    return out


def phrases_of(docs, **settings) -> set[tuple]:
    rows = collocations.collocations(docs, **settings).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert len(set(map(tuple, rows))) == len(rows)
    return set(map(tuple, rows))


@pytest.mark.parametrize("longest, range_words", [(5, 40), (3, 2_000_000), (2, 100)])
def test_collocations_against_plain_version(spark, longest, range_words):
    rng = random.Random(longest)
    words = ["a", "B", "c", "d", "é", "日本", "Ab", "x-y"]
    cases = []
    for i in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n"]) for _ in range(rng.randint(0, 60)))
        cases.append((i, text, rng.choice(["en", "de", None, "und"])))
    cases += [(99, "hot pair of words " * 80, "en")] * 3 + EDGES
    docs = table(spark, cases).repartition(5)
    want = plain_collocations([(c[2], c[1]) for c in cases], 4, 25, longest)
    assert phrases_of(docs, longest=longest, min_count=4, top=25, range_words=range_words) == want


def test_collocations_of_an_empty_table(spark):
    assert phrases_of(table(spark, EDGES).limit(0)) == set()
    assert phrases_of(table(spark, EDGES[:3])) == set()


# --- token files


@pytest.mark.parametrize("n", [0, 1, 239, 1024, 1025, 5000])
@pytest.mark.parametrize("high", [1, 2, 1000, 50_000, 2**40, 2**60, 2**64 - 1])
def test_simple8b_round_trip(n, high):
    rng = np.random.default_rng(n)
    values = rng.integers(0, high, n, dtype=np.uint64, endpoint=True)
    values[rng.random(n) < 0.3] = 0
    cells = np.frombuffer(simple8b.encode(values), "<u8")
    found, length = simple8b.decode(cells)
    assert length == len(cells) and (found == values).all()
    if n > 2048:
        assert (simple8b.decode(cells, 1, 3)[0] == values[1024:3072]).all()


def test_pieces_encode_like_whole_texts():
    library, encoder = Tokenizer.from_file(BYTE_BPE), token_files.Encoder(open(BYTE_BPE, encoding="utf-8").read())
    parts = [" ", "  ", "\n", "\t", "a", "b", "é", "ß", "\xa0", "　", " ", "1", "23", "'s", "!", "…", "<|endoftext|>", "日本", "\r\n", "the", " the", "\x85", "\x00", "ſ", ",", ".", "́", "×", "²"]
    rng = random.Random(5)
    for _ in range(1500):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4)]
        for _, _, raw, offsets in chunks(pa.array(texts)):
            ids, sizes = encoder.encode(raw, offsets)
            assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]
            assert sizes.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def written(spark, docs, folder) -> list[tuple]:
    path = f"{folder}/tokens"
    token_files.write(docs, BYTE_BPE, path)
    read = token_files.documents(spark, path)
    return sorted(map(tuple, token_files.with_starts(read).select("start", "key", "n_tokens", "ids").collect()))


def test_token_files_of_edge_cases(spark, tmp_path):
    library = Tokenizer.from_file(BYTE_BPE)
    found = written(spark, table(spark, EDGES).repartition(4), tmp_path)
    want = Counter((c[0], np.array([*library.encode(c[1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for c in EDGES)
    assert Counter((key, bytes(ids)) for _, key, _, ids in found) == want
    assert [key for _, key, _, _ in found] == sorted((c[0] for c in EDGES), key=lambda k: (k is not None, k or 0))
    place = 0
    for start, _, n, ids in found:
        assert start == place and len(ids) == 4 * n
        place += n


def test_token_files_of_an_empty_table_and_other_tokenizers(spark, tmp_path):
    assert written(spark, table(spark, EDGES).limit(0), tmp_path) == []
    with pytest.raises(ValueError):
        token_files.write(table(spark, EDGES), public_tokenizers.path("word_bpe_49k.json"), f"{tmp_path}/no")


def test_files_are_words_and_frames(spark, tmp_path):
    token_files.write(table(spark, EDGES), BYTE_BPE, f"{tmp_path}/t")
    content = [r["content"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{tmp_path}/t").collect()]
    assert sum(map(len, content)) and all(len(c) % 8 == 0 for c in content)
    with pytest.raises(ValueError):
        list(token_files.frames(b"x" * 64))


def test_token_file_query(spark):
    from tallybook.llm import queries as q

    folder, library = "/root/testdata/sf0.001", Tokenizer.from_file(BYTE_BPE)
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in q.queries()["op12_token_files"](spark, folder).collect()}
    start, want = 0, {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert found == want


# --- importance resampling


def plain_resampling(docs, target, longest: int, buckets: int, min_words: int, percent: int) -> dict:
    def hashed(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(hashed(text)[1])
    for text in target:
        t.update(hashed(text)[1])
    ns, nt = sum(s.values()), sum(t.values())
    rows = []
    for key, text in docs:
        n, f = hashed(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets)))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), key))
    able = sorted([r for r in rows if r[0] >= min_words], key=lambda r: (-r[3], r[4] is not None, r[4] or 0))
    ranks = able[: percent * len(able) // 100]
    return Counter((r[4], *r[:4]) for r in rows), [(r[3], r[4]) for r in ranks]


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (3, 97)])
def test_resampling_against_plain_version(spark, longest, buckets):
    rng = random.Random(longest)
    words = ["Alpha", "beta", "é", "日本", "x1", "gamma", "delta"]
    cases = [(i % 70, " ".join(rng.choice(words) + rng.choice(["", ".", "\n", "-"]) for _ in range(rng.randint(0, 40))), "en") for i in range(140)] + EDGES
    target = [" ".join(rng.choice(words[:3]) for _ in range(30)), None, ""]
    docs, wanted = table(spark, cases).repartition(6), spark.createDataFrame([(x, 1) for x in target], "text string, key int")
    found = importance.resampled(docs, wanted, longest=longest, buckets=buckets, min_words=5, percent=30).collect()
    rows, ranks = plain_resampling([c[:2] for c in cases], target, longest, buckets, 5, 30)
    assert Counter((r["key"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in found) == rows
    drawn = sorted((r for r in found if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(ranks) + 1))
    assert [(r["score"], r["key"]) for r in drawn] == ranks


def test_resampling_of_empty_tables(spark):
    docs, none = table(spark, EDGES), spark.createDataFrame([], "text string")
    assert importance.resampled(docs.limit(0), none).collect() == []
    assert importance.resampled(docs, none).where(F.col("rank").isNotNull()).count() == 0


def test_known_pieces_take_16_bytes_each(monkeypatch):
    """Pieces are looked up in sorted codes, not in a table of Python objects; across chunks, after forgetting and in long texts too."""
    monkeypatch.setattr(token_files, "CACHE_PIECES", 1500)
    monkeypatch.setattr(token_files, "POWERS", 20_000)
    library, encoder = Tokenizer.from_file(BYTE_BPE), token_files.Encoder(open(BYTE_BPE, encoding="utf-8").read())
    token_files._powers.cache_clear()
    texts = [" ".join(f"w{(i * 37 + j * j) % 997} é{j % 11}." for j in range(400 if i != 5 else 4000)) for i in range(12)]
    for text in ["", *texts, *texts]:
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, sizes = encoder.encode(raw, np.array([0, len(raw)]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and sizes.tolist() == [len(ids)]
        assert encoder.codes.nbytes + encoder.numbers.nbytes == 16 * len(encoder.starts[1:]) and (np.diff(encoder.codes.astype(object)) > 0).all()
    token_files._powers.cache_clear()


def test_a_full_memory_keeps_pieces_met_again(monkeypatch):
    """Frequent pieces are not handed to the library again when the memory is full, and texts for the library are short."""
    monkeypatch.setattr(token_files, "CACHE_PIECES", 1500)
    library, encoder = Tokenizer.from_file(BYTE_BPE), token_files.Encoder(open(BYTE_BPE, encoding="utf-8").read())
    learned, longest, learn, ids_of = Counter(), [], encoder._learn, encoder._ids
    monkeypatch.setattr(encoder, "_learn", lambda pieces: (learned.update(pieces), learn(pieces)))
    monkeypatch.setattr(encoder, "_ids", lambda pieces: (longest.append(len(pieces)), ids_of(pieces))[1])
    common = " ".join(f"common{i}" for i in range(300))
    for i in range(40):
        text = common + " ".join(f" rare{i * 400 + j}x" for j in range(400)) + (" a<|endoftext|>b" if i % 7 == 3 else "")
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, sizes = encoder.encode(raw, np.array([0, len(raw)]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and sizes.tolist() == [len(ids)]
    assert max(n for piece, n in learned.items() if piece.startswith(b" common")) == 1
    assert len(encoder.codes) <= 1500 + 701 and max(longest) <= token_files.PIECES_A_CALL
