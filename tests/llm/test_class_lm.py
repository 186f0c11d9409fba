"""The class model against a plain one: counts, classes of all words, scores, and single moves of exchange."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tallybook.llm import class_lm


def corpus(seed: int, rows: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    kinds = [[f"{k}{i}" for i in range(60)] for k in ("noun", "verb", "thing")]
    pick = lambda k: k[min(int(rng.expovariate(0.08)), 59)]
    return [(i, " ".join(pick(kinds[j % 3]) for j in range(rng.randint(0, 40)))) for i in range(rows)]


def coded(text: str) -> list[tuple[int, int]]:
    raw = np.frombuffer(text.encode(), np.uint8)
    codes, forms, _ = class_lm._tokens(raw, np.array([0, len(raw)]))
    return list(zip(codes.tolist(), forms.tolist(), strict=True))


@pytest.mark.parametrize("frequent", [class_lm.FREQUENT, 25])
def test_scores_against_a_plain_class_bigram_model(spark, monkeypatch, frequent):
    monkeypatch.setattr(class_lm, "FREQUENT", frequent)
    kept = []
    monkeypatch.setattr(class_lm, "fitted", lambda *a, _fit=class_lm.fitted, **k: kept.append(_fit(*a, **k)) or kept[-1])
    train = corpus(1, 80)
    texts = [*corpus(2, 30), (100, "never Seen words noun1 VERB2"), (101, ""), (102, None)]
    schema = "doc_id long, text string"
    rows = class_lm.scored(spark.createDataFrame(texts, schema), spark.createDataFrame(train, schema)).collect()
    model = kept[0]
    counts = Counter(c for _, t in train for c, _ in coded(t))
    form_of = {c: f for _, t in train for c, f in coded(t)}
    units = {(r["word"], r["form"]): r for r in model.units.collect()}
    assert {w for w, f in units if f < 0} == {w for w, n in counts.items() if n >= class_lm.MIN_COUNT or w == class_lm.END}
    assert len(model.classes.words) <= frequent and (frequent > 25 or len(counts) > 100)

    def own(code, form):
        at = (code, -1) if (code, -1) in units else (0, form)
        return units[at]["own"] if at in units else 1

    def context(code, form):
        at = np.flatnonzero(model.contexts.words == code)
        return int(model.contexts.own[at[0]] if len(at) else model.contexts.forms[form])

    def steps(text):
        before = 0
        for code, form in coded(text):
            yield before, own(code, form), code
            before = context(code, form)

    pairs = Counter((g, c) for _, t in train for g, c, _ in steps(t))
    size = Counter(own(c, form_of[c]) for _, t in train for c, _ in coded(t))
    kinds = Counter(own(c, form_of[c]) for c in counts)
    table = np.zeros_like(model.table)
    for (g, c), n in pairs.items():
        table[g, c] = n
    assert (table == model.table).all()
    after = Counter(g for _, t in train for g, _, _ in steps(t))
    for r in rows:
        plain = 0.0
        for g, c, code in steps(dict(texts)[r["doc_id"]] or ""):
            plain += math.log10((pairs[g, c] + 0.5) / (after[g] + 0.5 * class_lm.CLASSES))
            plain += math.log10((counts[code] + 0.5) / (size[c] + 0.5 * (kinds[c] + 1)))
        assert r["score"] == pytest.approx(plain, abs=1e-6)
    # Nothing is left over: each class shares its whole mass with its words and one unknown word.
    mass = {c: sum(n + 0.5 for w, n in counts.items() if own(w, form_of[w]) == c) + 0.5 for c in size}
    assert all(mass[c] == pytest.approx(size[c] + 0.5 * (kinds[c] + 1)) for c in size)


def test_one_move_against_all_likelihoods():
    rng = np.random.default_rng(3)
    k, count = class_lm.CLASSES, 30
    full = rng.poisson(0.3, (count, k)) + (np.arange(k) == rng.integers(0, k, count)[:, None])
    own = rng.integers(1, 6, count)

    def table(of):
        out = np.zeros((k, k))
        np.add.at(out.T, of, full)
        return out

    offsets = np.append(0, np.cumsum((full > 0).sum(1)))
    context, held = np.nonzero(full)[1], full[full > 0]
    best = class_lm.best_classes(own, full.sum(1), offsets, context, held, table(own))
    for u in range(count):
        values = []
        for c in range(1, k):
            moved = own.copy()
            moved[u] = c
            values.append(class_lm.likelihood(table(moved)))
        assert values[best[u] - 1] == pytest.approx(max(values))


def test_rounds_never_lower_the_likelihood(spark, monkeypatch):
    seen = []
    plain = class_lm.class_table
    monkeypatch.setattr(class_lm, "class_table", lambda found: seen.append(plain(found)) or seen[-1])
    model = class_lm.fitted(spark.createDataFrame(corpus(4, 120), "doc_id long, text string"))
    assert class_lm.likelihood(model.table) >= class_lm.likelihood(seen[0][0]) and model.table.sum() == model.tokens
    again = class_lm.fitted(spark.createDataFrame(corpus(4, 120), "doc_id long, text string").repartition(5))
    assert (again.table == model.table).all()


def test_rare_words_of_rows():
    codes, place = np.array([5, 5, 9, 5, 5, 7]), np.array([1, 1, 2, 1, 3, 0])
    sizes, word, at, n = class_lm._rare(codes, place, np.array([True] * 5 + [False]), np.array([0, 3, 3, 6]))
    assert (sizes.tolist(), word.tolist(), at.tolist(), n.tolist()) == ([2, 0, 2], [5, 9, 5, 5], [1, 2, 1, 3], [2, 1, 1, 1])
    assert pa.array(n).type == pa.int64()


def test_places_and_contexts_are_those_of_a_plain_count(spark, monkeypatch):
    """Words whose codes share their first bits, counts handed on in parts, words over several batches; frequent pairs leave a task once."""
    words = np.sort(np.array([class_lm.END, 5, 6, 7, 1 << 50, (1 << 50) + 1, -(1 << 60), (1 << 63) - 1], np.int64))
    codes = np.append(words, [0, 8, 1 << 49, -2, -(1 << 63), (1 << 50) + 2])
    at, known = class_lm.Places(words).of(codes)
    assert known.tolist() == [c in set(words.tolist()) for c in codes.tolist()] and (words[at[known]] == codes[known]).all()

    monkeypatch.setattr(class_lm, "MOST_HELD", 200)
    texts = [t for _, t in corpus(7, 60)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    codes, forms, bounds = class_lm._tokens(raw, np.cumsum([0, *(len(t.encode()) for t in texts)]))
    found, first = np.unique(codes, return_index=True)
    some = found[:: 2]
    classes = class_lm.Classes(some, np.ones(len(some), np.int64), 1 + np.arange(len(some)) % 63, np.append(1 + np.arange(class_lm.FORMS) % 63, 0))
    plain = Counter(zip(codes.tolist(), class_lm._before(classes.of(codes, forms)[0], bounds).tolist(), strict=True))
    monkeypatch.setattr(class_lm, "chunks", lambda column, _cut=class_lm.chunks: _cut(column, 300))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = class_lm.context_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), classes).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    counted = {(r["word"], c): n for r in rows for c, n in zip(r["contexts"], np.frombuffer(r["counts"], "<i8").tolist(), strict=True)}
    assert counted == plain and len(rows) == len(found)
    assert {r["word"]: r["form"] for r in rows} == dict(zip(found.tolist(), forms[first].tolist(), strict=True))
    assert all(r["n"] == sum(n for (w, _), n in plain.items() if w == r["word"]) for r in rows)


def test_context_counts_meet_as_one_row_per_word(spark):
    """A map task hands on a row per word with all its contexts, not a row per word and context."""
    texts = [(" ".join(f"w{a} x" for a in range(200)),)] * 4
    classes = class_lm.Classes(*(np.zeros(0, np.int64) for _ in range(3)), 1 + np.arange(class_lm.FORMS + 1) % (class_lm.CLASSES - 1))
    found = class_lm.context_counts(spark.createDataFrame(texts, "text string").coalesce(1), classes)
    x = next(r for r in found.collect() if max(map(len, (r["contexts"],))) > 5)
    assert x["n"] == 4 * 200 and len(x["counts"]) == 8 * len(x["contexts"])
    assert sum(np.frombuffer(x["counts"], "<i8")) == x["n"]
    nodes = found._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = next(i for i, line in enumerate(nodes) if "Exchange hashpartitioning(word" in line)
    assert "contexts" in nodes[dealt + 1]
