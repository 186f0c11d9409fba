"""The registered queries on whole small tables, against SQL or a plain version."""

from __future__ import annotations

import os

import brute
import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tallybook.llm import queries as q

DATA = os.environ.get("TESTDATA", "/root/testdata")
SMALL = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/sf0.01/labels.parquet").collect()}


def result(spark, name: str, folder: str = SMALL, key: str = "doc_id") -> dict:
    rows = q.queries()[name](spark, folder).collect()
    found = {r[key]: r for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_sql(spark, name):
    engine = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "labels"):
        engine.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    mine, theirs = q.queries()[name](spark, SMALL).toPandas(), engine.sql(q.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    columns = sorted(mine.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert rows(mine) == rows(theirs)


def test_every_operator_is_registered():
    names = list(q.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13


def test_secret_scans(spark, texts):
    for i, r in result(spark, "op1_secret_scans").items():
        spans = brute.base_spans(texts[i]["text"])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert r["base_sha256"] == brute.sha(brute.listed(spans))
        assert {f"{s[3]}:{s[0]}:{s[2]}" for s in spans} <= set(r["spans"].split(","))


def test_source_mix(spark, texts):
    rows = q.queries()["op2_source_mix"](spark, SMALL).collect()
    total = sum(r["size"] for r in rows)
    targets = {texts[r["doc_id"]]["source"]: (r["target"], r["source_size"]) for r in rows}
    assert sum(t for t, _ in targets.values()) == pytest.approx(1.5 * total)
    for source, (target, size) in targets.items():
        own = [r for r in rows if texts[r["doc_id"]]["source"] == source]
        assert sum(r["size"] for r in own) == size and target <= 2 * size
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own)
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)
    assert sorted(rows) == sorted(q.queries()["op2_source_mix"](spark, SMALL).collect())


def test_quality_classifier(spark, labels):
    found = result(spark, "op3_quality_classifier", f"{DATA}/sf0.01")
    assert all(r["held_out"] == (brute.remainder(i, 3) == 1) and 0 <= r["score"] <= 1 for i, r in found.items())
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in found.values())
    assert brute.auc([(found[i]["score"], y) for i, y in labels.items() if i in found and found[i]["held_out"]]) > 0.95


def test_class_lm(spark, texts):
    found = result(spark, "op4_class_lm")
    plain = brute.unigram_scores([(i, r["text"]) for i, r in texts.items()], lambda i: brute.remainder(i, 5) != 1)
    for i, r in found.items():
        tokens, known, trained, base = plain[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, trained)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
        assert r["held_out"] == (brute.remainder(i, 5) == 1)
    held = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_quality_rules(spark, texts, labels):
    for i, r in result(spark, "op5_quality_rules").items():
        stats = brute.statistics(texts[i]["text"])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == stats
        assert r["base_failed"] == (stats[0] < 50 or 100 * stats[4] > 50 * stats[0])
        assert not (r["base_failed"] and r["kept"])
    large = result(spark, "op5_quality_rules", f"{DATA}/sf0.01")
    judged = [(r, labels[i]) for i, r in large.items() if i in labels and not r["base_failed"]]
    assert all(r["kept"] for r, y in judged if y == 1)
    assert sum(not r["kept"] for r, y in judged if y == 0) > 0.8 * sum(y == 0 for _, y in judged)


def test_language(spark):
    folder = f"{DATA}/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    found = result(spark, "op6_language_id", folder)
    held = [i for i, r in found.items() if r["held_out"]]
    assert all(r["held_out"] == (brute.remainder(i, 4) == 2) for i, r in found.items())
    assert sum(found[i]["lang_pred"] == langs[i] for i in held) >= 0.97 * len(held)


def test_url_rules(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").collect()}
    for i, r in result(spark, "op7_url_rules", key="page_id").items():
        rest = (urls[i] or "").partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].translate(brute.FOLD), rest[cut:].split("?")[0].split("#")[0]
        fits = []
        for verdict, rule in q.URL_RULES:
            name, _, tail = rule.partition("/")
            if f".{host}".endswith(f".{name}") and path.startswith("/" + tail):
                fits.append((len(rule), rule, verdict))
        best = max(fits, default=(0, None, None))
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[1])
        assert r["verdict"] == best[2] if fits else r["verdict"] in ("allow", "block")


def test_token_counts(spark, texts):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(q.TOKENIZER))
    for i, r in result(spark, "op8_token_counts").items():
        text = texts[i]["text"] or ""
        n = len(model.encode(text))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 4096)


def test_prefix_join(spark, texts):
    sets = {i: brute.shingle_set(r["text"], 4) for i, r in texts.items()}
    plain = brute.component_of(sets, 85)
    for i, r in result(spark, "op9_prefix_join").items():
        assert (r["n_shingles"], r["component_id"]) == (len(sets[i]), plain[i])


def test_wu_manber(spark, texts):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    windows = brute.windows_of(items)
    for i, r in result(spark, "op10_wu_manber").items():
        n, hit, ids = brute.decontamination(texts[i]["text"], windows)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(ids))
        assert r["items_sha256"] == brute.sha(",".join(ids)) and r["contaminated"] == (hit > 0)


def test_pipeline(spark, texts, labels):
    """Each stage against a plain version on the rows that the stage before kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "prefix_join", "wu_manber", "secret_scans", "source_mix"]
    stages = [f for _, f in corpus_pipeline.STAGES]

    kept = stages[0](spark, docs, SMALL).cache()
    assert kept.columns == columns
    verdicts = {r["doc_id"]: r["kept"] for r in q.queries()["op5_quality_rules"](spark, SMALL).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, k in verdicts.items() if k}

    once = stages[1](spark, kept, SMALL).cache()
    assert once.columns == columns
    sets = {r["doc_id"]: brute.shingle_set(r["text"], 5) for r in kept.collect()}
    assert {r["doc_id"] for r in once.collect()} == set(brute.component_of(sets, 80).values())

    clean = stages[2](spark, once, SMALL).cache()
    assert clean.columns == columns
    windows = brute.windows_of([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()])
    assert {r["doc_id"] for r in clean.collect()} == {
        r["doc_id"] for r in once.collect() if not brute.decontamination(r["text"], windows)[1]
    }

    masked = stages[3](spark, clean, SMALL).cache()
    assert masked.columns == columns and masked.count() == clean.count()
    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in masked.collect():
        has = bool(brute.base_spans(before[r["doc_id"]]))
        assert r["text"] == before[r["doc_id"]] if not has else True

    mixed = stages[4](spark, masked, SMALL)
    assert mixed.columns == columns
    sizes = masked.select("source", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n")).groupBy("source").agg(F.sum("n"))
    total = sum(r[1] for r in sizes.collect())
    taken = sum(len(brute.WORD.findall(r["text"])) for r in mixed.collect())
    assert taken == pytest.approx(1.5 * total, rel=0.25)
    assert max(r[1] for r in mixed.groupBy("doc_id").count().collect()) <= 2
