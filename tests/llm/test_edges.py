"""Nulls, empty and long texts, ties, repeated rows, empty tables and other columns of clashing names."""

from __future__ import annotations

import random
import re

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from tallybook.llm import (
    class_lm,
    components,
    factorization,
    language,
    mixing,
    prefix_join,
    quality_rules,
    secret_scan,
    token_counts,
    url_rules,
    words,
    wu_manber,
)

CLASHING = ["n_words", "score", "size", "hash", "kept", "row", "token", "n"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
LONG = " ".join(f"word{i % 7919}" for i in range(40_000))
BENCH = "Benchmark words one two three four five six seven eight nine ten eleven"
KEY = "password = 'abcDEF1234567890'"


def texts() -> list[tuple]:
    same = "the same text stands here twice or more often " * 3
    cases = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b ", None, None), (4, LONG, "en", "a"), (5, same, "de", "b"), (5, same, "de", "b"),
        (6, same, None, "b"), (None, "text without an id", "en", None), (None, None, None, None), (7, f"ä {BENCH} ß {KEY}", "de", "b"),
        (8, "a\u2581b  c \u00a0 d\n\n\ne 123 !!! ", "en", "a"), (9, "AKIA" + "B" * 20 + " deadbeef" * 3 + " 0123456789abcdef0 token=token= abcdefghijklmn", "fr", "a"),
        (10, "\U0001f600 " + "x" * 3000, "fr", "c"), (11, "...", "en", "c"),
    ]
    return [(*c, len(c[1] or ""), *["x"] * len(CLASHING)) for c in cases]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_text(df, *columns):
    return sorted(([r[c] for c in columns] for r in df.collect()), key=str)


def test_words_follow_the_pattern():
    some = [t[1] for t in texts()] + ["A b\x1fC\x85d", "Ünï-cödé x9Y"]
    for kind, pattern in ((words.NOT_SPACE, brute.WORD), (words.ALNUM, brute.PLAIN)):
        for first, end, raw, offsets in words.chunks(pa.array(some), 64):
            codes, bounds = words.word_codes(raw, offsets, kind)
            for i in range(first, end):
                mine = codes[bounds[i - first] : bounds[i - first + 1]].tolist()
                plain = pattern.findall((some[i] or "").translate(brute.FOLD))
                assert len(mine) == len(plain) and len(set(zip(mine, plain, strict=True))) == len(set(mine)) == len(set(plain))


def test_secret_scan(docs, nothing):
    rows = secret_scan.report(secret_scan.scan(docs)).collect()
    plain = sorted((str(t[0]), brute.sha(brute.listed(brute.base_spans(t[1])))) for t in texts())
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in rows) == plain
    assert secret_scan.report(secret_scan.scan(nothing)).count() == 0


def test_copied_and_owned_secrets(spark):
    copied, owned, example = "Zz9" + "kQ3" * 9, "Yy8" + "pL4" * 9, "0123456789abcdef0123"
    rows = [(i, f"see {copied} and {example}", "en", f"s{i}") for i in range(9)] + [(10, f"own {owned} é {KEY} end", "en", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r["doc_id"]: r for r in secret_scan.report(secret_scan.scan(docs)).collect()}
    assert found[0]["spans"] == "hex:39:59" and found[0]["n_live"] == 0
    assert [s.split(":")[0] for s in found[10]["spans"].split(",")] == ["owned", "assign"] and found[10]["n_live"] == 2
    masked = {r["doc_id"]: r["text"] for r in secret_scan.masked(docs).collect()}
    assert masked[0] == rows[0][1] and masked[10] == "own [SECRET] é [SECRET]' end"


def test_mixing(docs, nothing):
    plan = mixing.mixing_plan(docs).collect()
    assert len(plan) == len(texts()) and all(0 <= r["copies"] <= 2 for r in plan)
    assert len({r["copies"] for r in plan if r["doc_id"] == 5}) == 1
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mixing_plan(nothing).count() == mixing.mix(nothing).count() == 0
    # ranks do not depend on how finely they are counted
    fine = mixing.mixing_plan(docs, slice_size=1)
    assert by_text(fine, "unit", "copies") == sorted(([r["unit"], r["copies"]] for r in plan), key=str)


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 985)], "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.targets(sizes, 0.5, (5, 2, 1)).collect()}
    # a and c fill up at 20 and 10; b and null share the remaining 970 as 2 to 5
    assert found["a"] == 20 and found["c"] == 10
    assert found["b"] == pytest.approx(970 * 2 / 7) and found[None] == pytest.approx(970 * 5 / 7)


def test_quality_rules(docs, nothing):
    rows = quality_rules.judged(docs).collect()
    assert sorted((str(r["doc_id"]), *[r[c] for c in quality_rules.STATS]) for r in rows) == sorted(
        (str(t[0]), *brute.statistics(t[1])) for t in texts()
    )
    assert quality_rules.passing(docs).columns == docs.columns
    assert quality_rules.judged(nothing).count() == quality_rules.passing(nothing).count() == 0


def test_outliers_are_rejected_and_constant_statistics_keep(spark):
    rng = random.Random(5)
    plain = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(n))
    rows = [(i, plain(rng.randint(60, 400)), "en", "s") for i in range(120)]
    rows += [(1000 + i, re.sub(" ", " | ", plain(150)), "en", "s") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r["doc_id"] for r in quality_rules.judged(docs).where("NOT kept").collect()} == set(range(1000, 1010))


@pytest.mark.parametrize("copied", [True, False])
def test_a_third_of_junk_does_not_pass_for_its_group(spark, copied):
    rng = random.Random(7)
    plain = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(n))
    junk = lambda n: re.sub(" ", " | ", plain(n))
    one = junk(150)
    rows = [(i, plain(rng.randint(60, 400)), "en", "s") for i in range(120)]
    rows += [(1000 + i, one if copied else junk(rng.randint(60, 400)), "en", "s") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = quality_rules.judged(docs).where("NOT base_failed").collect()
    assert len(found) == 180
    assert {r["doc_id"] for r in found if not r["kept"]} == {r["doc_id"] for r in found if r["doc_id"] >= 1000}


def test_mostly_duplicate_lines_are_rejected(spark):
    rng = random.Random(9)
    plain = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(n))
    rows = [(i, plain(rng.randint(60, 400)), "en", "s") for i in range(120)]
    for i in range(4):
        lines = plain(30).split() * 5
        rng.shuffle(lines)
        rows.append((1000 + i, "\n".join(lines), "en", "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = quality_rules.judged(docs).collect()
    assert not any(r["base_failed"] for r in found)
    assert {r["doc_id"] for r in found if not r["kept"]} == set(range(1000, 1004))


def test_junk_of_small_sources_and_languages_is_tested(spark):
    rng = random.Random(3)
    plain = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(n))
    rows = [(i, plain(rng.randint(60, 400)), "en", "hot") for i in range(120)]
    tail = [("en", "a"), ("en", "b"), ("en", None), ("fr", "c"), (None, None)]
    rows += [(200 + 10 * i + j, plain(rng.randint(80, 300)), *of) for i, of in enumerate(tail) for j in range(3)]
    rows += [(1000 + i, re.sub(" ", " | ", plain(150)), *of) for i, of in enumerate(tail)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {r["doc_id"] for r in quality_rules.judged(docs).where("NOT kept").collect()} == set(range(1000, 1005))


def test_token_counts(docs, nothing):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = token_counts.count_tokens(docs, path).collect()
    plain = sorted((str(t[0]), len((t[1] or "").encode()), len(model.encode(t[1] or ""))) for t in texts())
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in rows) == plain
    assert token_counts.count_tokens(nothing, path).count() == 0
    # the table only saves time
    assert by_text(token_counts.count_tokens(docs, path, sample_docs=1), "doc_id", "n_tokens") == sorted(
        ([r["doc_id"], r["n_tokens"]] for r in rows), key=str
    )


@pytest.mark.parametrize("limit", [400_000, 5])
def test_wu_manber(spark, docs, nothing, limit):
    items = [(1, BENCH), (2, "same text"), (3, None), (None, "deadbeef"), (4, "!!"), (5, BENCH.upper()), (6, "text"), (6, "text")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = brute.windows_of([i for i in items if i[0] is not None])
    everything = brute.windows_of(items)
    found = wu_manber.search(docs, bench, max_patterns=limit).collect()
    mine = sorted((str(r["doc_id"]), r["__hits"]["n_words"], r["__hits"]["n_hit"], r["__hits"]["items"]) for r in found)
    plain = []
    for t in texts():
        n, hit, _ = brute.decontamination(t[1], everything)
        plain.append((str(t[0]), n, hit, brute.decontamination(t[1], windows)[2]))
    assert mine == sorted(plain)
    assert wu_manber.search(nothing, bench).count() == 0
    assert wu_manber.decontaminated(docs, bench.limit(0)).count() == len(texts())


def test_prefix_join(docs, nothing):
    rows = prefix_join.linked(docs).collect()
    assert len(rows) == len(texts())
    found = {r["id"]: r["component_id"] for r in rows if r["id"] is not None}
    assert found == {**{i: i for i in found}, 6: 5}
    assert prefix_join.linked(nothing).count() == 0
    kept = prefix_join.unique(docs)
    assert kept.columns == docs.columns
    assert sum(r["doc_id"] == 5 for r in kept.collect()) == 1 and not any(r["doc_id"] == 6 for r in kept.collect())
    assert sum(not (r["text"] or "").split() for r in kept.collect()) == sum(not (t[1] or "").split() for t in texts())


def test_prefix_join_on_hot_groups(spark):
    """A group of near copies whose links form chains, many exact copies, and a passage that half of the texts share."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base, passage = [word() for _ in range(90)], [word() for _ in range(12)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(90)] = word()
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(base)) for i in range(300, 340)]
    rows += [(i, " ".join([word() for _ in range(40)] + passage)) for i in range(400, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    plain = brute.component_of({i: brute.shingle_set(t, 4) for i, t in rows}, 85)
    for rounds in (0, 3):
        found = {r["id"]: r["component_id"] for r in prefix_join.linked(docs, rounds=rounds).collect()}
        assert found == plain


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def test_language(docs, nothing):
    model = language.fitted(language.sample_of(docs, "doc_id", "text", "lang", 100))
    rows = language.predicted(docs.select("doc_id", "text"), model).collect()
    assert len(rows) == len(texts()) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3, 11)} == {"und"}
    none = language.fitted(language.sample_of(nothing, "doc_id", "text", "lang", 100))
    assert {r["lang_pred"] for r in language.predicted(docs.select("text"), none).collect()} == {"und"}
    assert language.predicted(nothing.select("doc_id", "text"), model).count() == 0


def test_kernel_is_the_share_of_common_ngrams():
    some = ["abcab", "abc", "zz", ""]
    for _, _, raw, offsets in words.chunks(pa.array(some)):
        for _, flags in language.presence(raw, offsets):
            k = language.kernel(flags, flags)
    grams = [{s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1)} for s in some]
    for i in range(3):
        for j in range(3):
            assert k[i, j] == pytest.approx(len(grams[i] & grams[j]) / np.sqrt(len(grams[i]) * len(grams[j])), abs=1e-6)


def test_factorization(spark, docs, nothing):
    labels = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (None, 1), (7, None)], "doc_id long, quality int")
    for given in (labels, labels.limit(0)):
        model = factorization.fitted(docs, given, metadata=("n_chars",))
        rows = factorization.scored(docs.select("doc_id", "text", "n_chars"), model, metadata=("n_chars",)).collect()
        assert len(rows) == len(texts()) and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows} == {0.5}
    assert factorization.scored(nothing.select("doc_id", "text"), model).count() == 0


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    model = {"b": 0.3, "w": rng.normal(size=20), "v": rng.normal(size=(20, factorization.RANK))}
    row, feature, value = np.array([0, 0, 0, 1, 1]), np.array([1, 4, 7, 2, 19]), rng.normal(size=5)
    found = factorization.scores(model, row, feature, value, 2)
    for r in range(2):
        at = np.flatnonzero(row == r)
        pairs = sum(model["v"][feature[i]] @ model["v"][feature[j]] * value[i] * value[j] for i in at for j in at if i < j)
        assert found[r] == pytest.approx(model["b"] + model["w"][feature[at]] @ value[at] + pairs)


def test_class_lm(docs, nothing):
    scored = class_lm.scored(docs, docs)
    rows = scored.collect()
    assert len(rows) == len(texts()) and all(r["score"] < 0 for r in rows)
    assert {(r["n_tokens"], r["n_known"]) for r in rows if r["doc_id"] in (1, 2, 3)} == {(1, 1)}
    alone = class_lm.scored(docs, nothing).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == pytest.approx(0, abs=1e-6) for r in alone)
    assert class_lm.scored(nothing, docs).count() == 0


def test_exchange_finds_alternating_classes():
    pairs = np.zeros((9, 9))
    pairs[1:5, 5:9] = np.arange(1, 17).reshape(4, 4) ** 2
    pairs[5:9, 1:5] = pairs[1:5, 5:9].T
    own = class_lm.exchange(pairs, classes=3)
    assert own[0] == 0 and len(set(own[1:5])) == len(set(own[5:9])) == 1 and own[1] != own[5]


def test_repeated_rows_are_mixed_one_by_one(spark):
    same = [(7, "ten words in a text that stands here many times", "b", i % 2) for i in range(300)]
    other = [(100 + i, "some words " * (1 + i % 40), "b", 0) for i in range(400)] + [(1000 + i, "x y z", "a", 0) for i in range(50)]
    docs = spark.createDataFrame(same + other, "doc_id long, text string, source string, n int").repartition(7)
    plan = mixing.mixing_plan(docs).collect()
    mixed = mixing.mix(docs).collect()
    for source in "ab":
        own = [r for r in plan if r["source"] == source]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        assert sum(r["size"] * r["copies"] for r in own) == sum(len(r["text"].split()) for r in mixed if r["source"] == source)
    assert sorted(r["nth"] for r in plan if r["doc_id"] == 7) == list(range(300))
    assert sorted(mixed) == sorted(mixing.mix(docs.repartition(3)).collect())


def test_url_rules(spark):
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "bad.com/")]
    urls = [
        None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?q=1#f", "http://example.org", "http://xexample.org/es/", "http://m.bad.com/de/1",
        "http://m.bad.com/de/1", "http://new.com/de/2", "http://Ä.com:80/p?a=b&c", "x://y.org/z://k",
    ]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rows = {r["page_id"]: r for r in url_rules.judged(pages, rules, min_count=1, min_confidence=0.5, z=0).collect()}
    assert [(rows[i]["host"], rows[i]["path"]) for i in range(4)] == [("", "")] * 4
    assert (rows[4]["host"], rows[4]["path"], rows[4]["rule"], rows[4]["verdict"]) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert rows[5]["rule"] is None and rows[6]["rule"] == "org/" and rows[7]["verdict"] == "block"
    assert rows[9]["rule"] is None and rows[9]["verdict"] == "block" and "path:de" in rows[9]["mined_rule"]
    assert url_rules.judged(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_rules.judged(pages, []).collect()} == {"allow"}


def test_mined_rules_against_all_subsets(spark):
    from itertools import combinations

    rng = random.Random(2)
    rows = [(sorted(rng.sample(["a", "b", "c", "d", "e"], rng.randint(1, 4))), rng.choice(["allow", "block"])) for _ in range(60)]
    found = url_rules.mined_rules(spark.createDataFrame(rows, "tokens array<string>, label string"), 6, 0.5, z=0).collect()
    plain = {}
    for size in range(1, 5):
        for some in combinations("abcde", size):
            held = [y for t, y in rows if set(some) <= set(t)]
            for label in ("allow", "block"):
                if held and held.count(label) >= 6 and held.count(label) / len(held) >= 0.5:
                    plain[(some, label)] = held.count(label) / len(held)
    assert {(tuple(r["antecedent"]), r["label"]): pytest.approx(r["confidence"]) for r in found} == plain


def test_verdicts_of_mined_rules_against_all_subsets(spark):
    """Merged items decide as all rules on all subsets of tokens would, also for URLs that have only some of the merged tokens."""
    from itertools import combinations
    from math import sqrt

    rng = random.Random(5)
    pages = []
    for i in range(260):
        host = rng.choice(["a.good.com", "b.bad.com", "b.mixed.com", "c.new.net", "c.other.net"])
        path = rng.choice(["/x/1", "/x/2/y", "/77/z", "/"])
        query = rng.choice(["", "?p=1&q=2&r=3", "?p=1&q=2&r=3&s=4"] if "com" in host else ["", "?p=1", "?q=2&s=4", "?r=1&t=1"])
        pages.append((i, f"http://{host}{path}{query}"))
    listed = [("allow", "good.com/"), ("block", "bad.com/"), ("block", "mixed.com/x/"), ("allow", "mixed.com/")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    found = {r["page_id"]: r for r in url_rules.judged(df, listed, min_count=12, min_confidence=0.55, z=1.0).collect()}

    def tokens_of(url):
        host, _, rest = url.partition("://")[2].partition("/")
        path, _, query = rest.partition("?")
        names = {f"query:{x.split('=')[0]}" for x in query.split("&") if x}
        return {f"host:{x}" for x in host.split(".")} | {f"path:{x}" for x in path.split("/") if x} | names

    labelled = [(tokens_of(u), found[i]["verdict"]) for i, u in pages if found[i]["rule"]]
    counts: dict = {}
    for held, label in labelled:
        for size in range(1, len(held) + 1):
            for some in combinations(sorted(held), size):
                counts.setdefault(some, []).append(label)
    rules = []
    for some, labels in counts.items():
        for label in ("allow", "block"):
            k, n = labels.count(label), len(labels)
            p = k / n
            low = (p + 1 / (2 * n) - sqrt(p * (1 - p) / n + 1 / (4 * n * n))) / (1 + 1 / n)
            if k >= 12 and low >= 0.55:
                rules.append((round(low, 12), k, label, set(some)))
    decided = 0
    for i, url in pages:
        if found[i]["rule"] is None:
            fits = [r[:3] for r in rules if r[3] <= tokens_of(url)]
            assert found[i]["verdict"] == (max(fits)[2] if fits else "allow")
            assert (found[i]["mined_rule"] is None) == (not fits)
            decided += bool(fits)
    assert decided > 20


def test_parameters_that_always_come_together_are_one_item(spark):
    query = "&".join(f"name{i}=1" for i in range(25))
    urls = [(i, f"http://h{i % 3}.example.com/{'de' if i % 2 else 'fr'}/{i}?{query}") for i in range(600)]
    urls += [(1000, "http://else.net/a?name7=1"), (1001, "http://else.net/de")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    rows = {r["page_id"]: r for r in url_rules.judged(pages, [("allow", "example.com/fr/"), ("block", "example.com/de/")]).collect()}
    assert rows[1001]["verdict"] == "block" and rows[1001]["mined_rule"] == "path:de"
    assert rows[1000]["verdict"] == "allow" and rows[1000]["mined_rule"] is None
