"""One query per operator, over whole tables, and the SQL that a second engine can run for it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import (
    class_lm,
    collocations,
    factorization,
    importance,
    language,
    mixing,
    prefix_join,
    quality_rules,
    secret_scan,
    token_counts,
    token_files,
    url_rules,
    wu_manber,
)
from tallybook.llm.oracles import ORACLES
from tallybook.sources.scratch import new_folder, stored_once

TOKENIZER = "piece_bpe_32k.model"
OUTPUT_TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 4096
#: Verdict and rule of the listed URL rules.
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, a null id as empty text."""
    code = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return (code % modulus == remainder).alias("held_out")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixing_plan(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(~held_out(3, 1))
    model = factorization.fitted(docs, labels, metadata=("n_chars",))
    scored = factorization.scored(docs, model, metadata=("n_chars",))
    return scored.select("doc_id", held_out(3, 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = class_lm.scored(docs, docs.where(~held_out(5, 1)))
    return scored.select("doc_id", held_out(5, 1), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judged(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return found.select("doc_id", *quality_rules.STATS, "base_failed", "kept", "distance")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    sample = language.sample_of(docs.where(~held_out(4, 2)), "doc_id", "text", "lang", language.SAMPLE)
    scored = language.predicted(docs.select("doc_id", "text"), language.fitted(sample))
    return scored.select("doc_id", held_out(4, 2), "lang_pred", "score")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path(TOKENIZER))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op9_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prefix_join.linked(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op10_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wu_manber.search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    items = F.col("__hits.items")
    return found.select(
        "doc_id",
        "__hits.n_words",
        F.col("__hits.n_hit").cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("__hits.n_hit") > 0).alias("contaminated"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents", "lang", "text"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(OUTPUT_TOKENIZER), path)
    read = token_files.documents(spark, path).select("key", "part", "at", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    placed = token_files.with_starts(stored_once(read, "tokens-read"))
    return placed.select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text")
    return importance.resampled(docs, target).select(F.col("key").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_source_mix": op2_source_mix,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_class_lm": op4_class_lm,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_url_rules": op7_url_rules,
    "op8_token_counts": op8_token_counts,
    "op9_prefix_join": op9_prefix_join,
    "op10_wu_manber": op10_wu_manber,
    "op11_collocations": op11_collocations,
    "op12_token_files": op12_token_files,
    "op13_importance": op13_importance,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
