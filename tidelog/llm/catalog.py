"""The ten registered operator queries and the pipeline, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_dedup, html_text, labelled, lm_scoring, mixing, ngram_join, pipeline, quality_classifier, quality_rules, suffix_dedup, toxicity

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), 7, 2)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = quality_classifier.train(docs, labels, "quality", 5, 0)
    scored = quality_classifier.score(docs, model, ["doc_id"])
    return scored.select("doc_id", labelled.held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_read(spark, sf_dir, "pages"), ["page_id", "url"])


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE)
    return bpe.digests(docs, path, bpe.compile_lexicon(docs, path), ["doc_id"])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_read(spark, sf_dir, "documents"), ["doc_id"], 100)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_read(spark, sf_dir, "documents"), 5, 0.8)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels, "toxic", 4, 2), ["doc_id"])
    return scored.select("doc_id", labelled.held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(_read(spark, sf_dir, "embeddings"), 0.98)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    rules = quality_rules.train(docs, labels)
    judged = quality_rules.apply(docs, rules, ["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict:
    every = (op1_mix_sources, op2_lm_score, op3_quality_classifier, op4_html_text, op5_bpe, op6_suffix_dedup, op7_ngram_join, op8_toxicity, op9_embedding_dedup, op10_quality_rules)
    return {f.__name__: f for f in every} | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    made = {"op1_mix_sources": mixing.SQL, "op6_suffix_dedup": suffix_dedup.SQL, "op7_ngram_join": ngram_join.SQL, "op9_embedding_dedup": embedding_dedup.SQL}
    return made | ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})
