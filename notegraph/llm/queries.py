"""Registered queries of the subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from notegraph.llm import bytecnn, decontaminate, lblm, minhash, mixing, oracles, paragraphs, pii, prefixes, quality_rules, runs, secrets, tokenbits, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(_read(spark, sf_dir, "documents"))


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.label_domains(_read(spark, sf_dir, "labels"))
    return mixing.mix(_read(spark, sf_dir, "documents"), labelled, mixing.TARGETS, carry=["doc_id"])


def op4_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_read(spark, sf_dir, "documents"))


def op5_fuzzy_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated_paragraphs(_read(spark, sf_dir, "documents"))


def op7_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytecnn.digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_min_max_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(_read(spark, sf_dir, "documents"))


def op10_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lblm.lm_scores(_read(spark, sf_dir, "documents"))


def op11_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbits.digest(_read(spark, sf_dir, "documents"), tokenbits.Spec(public_tokenizers.path("word_bpe_49k.json")))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(_read(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.digest(_read(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": pipeline,
    "op1_template_decontamination": op1_template_decontamination,
    "op2_secret_forest": op2_secret_forest,
    "op3_soft_mixing": op3_soft_mixing,
    "op4_boosted_pii": op4_boosted_pii,
    "op5_fuzzy_toxicity": op5_fuzzy_toxicity,
    "op6_paragraph_dedup": op6_paragraph_dedup,
    "op7_byte_cnn": op7_byte_cnn,
    "op8_min_max_dedup": op8_min_max_dedup,
    "op9_line_rules": op9_line_rules,
    "op10_log_bilinear": op10_log_bilinear,
    "op11_huffman_ids": op11_huffman_ids,
    "op12_word_runs": op12_word_runs,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES: dict[str, str] = {"op8_min_max_dedup": oracles.NEAR_DUPLICATES, "op9_line_rules": oracles.LINE_RULES, "op12_word_runs": oracles.WORD_RUNS, "op13_prefix_trie": oracles.PREFIX_TRIE}
