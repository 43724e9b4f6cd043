"""Registered queries of the pipeline operators, with production parameters over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelmill.llm import bloom_lm, dart, lexical, merkle, mixing, packing, repair, spans, srs, thresholds, toxicity, transducer, url_rules
from panelmill.llm.storage import read

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: Rules of op11: verdict, host and path.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_repair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.token_files(read(spark, sf_dir, "documents"), WORD_BPE, end=2)


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.report(read(spark, sf_dir, "documents"))


def op3_risk_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(read(spark, sf_dir, "documents"))


def op5_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.count_tokens(read(spark, sf_dir, "documents"), BYTE_BPE, limit=1024)


def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), BYTE_BPE, end=0, size=2048)


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart.classes(read(spark, sf_dir, "documents"))


def op9_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.selection(read(spark, sf_dir, "documents"))


def op10_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srs.nearest(read(spark, sf_dir, "embeddings"), "embedding", every=20, k=20)


def op11_range_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read(spark, sf_dir, "pages"), url_rules.rules_of(spark, URL_RULES))


def op12_nested_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verification(read(spark, sf_dir, "documents"))


def op13_automaton_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_repair_files, op2_sentence_spans, op3_risk_thresholds, op4_bloom_lm, op5_subword_toxicity, op6_transducer_counts, op7_vector_packing,
        op8_dart_minhash, op9_hierarchical_mix, op10_stable_projections, op11_range_rules, op12_nested_manifest, op13_automaton_search,
    )
}
ORACLES: dict[str, str] = {"op9_hierarchical_mix": mixing.sql(), "op11_range_rules": url_rules.sql(URL_RULES), "op12_nested_manifest": merkle.sql(), "op13_automaton_search": lexical.sql()}
