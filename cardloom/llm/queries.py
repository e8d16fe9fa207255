"""Registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from cardloom.llm import chaining, classlm, crossparse, decontaminate, divergence, mixing, pii, prefixtrie, quality
from cardloom.llm import sharding, simhash, substrings, urls

QUERIES, ORACLES = {}, {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


def _read(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op5_golden_mix(spark, folder):
    return mixing.mix_digest(_read(spark, folder, "documents"))


@_query
def op6_repetition_quality(spark, folder):
    report = quality.repetition_report(_read(spark, folder, "documents"))
    return report.drop("dup_line_chars", "dup_gram_chars")


@_query
def op7_url_vocabulary(spark, folder):
    return urls.judge_urls(_read(spark, folder, "pages")).drop("strict_hits", "soft_hits", "soft_weight")


@_query
def op8_bounded_ring(spark, folder):
    return sharding.shard_documents(_read(spark, folder, "documents"))


ORACLES["op5_golden_mix"] = mixing.MIX_SQL
ORACLES["op7_url_vocabulary"] = urls.judge_sql()


@_query
def op3_golay_simhash(spark, folder):
    return simhash.simhash_components(_read(spark, folder, "documents"))


@_query
def op10_winnowing(spark, folder):
    found = decontaminate.contamination(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
    return found.drop("text_key")


@_query
def op4_suffix_levels(spark, folder):
    return substrings.substring_report(_read(spark, folder, "documents"))


@_query
def op2_class_ngrams(spark, folder):
    return classlm.class_scores(_read(spark, folder, "documents"))


@_query
def op1_skip_chain_pii(spark, folder):
    return pii.personal_data(_read(spark, folder, "documents"))


@_query
def op9_chained_passages(spark, folder):
    return chaining.fuzzy_passages(_read(spark, folder, "documents"))


@_query
def op11_z_fast_trie(spark, folder):
    return prefixtrie.conversation_trie(_read(spark, folder, "conversations"))


@_query
def op12_cross_parsing(spark, folder):
    return crossparse.languages_of(_read(spark, folder, "documents"))


@_query
def op13_chunk_divergence(spark, folder):
    return divergence.divergence_audit(_read(spark, folder, "documents"))


ORACLES["op13_chunk_divergence"] = divergence.AUDIT_SQL
