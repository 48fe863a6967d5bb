"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from verdigris.llm import bpe, chat, edit_fingerprint, fill_in_middle, packing, page_template
from verdigris.llm import prefix_trie, quality_classifier, quality_rules, sharding, simhash, substring, suffix_dedup
from verdigris.llm.common import table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.document_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.document_fingerprints(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(table(spark, sf_dir, "documents"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removals(table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(spark, sf_dir)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trips(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents"))


def op10_page_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_template.extracted(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.document_forms(table(spark, sf_dir, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.document_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_simhash,
        op3_edit_fingerprint,
        op4_sharding,
        op5_substring,
        op6_chat,
        op7_bpe,
        op8_packing,
        op9_quality_rules,
        op10_page_template,
        op11_prefix_trie,
        op12_fill_in_middle,
        op13_suffix_dedup,
    )
}
ORACLES: dict[str, str] = {
    "op5_substring": substring.SQL,
    "op6_chat": chat.SQL,
    "op9_quality_rules": quality_rules.SQL,
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_fill_in_middle": fill_in_middle.SQL,
    "op13_suffix_dedup": suffix_dedup.SQL,
}
