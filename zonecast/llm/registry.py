"""Queries of the corpus operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from zonecast.llm import (
    alignment, conversations, decontaminate, html_text, language, licenses, near_dup, oracle, packing, quality_cnn, quality_rules,
    substring_dedup, token_files, toxicity,
)
from zonecast.llm.common import crc_fold, table
from zonecast.session import materialize


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_fold("doc_id", 4, 2)
    return language.identify(docs.select("doc_id", held.alias("held_out"), "text"), docs.filter(~held).select("lang", "text"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


#: Ids that end a document, in packed sequences and in token files.
PACK_END, FILE_END = 1, 2


def vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), PACK_END)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = token_files.write(table(spark, sf_dir, "documents"), vocabulary(), FILE_END)
    return token_files.read(spark, folder, manifest).drop("ids")


def op8_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = crc_fold("doc_id", 5, 0)
    model = quality_cnn.learn(docs, labels, ~held)
    return quality_cnn.score(docs.select("doc_id", held.alias("held_out"), "text"), model)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_docs",
        "host_failed", "host_rejected", "kept",
    )


def host_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hosts' part of the quality rules where hosts differ much: each source by length of document."""
    docs = table(spark, sf_dir, "documents")
    stats = quality_rules.document_stats(docs.select("text", quality_rules.by_length(docs).alias("host"))).drop("text")
    return quality_rules.host_verdicts(quality_rules.host_counts(materialize(stats, "quality")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = crc_fold("doc_id", 4, 2)
    model = toxicity.learn(docs, labels, ~held)
    return toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), model)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"))


def op12_cross_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte_level, pieces = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.cross_alignment(table(spark, sf_dir, "documents"), byte_level, pieces)


def op13_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_language": op3_language,
    "op4_licenses": op4_licenses,
    "op5_near_dup": op5_near_dup,
    "op6_pack": op6_pack,
    "op7_token_files": op7_token_files,
    "op8_quality_cnn": op8_quality_cnn,
    "op9_quality_rules": op9_quality_rules,
    "host_verdicts": host_verdicts,
    "op10_toxicity": op10_toxicity,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_cross_alignment": op12_cross_alignment,
    "op13_html_text": op13_html_text,
}

SQL: dict[str, str] = {
    "op2_decontaminate": oracle.CONTAMINATION,
    "op4_licenses": oracle.licenses(licenses.TEMPLATES, licenses.THRESHOLD),
    "op9_quality_rules": oracle.QUALITY_RULES,
    "host_verdicts": oracle.HOST_VERDICTS,
}
