"""Registered queries of the operators in this folder, each over its whole table, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardline.llm import alignment, chat, decontam, hamming, langid, lm, mixing, permutations, quality, simhash, substrings, variants, warc
from wardline.llm.common import prepare

QueryFn = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op2_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.format_chats(table(spark, folder, "conversations"))


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.document_scores(table(spark, folder, "documents"))


def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.language_of_documents(table(spark, folder, "documents"))


def op8_hamming_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return hamming.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.span_rows(table(spark, folder, "documents"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.token_alignments(table(spark, folder, "documents"))


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.spelling_variants(table(spark, folder, "documents"))


def op13_permutation_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return permutations.top_k(rows, rows.filter("vec_id % 100 = 0"))


QUERIES: dict[str, QueryFn] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_warc": op5_warc,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_hamming_top_k": op8_hamming_top_k,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_mixing": op10_mixing,
    "op11_token_alignment": op11_token_alignment,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_permutation_search": op13_permutation_search,
}

ORACLES: dict[str, str] = {
    "op2_chat_formatting": chat.ORACLE,
    "op5_warc": warc.ORACLE,
    "op8_hamming_top_k": hamming.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op12_spelling_variants": variants.ORACLE,
}
