"""Queries over whole tables for each operator of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelmill.llm import align, bpe, chat, licenses, line_dedup, mixing, pii, quality, simhash, spelling, suffix_dedup, topk, urls
from reelmill.llm._shared import table


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(chat.with_probe(table(spark, sf_dir, "conversations")))


def op3_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, listed=urls.listed_hosts(pages))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"))


def op8_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.report(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.report(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_pii_spans": op1_pii_spans,
        "op2_chat_format": op2_chat_format,
        "op3_license_rules": op3_license_rules,
        "op4_source_mix": op4_source_mix,
        "op5_url_filter": op5_url_filter,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_line_dedup": op7_line_dedup,
        "op8_quality_bands": op8_quality_bands,
        "op9_simhash": op9_simhash,
        "op10_top_k": op10_top_k,
        "op11_suffix_dedup": op11_suffix_dedup,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_format": chat.ORACLE_SQL,
        "op3_license_rules": licenses.oracle_sql(),
        "op4_source_mix": mixing.ORACLE_SQL,
        "op5_url_filter": urls.ORACLE_SQL,
        "op7_line_dedup": line_dedup.ORACLE_SQL,
        "op10_top_k": topk.ORACLE_SQL,
    }
