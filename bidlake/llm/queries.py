"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bidlake.common import scratch, table
from bidlake.llm import lexical, neardup, recompress, topk, toxicity, urls
from bidlake.llm.bpe import bpe_digests
from bidlake.llm.images import embedding_image_copies
from bidlake.llm.langid import language_report
from bidlake.llm.mixing import mix_report
from bidlake.llm.repair import repair_report
from bidlake.llm.secrets import secret_report
from bidlake.llm.token_cache import token_counts


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.embedding_neighbours(table(spark, sf_dir, "embeddings"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = urls.url_verdicts(table(spark, sf_dir, "pages"), urls.rule_table(spark))
    return verdicts.select("page_id", "host", "path", "rule", "verdict")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report_tables(spark, sf_dir)


def op7_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given tables hold no images, so each embedding is drawn as one."""
    return embedding_image_copies(table(spark, sf_dir, "embeddings"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), neardup.NearDup(width=3, percent=85))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so that each run encodes every distinct text."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "token-cache"), keep=["doc_id"])


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(table(spark, sf_dir, "conversations"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.dedup_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_top_k": op1_top_k,
        "op2_bpe": op2_bpe,
        "op3_secrets": op3_secrets,
        "op4_url_filters": op4_url_filters,
        "op5_language_id": op5_language_id,
        "op6_toxicity": op6_toxicity,
        "op7_image_copies": op7_image_copies,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_mixing": op9_mixing,
        "op10_token_counts": op10_token_counts,
        "op11_repair": op11_repair,
        "op12_lexical_search": op12_lexical_search,
        "op13_substring_dedup": op13_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_top_k": topk.ORACLE_SQL,
        "op4_url_filters": urls.ORACLE_SQL,
        "op8_near_duplicates": neardup.ORACLE_SQL,
        "op12_lexical_search": lexical.ORACLE_SQL,
        "op13_substring_dedup": recompress.ORACLE_SQL,
    }
