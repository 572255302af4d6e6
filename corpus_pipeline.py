"""A training corpus from ``documents``: toxicity, near-duplicates, secrets, mixing, token ids.

Each stage takes all that its predecessor kept. All stages but the last return the columns of
``documents``: toxic documents are gone after the first, copies after the second, secrets are masked by the
third, and after the fourth a document stands as often as the mix uses it.

Defined results of every stage: an empty table gives an empty table; columns besides id, text, source and
n_chars are carried along; no stage fails on a null in any column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.common import materialize, table
from bidlake.llm.bpe import bpe_round_trip
from bidlake.llm.mixing import mixed_rows
from bidlake.llm.neardup import NearDup, keep_one_of_each
from bidlake.llm.secrets import redact
from bidlake.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of the documents it is given and drops the documents it rejects.

    A null or empty text, or a document without id, is judged as any other and stays unless rejected.
    """
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike to 0.8 or more in five-word shingles, the one with the least id stays.

    Texts without words and rows without id stay; of repeated rows one stays.
    """
    return keep_one_of_each(docs, NearDup(width=5, percent=80))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret; ``n_chars`` follows where a text changed. A null text stays null."""
    masked = redact(docs.withColumn("_was", F.length("text")))
    return masked.withColumn("n_chars", F.when(F.length("text") != F.col("_was"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out or repeats documents so that each source has its target number of words.

    A null source is a source. A document without words takes nothing of any target and is left out.
    """
    return mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; the digest of the bytes they decode to shows the round trip. A null text counts as empty."""
    return bpe_round_trip(docs, "text", ["doc_id", "source"]).select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_copies),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

# Learned weights, signatures and byte-pair merges are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
