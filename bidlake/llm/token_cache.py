"""Token counts behind a digest cache.

A document's key is the digest of its content together with the digest of the tokenizer file. Keys are
joined with the stored counts; one text of each missing key is encoded; the new counts are appended to
the cache, and every document then takes its count from the cache by an equi-join. The content goes into
the digest as it stands, for a byte-level tokenizer every byte counts.

Cache: a Parquet folder (tokenizer, digest, n_tokens) that all executors can reach; a folder that is not
there yet is an empty cache. An append that ran twice does no harm: keys are made distinct on reading.

Defined results: a null text counts as empty (0 bytes, no tokens); repeated rows and equal texts are
encoded once and each get the count; columns not in ``keep`` are left out; an empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.common import small_batches
from bidlake.llm.bpe import PieceCache, encode_texts, slices
from bidlake.llm.textclass import chunks

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
CHUNK_CHARS = 1_000_000


@lru_cache(maxsize=8)
def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def splits_by_gpt_pattern(spec: dict) -> bool:
    """Whether a tokenizer encodes each match of the byte-level pattern on its own and changes no text."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    return (
        pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space", True)
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and spec.get("normalizer") is None
    )


class Counter:
    """Counts the tokens of texts as the tokenizer's own library does."""

    def __init__(self, path: str):
        self.path, self.pieces, self.special = path, None, []
        if path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            self.library.no_truncation()
            self.library.no_padding()
            with open(path, encoding="utf-8") as file:
                spec = json.load(file)
            self.special = [t["content"] for t in spec.get("added_tokens") or []]
            if splits_by_gpt_pattern(spec):
                self.pieces = PieceCache(self._count_pieces)
        elif path.endswith(".model"):
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def _library_counts(self, texts: list[str]) -> np.ndarray:
        encoded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return np.fromiter(map(len, encoded), dtype=np.int64, count=len(texts))

    def _count_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(0, np.int32), self._library_counts([p.decode() for p in pieces])

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.path.endswith(".tiktoken"):
            return encode_texts(texts, self.path)[1]
        if self.path.endswith(".model"):
            return np.array([len(ids) for ids in self.library.encode(texts, num_threads=1)], dtype=np.int64)
        if self.pieces is None:
            return self._library_counts(texts)
        whole = np.array([any(s in t for s in self.special) for t in texts], dtype=bool)
        pieces, per_text = slices(["" if w else t for t, w in zip(texts, whole, strict=True)])
        edges = np.concatenate([[0], np.cumsum(self.pieces.find_counts(pieces))])
        stop = np.cumsum(per_text)
        counts = edges[stop] - edges[stop - per_text]
        for k in np.flatnonzero(whole):
            counts[k] = self._library_counts([texts[k]])[0]
        return counts


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def fill_cache(docs: DataFrame, path: str, cache_path: str, text_col: str = "text") -> DataFrame:
    """Encode one text of each content that the cache lacks, append the counts, and return the cache."""
    docs = small_batches(docs)
    spark = docs.sparkSession
    version = tokenizer_digest(path)
    known = read_cache(spark, cache_path).where(F.col("tokenizer") == version).select("digest")
    text = F.coalesce(F.col(text_col), F.lit(""))
    contents = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    missing = contents.groupBy("digest").agg(F.first("text").alias("text"))
    if not known.isEmpty():
        missing = missing.join(known, "digest", "left_anti")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts, CHUNK_CHARS):
                yield pa.RecordBatch.from_arrays([batch.column("digest").slice(a, b - a), pa.array(counter(path)(texts[a:b]))], names=["digest", "n_tokens"])

    counts = missing.mapInArrow(count, "digest binary, n_tokens long")
    counts.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    return read_cache(spark, cache_path)


def token_counts(docs: DataFrame, path: str, cache_path: str, keep: list[str], limit: int = 512, text_col: str = "text") -> DataFrame:
    """``keep`` columns with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    cache = fill_cache(docs, path, cache_path, text_col).where(F.col("tokenizer") == tokenizer_digest(path))
    counts = cache.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in keep if c not in ("n_bytes", "n_tokens", "over_limit")]
    keyed = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)], F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"))
    joined = keyed.join(counts, "digest", "left")
    return joined.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
