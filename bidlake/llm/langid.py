"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of lower-cased letters, other characters standing as one boundary.
Document frequencies are counted over every document that may be learned from. Weights are trained by
follow-the-regularised-leader with elastic-net penalties on a bounded sample (``sample_per_language`` rows
a language, chosen by hash of the id), and a temperature is fitted on a part of the sample kept back.

Defined results: a null text, or one without a letter, is ``und`` with score 0; ties go to the first
language by code point; repeated rows get equal results; rows whose id is null are never learned from and
count as not held out; with nothing to learn from, every document is ``und``; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlake.common import materialize, small_batches
from bidlake.llm.learning import SHARDS, Ftrl, train_in_shards
from bidlake.llm.textclass import LETTER, class_table, code_points, lower_table

BINS = 1 << 15
ORDERS = 3
SAMPLE_PER_LANGUAGE = 1_500
ROUNDS = 3
UNDETERMINED = "und"
K1, K2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def gram_counts(text: str | None) -> np.ndarray | None:
    """Count of each feature in the whole text; None without a letter."""
    if not text:
        return None
    points = code_points(text)
    letter = class_table()[points] == LETTER
    if not letter.any():
        return None
    x = np.where(letter, lower_table()[points], 0)
    x = np.concatenate([[0], x[letter | np.concatenate([[True], letter[:-1]])], [0]]).astype(np.uint32)
    total = np.zeros(BINS, dtype=np.int64)
    h = np.zeros(len(x), dtype=np.uint32)
    for order in range(1, ORDERS + 1):
        h = h[: len(x) - order + 1] * K1 + x[order - 1 :] + np.uint32(order)
        mixed = (h ^ (h >> np.uint32(15))) * K2
        total += np.bincount(mixed >> np.uint32(32 - 15), minlength=BINS)
        h = h + np.uint32(0)
    return total


def tfidf(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features present and their unit-length weights."""
    at = np.flatnonzero(counts)
    value = (1.0 + np.log(counts[at])) * idf[at]
    return at, value / (np.sqrt((value * value).sum()) or 1.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(label):
        return 1.0
    loss = lambda u: -np.mean(np.log(np.maximum(softmax(logits / np.exp(u))[np.arange(len(label)), label], 1e-12)))
    lo, hi, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def logits(self, text: str | None) -> np.ndarray | None:
        counts = gram_counts(text)
        if counts is None:
            return None
        at, value = tfidf(counts, self.idf)
        return value @ self.weights[at] + self.bias


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts have each feature, and how many texts there are. ``texts``: column text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BINS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                counts = gram_counts(text.as_py())
                if counts is not None:
                    seen += counts > 0
                    n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[at], n))], names=["bin", "n"])

    table = texts.mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    bins, n = table.column("bin").to_numpy(), table.column("n").to_numpy()
    out = np.zeros(BINS, dtype=np.int64)
    out[bins[bins >= 0]] = n[bins >= 0]
    return out, int(n[bins < 0].sum())


def fit(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE, rounds: int = ROUNDS, ftrl: Ftrl | None = None) -> LanguageModel | None:
    """Learn from text and non-null lang of the documents that are not held out."""
    docs = small_batches(docs)
    ftrl = ftrl or Ftrl(alpha=1.0, l1=0.002, l2=0.0005)
    spark = docs.sparkSession
    key = F.col("doc_id")
    usable = docs.where(key.isNotNull() & ~held_out(key) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    shares = spark.createDataFrame([(lang, float(sample_per_language) / n) for lang, n in sizes.items()], "lang string, share double")
    chance = F.pmod(F.xxhash64(F.lit("langid"), key), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.join(F.broadcast(shares), "lang").where(chance < F.col("share"))
    sample = sample.select("doc_id", "lang", "text", F.md5("text").alias("digest"), F.pmod(F.xxhash64(F.lit("langid-part"), key), F.lit(5)).alias("part"), F.pmod(F.xxhash64(F.lit("langid-shard"), key), F.lit(SHARDS)).cast("int").alias("shard"))
    sample = materialize(sample, "language-sample")
    seen, n = document_frequencies(usable.select("text"))
    idf = np.log((1.0 + n) / (1.0 + seen)) + 1.0
    index = {lang: k for k, lang in enumerate(languages)}
    width = len(languages)

    def local(rows: list[dict], state, turn: int):
        z, m = state
        ready = [(index[r["lang"]], *tfidf(c, idf)) for r in rows if r["part"] and (c := gram_counts(r["text"])) is not None]
        for k in np.random.default_rng(turn).permutation(len(ready)):
            label, at, value = ready[k]
            at, value = np.append(at, BINS), np.append(value, 1.0)
            w = ftrl.weights(z[at], m[at])
            p = softmax(value @ w)
            p[label] -= 1.0
            ftrl.step(z, m, at, value[:, None] * p, w)
        return z, m

    z, m = train_in_shards(sample, ["doc_id", "lang", "digest"], (np.zeros((BINS + 1, width)), np.zeros((BINS + 1, width))), local, rounds)
    w = ftrl.weights(z, m)
    model = LanguageModel(languages, w[:BINS], w[BINS], idf, 1.0)
    shared = spark.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(index[r["lang"]], x) for r in batch.to_pylist() if (x := shared.value.logits(r["text"])) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.int64()), pa.array([x.tolist() for _, x in pairs], pa.list_(pa.float64()))], names=["label", "logits"])

    back = sample.where("part = 0").select("lang", "text").mapInArrow(judge, "label long, logits array<double>").collect()
    back.sort(key=lambda r: (r["label"], r["logits"]))
    temperature = fit_temperature(np.array([r["logits"] for r in back]).reshape(-1, width), np.array([r["label"] for r in back], dtype=np.int64))
    return LanguageModel(languages, w[:BINS], w[BINS], idf, temperature)


def predict(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` other than the text, with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    drop = [text_col, "lang_pred", "score"]
    kept = [f for f in docs.schema.fields if f.name not in drop]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores = [], []
            for text in batch.column(text_col):
                x = None if model is None else model.logits(text.as_py())
                if x is None:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                else:
                    p = softmax(x / model.temperature)
                    k = int(p.argmax())
                    names.append(model.languages[k])
                    scores.append(float(p[k]))
            columns = [batch.column(f.name) for f in kept] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + ["lang_pred", "score"])

    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*[f.name for f in kept], text_col).mapInArrow(judge, schema)


def language_report(docs: DataFrame) -> DataFrame:
    model = fit(docs.select("doc_id", "lang", "text"))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
