"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are the distinct words of a text (lower case, outer punctuation off) and their prefixes, as
64-bit hashes. A vocabulary of bounded size is chosen by association with the label. One weight vector is
shared by all thresholds: P(grade > k) = sigmoid(w.x - theta_k), the thresholds kept in order by
positive gaps; expected severity is the sum of these probabilities.

Labels may hold grades 0, 1, 2 ... in any column. Where they only hold 0 and 1, a document of label 1 is
of grade 2 when the share of its words that carry a learned feature is above the median of such documents.

Training uses a bounded sample of labelled rows (``sample`` rows a label, by hash of the id); scoring reads
every whole text. A document is rejected from a probability of ``REJECT`` on, if its features speak for a grade over 0 at all.

Defined results: a null or empty text has severity of no features and is not rejected; repeated rows get
equal results; label rows without text, or null, are not learned from; of texts that repeat with several
labels the least counts; with no labels of either kind
nothing is rejected; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlake.common import materialize, small_batches, table
from bidlake.llm.bpe import with_fields
from bidlake.llm.learning import SHARDS, Ftrl, train_in_shards

SAMPLE = 4_000  # rows a grade over 0
SAMPLE_CLEAN = 12_000  # rows of grade 0
VOCABULARY = 1 << 14
LEAST_DOCS = 4
LEAST_CHI_SQUARE = 25.0
PREFIXES = (3, 5, 7)
ROUNDS = 10
REJECT = 0.2
STRIP = b".,;:!?*$%&#\"'()[]{}<>|/\\+=~^_-`"
GAP = 1.0
AGAIN, DENSE = 100, 200
DENSE_SHARE = 0.006
KNOWN_TOKENS = 100_000


def features(text: str | None) -> np.ndarray:
    """Hashes of the distinct words and their prefixes, again of those that occur more than once, and
    again of prefixes that make up a share of all words (sorted, distinct)."""
    words = [w for w in (x.strip(STRIP) for x in (text or "").lower().encode("utf-8", "surrogatepass").split()) if w]
    if not words:
        return np.zeros(0, np.uint64)
    counts = Counter(words)
    codes = {w: xxhash.xxh3_64_intdigest(w) for w in counts}
    prefix: Counter = Counter()
    for w, n in counts.items():
        chars = w.decode("utf-8", "surrogatepass")
        for size in PREFIXES:
            if len(chars) > size:
                prefix[size, chars[:size]] += n
    keys = list(codes.values()) + [xxhash.xxh3_64_intdigest(w, seed=AGAIN) for w, n in counts.items() if n > 1]
    for (size, p), n in prefix.items():
        raw = p.encode("utf-8", "surrogatepass")
        keys.append(xxhash.xxh3_64_intdigest(raw, seed=size))
        if n > 1:
            keys.append(xxhash.xxh3_64_intdigest(raw, seed=size + AGAIN))
            if n >= DENSE_SHARE * len(words):
                keys.append(xxhash.xxh3_64_intdigest(raw, seed=size + DENSE))
    return np.unique(np.array(keys, dtype=np.uint64))


class Lookup(dict):
    """The features of a vocabulary in texts; what a token stands for is kept for up to ``KNOWN_TOKENS`` tokens, that share their prefixes."""

    def __init__(self, vocabulary: np.ndarray):
        super().__init__()
        self.at = {int(key): k for k, key in enumerate(vocabulary)}
        self.starts: dict[tuple[int, str], tuple[bytes, list[int]] | None] = {}

    def find(self, raw: bytes, seed: int) -> int:
        return self.at.get(xxhash.xxh3_64_intdigest(raw, seed=seed), -1)

    def start(self, size: int, prefix: str) -> tuple[bytes, list[int]] | None:
        """The prefix with its positions, None if it has none."""
        if (size, prefix) not in self.starts:
            raw = prefix.encode("utf-8", "surrogatepass")
            places = [self.find(raw, size + more) for more in (0, AGAIN, DENSE)]
            self.starts[size, prefix] = (raw, places) if max(places) >= 0 else None
        return self.starts[size, prefix]

    def clear(self) -> None:
        super().clear()
        self.starts.clear()

    def __missing__(self, token: bytes):
        """None for no word; else positions of the word, once and again, and for each prefix its hash and positions: once, again, dense."""
        word = token.strip(STRIP)
        entry = None
        if word:
            chars = word.decode("utf-8", "surrogatepass")
            starts = tuple(s for s in (self.start(size, chars[:size]) for size in PREFIXES if len(chars) > size) if s)
            entry = (self.find(word, 0), self.find(word, AGAIN), starts)
            if entry == (-1, -1, ()):
                entry = ()
        self[token] = entry
        return entry

    def __call__(self, text: str | None) -> tuple[np.ndarray, dict[int, int], int]:
        """Sorted positions of the features of a text (as ``features`` defines them), occurrences of known words by position, words."""
        if len(self) > KNOWN_TOKENS:
            self.clear()
        words, total, prefixes = {}, 0, {}
        for token, n in Counter((text or "").lower().encode("utf-8", "surrogatepass").split()).items():
            entry = self[token]
            if entry is None:
                continue
            total += n
            if entry:
                once, again, starts = entry
                if once >= 0 or again >= 0:
                    words[once, again] = words.get((once, again), 0) + n
                for raw, places in starts:
                    prefixes.setdefault(raw, [places, 0])[1] += n
        out = set()
        for (once, again), n in words.items():
            out.add(once)
            if n > 1:
                out.add(again)
        for places, n in prefixes.values():
            out.add(places[0])
            if n > 1:
                out.add(places[1])
                if n >= DENSE_SHARE * total:
                    out.add(places[2])
        out.discard(-1)
        return np.array(sorted(out), dtype=np.int64), {once: n for (once, _), n in words.items() if once >= 0}, total


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass(frozen=True)
class SeverityModel:
    vocabulary: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    @cached_property
    def lookup(self) -> Lookup:
        return Lookup(self.vocabulary)

    def evidence(self, text: str | None) -> float:
        return float(self.weights[self.lookup(text)[0]].sum())

    def above(self, evidence: float) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        return sigmoid(evidence - self.thresholds)


def _sample(docs: DataFrame, labels: DataFrame, label_col: str, sample: int) -> DataFrame:
    marks = labels.select("doc_id", F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & (F.col("y") >= 0) & F.col("doc_id").isNotNull())
    marks = marks.groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    chance = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, F.lit((sample if y else sample * SAMPLE_CLEAN // SAMPLE) / n)).otherwise(share)
    chosen = marks.where(chance < share)
    # The sample is bounded by ``sample`` rows a label, so it may be broadcast; the texts are not shuffled.
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # Copies would pass off their common words as evidence: one text counts once, with the least of its labels.
    once = rows.groupBy(F.md5("text").alias("digest")).agg(F.first("text").alias("text"), F.min("y").alias("y"))
    shard = F.pmod(F.xxhash64(F.lit("shard"), "digest"), F.lit(SHARDS)).cast("int")
    return materialize(once.select("text", "y", "digest", shard.alias("shard")), "severity-sample")


def _choose(sample: DataFrame, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The features most associated with a label over 0, by signed chi-square of document counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, marks = [], []
        for batch in batches:
            for row in batch.to_pylist():
                own = features(row["text"])
                keys.append(own)
                marks.append(np.full(len(own), int(row["y"] > 0), dtype=np.int64))
        if keys:
            key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            bad = np.bincount(inverse, weights=np.concatenate(marks), minlength=len(key)).astype(np.int64)
            every = np.bincount(inverse, minlength=len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(every), pa.array(bad)], names=["key", "n", "bad"])

    totals = sample.agg(F.count("*").alias("n"), F.sum((F.col("y") > 0).cast("long")).alias("bad")).first()
    n, bad = float(totals["n"] or 0), float(totals["bad"] or 0)
    per = sample.mapInArrow(count, "key long, n long, bad long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(F.col("n") >= least)
    expected = F.col("n") * (bad / max(n, 1.0))
    score = (F.col("bad") - expected) * F.abs(F.col("bad") - expected) / F.greatest(expected * F.lit(max(1.0 - bad / max(n, 1.0), 1e-9)), F.lit(1e-9))
    top = per.select("key", (F.col("bad") / F.col("n")).alias("rate"), F.abs(score).alias("score")).where(F.col("score") >= LEAST_CHI_SQUARE).orderBy(F.desc("score"), "key").limit(size).toArrow()
    key = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], top.column("rate").to_numpy()[order]


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE, vocabulary: int = VOCABULARY, rounds: int = ROUNDS, ftrl: Ftrl | None = None) -> SeverityModel | None:
    ftrl = ftrl or Ftrl(alpha=0.5, l1=1.0, l2=0.01)
    rows = _sample(small_batches(docs), labels, label_col, sample)
    grades = [r["y"] for r in rows.select("y").distinct().collect()]
    if len(grades) < 2:
        return None
    words, rate = _choose(rows, vocabulary, LEAST_DOCS)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((words, rate > 0.5))
    binary = max(grades) == 1

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, marked = shared.value
        lookup = Lookup(words)
        for batch in batches:
            at, share = [], []
            for text in batch.column("text"):
                own, known, total = lookup(text.as_py())
                at.append(own.tolist())
                share.append(sum(n for k, n in known.items() if marked[k]) / max(total, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.list_(pa.int64())), batch.column("y"), pa.array(share, pa.float64()), batch.column("digest"), batch.column("shard")], names=["at", "y", "share", "digest", "shard"]
            )

    indexed = materialize(rows.mapInArrow(index, "at array<long>, y int, share double, digest string, shard int"), "severity-rows")
    middle = indexed.where("y > 0").agg(F.median("share")).first()[0] or 0.0
    levels = 2 if binary else max(grades)

    def grade(row: dict) -> int:
        return row["y"] + int(binary and row["y"] > 0 and row["share"] > middle)

    size = len(words)

    def local(rows: list[dict], state, turn: int):
        z, n = state
        ready = [(grade(r), np.array(r["at"], dtype=np.int64)) for r in rows]
        for k in np.random.default_rng(turn).permutation(len(ready)):
            y, at = ready[k]
            own = np.concatenate([at, np.arange(size, size + levels)])
            w = ftrl.weights(z[own], n[own])
            first, gaps = w[len(at)], np.exp(np.clip(w[len(at) + 1 :], -5, 5)) * GAP
            theta = first + np.concatenate([[0.0], np.cumsum(gaps)])
            error = sigmoid(w[: len(at)].sum() - theta) - (y > np.arange(levels))  # d loss / d (score - theta_k)
            gradient = np.empty(len(own))
            gradient[: len(at)] = error.sum()
            gradient[len(at)] = -error.sum()
            gradient[len(at) + 1 :] = [-error[k + 1 :].sum() * gaps[k] for k in range(levels - 1)]
            ftrl.step(z, n, own, gradient, w)
        return z, n

    z, n = train_in_shards(indexed, ["digest"], (np.zeros(size + levels), np.zeros(size + levels)), local, rounds)
    w = ftrl.weights(z, n)
    theta = w[size] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(w[size + 1 :], -5, 5)) * GAP)])
    used = np.flatnonzero(w[:size])
    return SeverityModel(words[used], w[:size][used], theta)


def score(docs: DataFrame, model: SeverityModel | None, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """Add p_toxic, expected_severity, grade (0 unless rejected, else the likeliest over 0) and toxic (rejected) to ``docs``."""
    added = ["p_toxic", "expected_severity", "grade", "toxic"]
    docs = small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.drop(*added)
    kinds = (T.DoubleType(), T.DoubleType(), T.IntegerType(), T.BooleanType())
    schema = with_fields(source, *[T.StructField(n, k) for n, k in zip(added, kinds, strict=True)])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            evidence = [0.0 if model is None else model.evidence(t.as_py()) for t in batch.column(text_col)]
            above = [np.zeros(1) if model is None else model.above(e) for e in evidence]
            p = np.array([a[0] for a in above], dtype=np.float64)
            rejected = (p >= reject) & (np.array(evidence) > 0)
            likeliest = [1 + int(np.argmax(-np.diff(np.append(a, 0.0)))) if r else 0 for a, r in zip(above, rejected, strict=True)]
            columns = [pa.array(p), pa.array([float(a.sum()) for a in above], pa.float64()), pa.array(likeliest, pa.int32()), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *added])

    return source.mapInArrow(judge, schema)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text"), model).drop("text")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with the columns of ``docs``."""
    return score(docs, fit(docs, labels)).where(~F.col("toxic")).select(*docs.columns)


def report_tables(spark, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
