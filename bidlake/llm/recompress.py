"""Substring dedup by recompression: words in long passages that an earlier document holds are removed.

Each round of recompression replaces runs of one symbol by a symbol, and then neighbours (a, b), with a in one half of
the alphabet and b in the other, by a symbol. Both halves and all names are hash functions of what is named,
so a round names alike in all documents at once and needs no table and no shuffle. Equal passages get equal symbols but for
a few at their ends, however they lie in their documents.

1. A first Spark round gathers symbols. Low ones serve as anchors: whether a symbol of the first round lies well inside a
   window of ``WINDOW`` words is decided by the window's words alone, so equal windows have the same
   set of such symbols, and the one with the longest text (rare words are long) is the anchor of all windows
   that agree on it. A window that has none, because long runs fill it, is its own anchor. High ones, of
   ``LEVELS`` rounds and at least ``LEAST_SPAN`` words, carry a 128-bit digest of their words. Per symbol only
   the least and the greatest document that hold it count, and symbols of one document go. What documents of one chunk share is
   known before the shuffle.
2. High symbols that an earlier document holds verify all windows inside them at once. The other windows whose
   anchor is shared are verified by a 128-bit digest of their words in a second Spark round, which finds the first
   document of each. The first document of a high symbol always takes part with all its windows, so others may rest on it.
3. Covered words are cut from each text.

Texts that are equal to one of a smaller id are settled before all rounds: each of their windows is in that document.

Defined results: words are runs without ASCII white space, unchanged; a null text has none; windows do not leave their
document; of rows that repeat an id neither is earlier than the other, and each is judged on its own words; a
row without id is no document: nothing is taken from it, and nothing on its account; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlake.common import discard, forget_shuffles, materialize, small_batches
from bidlake.llm.neardup import mix

WINDOW = 13
LEVELS = (9, 12)
LEAST_SPAN = 16
CHUNK_WORDS = 400_000
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)  # odd
ONE = np.uint64(1)


def words_of(text: pa.Scalar) -> list[bytes]:
    return (text.as_py() or b"").split()


@lru_cache(maxsize=4)
def powers(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse modulo 2^64, at least ``size`` of them."""
    out = []
    for base in BASES:
        steps = [np.full(size, x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]
        for s in steps:
            s[0] = 1
        out.append(tuple(np.multiply.accumulate(s) for s in steps))
    return out


class Digests:
    """128-bit digests of any runs of words, in constant time each, from running sums."""

    def __init__(self, codes: np.ndarray) -> None:
        size = 1 << max(10, int(len(codes) + 1).bit_length())
        self.base = [p[0] for p in powers(size)]
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(codes * p[1][: len(codes)])]) for p in powers(size)]

    def of(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        return [mix((s[end] - s[start]) * b[start] + (end - start).astype(np.uint64)) for s, b in zip(self.sums, self.base, strict=True)]


@dataclass
class Symbols:
    """One level of a chunk of documents: names, the first word of each, and whether it opens a document."""

    name: np.ndarray
    start: np.ndarray
    opens: np.ndarray

    def runs(self) -> Symbols:
        first = self.opens.copy()
        first[1:] |= self.name[1:] != self.name[:-1]
        at = np.flatnonzero(first)
        length = np.diff(np.append(at, len(self.name))).astype(np.uint64)
        name = self.name[at]
        return Symbols(np.where(length > 1, mix(name * A + length * B), name), self.start[at], self.opens[at])

    def pairs(self, level: int) -> tuple[Symbols, np.ndarray]:
        """The next level, and the index of the first symbol of each of its symbols."""
        left = mix(self.name ^ np.uint64(level * int(A) % (1 << 64))) & ONE == ONE
        paired = np.zeros(len(left), bool)
        paired[:-1] = left[:-1] & ~left[1:] & ~self.opens[1:]
        second = np.zeros(len(left), bool)
        second[1:] = paired[:-1]
        name = self.name.copy()
        at = np.flatnonzero(paired)
        name[at] = mix(mix(name[at] * B + np.uint64(level)) * A + self.name[at + 1])
        first = np.flatnonzero(~second)
        return Symbols(name[first], self.start[first], self.opens[first]), first


class Chunk:
    """Whole documents, word by word, with what recompression says of them."""

    def __init__(self, texts: list[list[bytes]]) -> None:
        flat = [w for words in texts for w in words]
        self.size = np.array([len(w) for w in texts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.codes = np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat))
        lengths = np.fromiter(map(len, flat), np.int64, len(flat))
        self.bytes = np.concatenate([[0], np.cumsum(lengths)])
        self.digests = Digests(self.codes)
        opens = np.zeros(len(flat), bool)
        opens[self.first[:-1][self.size > 0]] = True
        self.words = Symbols(self.codes, np.arange(len(flat)), opens)
        count = np.maximum(self.size - WINDOW + 1, 0)
        self.window_doc = np.repeat(np.arange(len(texts)), count)
        self.window = np.arange(len(self.window_doc)) + np.repeat(self.first[:-1] - np.cumsum(count) + count, count)

    def ends(self, level: Symbols) -> np.ndarray:
        return np.append(level.start[1:], len(self.codes))

    def anchors(self) -> np.ndarray:
        """The anchor of each window: 8 bits of byte length, 56 of the symbol and two words on either side."""
        if not len(self.window):
            return np.zeros(0, np.uint64)
        runs = self.words.runs()
        level, first = runs.pairs(1)
        end = self.ends(level)
        length = np.minimum(self.bytes[end] - self.bytes[level.start], 255).astype(np.uint64)
        name = level.name
        for near in (level.start - 1, level.start - 2, end, end + 1):
            name = mix(name * A + self.codes[np.clip(near, 0, len(self.codes) - 1)])
        rank = (length << np.uint64(56)) | (name >> np.uint64(8))
        # Runs i0 and i1 hold the ends of a window and may reach out of it. A symbol with a whole run and a part of one more
        # on either side is the same wherever the window is, and so are two words before and behind it.
        of_word = np.zeros(len(self.codes), np.int64)
        of_word[runs.start[1:]] = 1
        of_word = np.cumsum(of_word)
        i0, i1 = of_word[self.window], of_word[self.window + WINDOW - 1]
        low, high = np.searchsorted(first, i0 + 2), np.searchsorted(first, i1 - 3, side="right")
        count = high - low
        best = self.digests.of(self.window, self.window + WINDOW)[0]
        some = np.flatnonzero(count > 0)
        width, step = rank, 1
        while step <= WINDOW:  # maxima over 1, 2, 4, 8 symbols
            now = some[(count[some] >= step) & (count[some] < 2 * step)]
            best[now] = np.maximum(width[low[now]], width[high[now] - step])
            width, step = np.maximum(width[:-step], width[step:]) if len(width) > step else width, 2 * step
        return best

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, word behind) of the high symbols."""
        level, starts, ends = self.words, [], []
        for k in range(1, max(LEVELS) + 1):
            level = level.runs().pairs(k)[0]
            if k in LEVELS:
                end = self.ends(level)
                long = end - level.start >= LEAST_SPAN
                starts.append(level.start[long])
                ends.append(end[long])
        start, end = np.concatenate(starts), np.concatenate(ends)
        return np.searchsorted(self.first, start, side="right") - 1, start, end


def chunked(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Chunk]]:
    """Runs of rows of about ``CHUNK_WORDS`` words; a longer text is a run of its own."""
    texts, start, size = [], 0, 0
    for k, text in enumerate(batch.column("text").cast(pa.binary())):
        own = words_of(text)
        if texts and size + len(own) > CHUNK_WORDS:
            yield batch.slice(start, k - start), Chunk(texts)
            texts, start, size = [], k, 0
        texts.append(own)
        size += len(own)
    if texts:
        yield batch.slice(start), Chunk(texts)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _firsts(one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the distinct (one, two, id), in order; whether each is the least id of its (one, two); and whether that has several ids."""
    order = np.lexsort((ids, two, one))
    one, two, ids = one[order], two[order], ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    fresh = new.copy()
    fresh[1:] |= ids[1:] != ids[:-1]
    first = new[fresh]
    size = np.diff(np.append(np.flatnonzero(first), len(first)))
    return order[fresh], first, np.repeat(size > 1, size)


def _symbols(docs: DataFrame) -> DataFrame:
    """key, more, doc_id, sure: anchors (more: 0) and high symbols of each document, each once.

    ``sure``: an anchor that documents of the same chunk share, or a high symbol that an earlier one of them holds. However many documents
    of a chunk share a symbol, one row of it is not sure and stands for the chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, chunk in chunked(whole):
                anchor = chunk.anchors()
                fresh = np.ones(len(anchor), bool)
                fresh[1:] = (anchor[1:] != anchor[:-1]) | (chunk.window_doc[1:] != chunk.window_doc[:-1])
                doc, start, end = chunk.spans()
                one, two = chunk.digests.of(start, end)
                key, more = np.concatenate([anchor[fresh], one]), np.concatenate([np.zeros(int(fresh.sum()), np.uint64), two | ONE])
                ids = batch.column("doc_id").to_numpy()[np.concatenate([chunk.window_doc[fresh], doc])]
                at, first, several = _firsts(key, more, ids)
                low = more[at] == 0
                stand = at[low & first & several]  # for the chunk
                sure = np.concatenate([np.where(low, several, ~first), np.zeros(len(stand), bool)])
                at = np.concatenate([at, stand])
                yield pa.RecordBatch.from_arrays([_signed(key[at]), _signed(more[at]), pa.array(ids[at]), pa.array(sure)], names=["key", "more", "doc_id", "sure"])

    return docs.mapInArrow(run, "key long, more long, doc_id long, sure boolean")


def _own(lists: pa.Array, k: int) -> np.ndarray:
    """The k-th of these lists of longs, as unsigned; none where it is null."""
    return lists[k].values.to_numpy().view(np.uint64) if lists[k].is_valid else np.zeros(0, np.uint64)


def _windows(docs: DataFrame) -> DataFrame:
    """doc_id, one, two, sure: digests of the windows that have to be verified, each once a document; of those that are settled, ``one`` alone.

    ``sure``: settled, or an earlier document of the same chunk has the window; one row a window and chunk is not.

    ``docs``: doc_id, text, and the shared symbols of the document: keys (anchors), ones and twos (digests of
    high symbols that an earlier document holds).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, chunk in chunked(whole):
                anchor = chunk.anchors()
                doc, start, end = chunk.spans()
                digests = np.stack(chunk.digests.of(start, end), axis=1) | np.array([0, 1], np.uint64)
                held, open_ = np.zeros(len(start), bool), np.zeros(len(anchor), bool)
                cuts = np.searchsorted(chunk.window_doc, np.arange(len(batch) + 1))
                order = np.argsort(doc, kind="stable")
                edges = np.searchsorted(doc[order], np.arange(len(batch) + 1))
                keys, ones, twos = (batch.column(c) for c in ("keys", "ones", "twos"))
                for k in range(len(batch)):
                    mine = slice(cuts[k], cuts[k + 1])
                    open_[mine] = np.isin(anchor[mine], _own(keys, k))
                    known = set(zip(_own(ones, k).tolist(), _own(twos, k).tolist(), strict=True))
                    if known:
                        at = order[edges[k] : edges[k + 1]]
                        held[at] = [tuple(pair) in known for pair in digests[at].tolist()]
                depth = np.zeros(len(chunk.codes) + 1, np.int64)
                np.add.at(depth, start[held], 1)
                np.add.at(depth, end[held] - WINDOW + 1, -1)
                settled = np.cumsum(depth)[chunk.window] > 0  # inside a held symbol
                at = np.flatnonzero(open_ | settled)
                one, two = chunk.digests.of(chunk.window[at], chunk.window[at] + WINDOW)
                two = np.where(settled[at], np.uint64(0), two | ONE)
                ids = batch.column("doc_id").to_numpy()[chunk.window_doc[at]]
                at, first, _ = _firsts(one, two, ids)
                sure = ~first | (two[at] == 0)
                for a in range(0, len(at), 50_000):
                    b = at[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[b]), _signed(one[b]), _signed(two[b]), pa.array(sure[a : a + 50_000])], names=["doc_id", "one", "two", "sure"])

    return docs.select("doc_id", "text", "keys", "ones", "twos").mapInArrow(run, "doc_id long, one long, two long, sure boolean")


def _cut(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept. ``docs``: doc_id, text, ``copy`` (every window is repeated), ``repeated`` (digests of those that are)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            texts, repeated = batch.column("text").cast(pa.binary()), batch.column("repeated")
            copy = batch.column("copy").to_pylist()
            for k in range(len(batch)):
                words = words_of(texts[k])
                stay = words
                if copy[k]:
                    stay = words if len(words) < WINDOW else []
                elif repeated[k].is_valid:
                    chunk = Chunk([words])
                    at = chunk.window[np.isin(chunk.digests.of(chunk.window, chunk.window + WINDOW)[0], _own(repeated, k))]
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, at, 1)
                    np.add.at(depth, at + WINDOW, -1)
                    stay = [words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0)]
                sizes.append(len(words))
                removed.append(len(words) - len(stay))
                kept.append(b" ".join(stay))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return docs.select("doc_id", "text", "copy", "repeated").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def _copies(docs: DataFrame) -> DataFrame:
    """doc_id, copies: digests of its texts that a smaller id also has."""
    ids = docs.select("doc_id", F.xxhash64("text").alias("same"), F.xxhash64(F.lit("again"), "text").alias("too"))
    first = ids.groupBy("same", "too").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    later = ids.join(first, ["same", "too"]).where("doc_id > first")
    return later.groupBy("doc_id").agg(F.collect_set("same").alias("copies"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words that stay, joined by one space; one row per row of ``docs``."""
    rows = small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    known = rows.where("doc_id is not null and text is not null")
    copies = materialize(_copies(known), "copies")
    # One shuffle by symbol. Rows that are sure are dealt out by document as well, so a hot symbol has one row a chunk.
    alike = Window.partitionBy("key", "more", F.when(F.col("sure"), F.col("doc_id")))
    ends = _symbols(known).select("*", F.min("doc_id").over(alike).alias("first"), F.max("doc_id").over(alike).alias("last"))
    # A document takes part with its shared anchors, and with the high symbols that an earlier one holds.
    met = ends.where(F.col("sure") | F.when(F.col("more") == 0, F.col("first") < F.col("last")).otherwise(F.col("first") < F.col("doc_id")))
    when = lambda high, column: F.collect_list(F.when((F.col("more") != 0) == high, F.col(column)))
    own = materialize(met.groupBy("doc_id").agg(when(False, "key").alias("keys"), when(True, "key").alias("ones"), when(True, "more").alias("twos")), "shared-symbols")
    forget_shuffles(docs.sparkSession)
    is_copy = F.coalesce(F.array_contains("copies", F.xxhash64("text")), F.lit(False))
    open_ = known.join(own.join(copies, "doc_id", "left"), "doc_id").where(~is_copy)
    alike = Window.partitionBy("one", "two", F.when(F.col("sure"), F.col("doc_id")))
    later = _windows(open_).withColumn("first", F.min("doc_id").over(alike)).where(F.col("sure") | (F.col("first") < F.col("doc_id")))
    repeated = later.groupBy("doc_id").agg(F.collect_set("one").alias("repeated"))
    found = materialize(repeated.join(copies, "doc_id", "full"), "repeated")
    discard(own, copies)
    forget_shuffles(docs.sparkSession)
    return _cut(rows.join(found, "doc_id", "left").withColumn("copy", is_copy))


def dedup_report(docs: DataFrame) -> DataFrame:
    """What the dedup leaves of each document, by digest."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE_SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, trim(coalesce(text, ''), {_WHITE}) AS t FROM documents
), d AS (
  SELECT r, doc_id, CASE WHEN t = '' THEN [] ELSE string_split_regex(t, '[\x20\x09-\x0D]+') END AS w FROM t
), g AS (
  SELECT r, doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS g FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS u(i) WHERE doc_id IS NOT NULL
), f AS (
  SELECT g, min(doc_id) AS first FROM g GROUP BY g
), hit AS (
  SELECT DISTINCT r, i + unnest(range(0, {WINDOW})) AS i FROM g JOIN f USING (g) WHERE doc_id > first
), kept AS (
  SELECT r, list_filter(w, lambda x, k: NOT list_contains(coalesce(gone, []), k)) AS k FROM d LEFT JOIN (SELECT r, list(i) AS gone FROM hit GROUP BY r) USING (r)
)
SELECT doc_id, len(w) AS n_words, len(w) - len(k) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM d JOIN kept USING (r)
"""
