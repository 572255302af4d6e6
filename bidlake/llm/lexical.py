"""Ranked lexical search by dual trees: the best documents of each item, exactly.

A document is a vector of term impacts (weight times saturated frequency, integers), an item is a 0/1 vector of
its terms, and the score is their product. Documents are read twice in narrow form: the first pass over the texts
keeps, for each, its number of terms and the frequencies of those terms that items hold; corpus size, length and
document frequencies are sums over all rows of that.

Both sides form hierarchies. An item node holds the greatest coordinates of its items, that is, their terms
united; tasks sort blocks of documents so that like stand together, and a document node holds the greatest
impact of each term. The product of two such vectors bounds every score between the two nodes, so a pair
of nodes is dropped with all its pairs where the bound is 0 or below the weakest k-th score that any of the node's items
has so far. What is left is scored in whole batches. The k-th scores start from a wave over a share of the
documents by hash, found the same way, so tasks of the main wave return little more than what ends among the k best.

Items are taken in lots of about ``lot_terms`` terms, since a lot's terms, weights and hierarchy are sent to every task.
Arithmetic is exact: integers in doubles while sums stay below 2^53, 64-bit integers beyond.

Defined results: a null text, or one without terms, counts nowhere; only A-Z are lower-cased; items that repeat
an id are one item with the terms of all; items without id or terms get no rows; documents that repeat an id are ranked
each on its own; a document without id is ranked behind others of its score; equal scores go by id; empty tables give an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlake.common import materialize, small_batches
from bidlake.llm.bpe import list_array

EXACT = float(1 << 53)
NO_ID = np.iinfo(np.int64).max
SEED_ROWS = 16_384  # documents of the first wave, about

# Bytes that stand between terms become a space, A-Z become a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 0x7F or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


@dataclass(frozen=True)
class Search:
    k: int = 50
    lot_terms: int = 16_384
    item_leaf: int = 8
    doc_leaf: int = 64
    block: int = 4_096


def terms_of(texts: pa.Array) -> Iterator[list[bytes]]:
    for text in texts.cast(pa.binary()):
        yield (text.as_py() or b"").translate(FOLD).split()


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, term: the distinct terms of each item that has an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(set(words)) for words in terms_of(batch.column("text"))]
            at = np.repeat(np.arange(len(own)), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(at)), pa.array([w for x in own for w in x], pa.binary())], names=["item_id", "term"])

    source = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "item_id long, term binary").distinct()


@dataclass(frozen=True)
class ItemTree:
    """Items in the order of the leaves. Nodes: ranges of items, children (-1: none), and 0/1 coordinate maxima."""

    ids: np.ndarray
    rows: np.ndarray  # item by term, 0/1
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    top: np.ndarray  # node by term, 0/1


def item_tree(ids: list[int], terms: list[np.ndarray], width: int, leaf: int) -> ItemTree:
    """Halves items by the term that parts them most evenly, down to leaves."""
    rows = np.zeros((len(ids), width), bool)
    for k, own in enumerate(terms):
        rows[k, own] = True
    order = np.arange(len(ids))
    low, high, left, right = [0], [len(ids)], [-1], [-1]
    for node, _ in enumerate(low):  # grows while it is read
        a, b = low[node], high[node]
        if b - a <= leaf:
            continue
        own = order[a:b]
        term = np.abs(rows[own].sum(axis=0) - (b - a) / 2).argmin()
        has = rows[own, term]
        middle = int(has.sum())
        order[a:b] = np.concatenate([own[has], own[~has]])
        cut = a + (middle if 0 < middle < b - a else (b - a) // 2)
        left[node], right[node] = len(low), len(low) + 1
        low += [a, cut]
        high += [cut, b]
        left += [-1, -1]
        right += [-1, -1]
    rows = rows[order]
    top = np.stack([rows[a:b].any(axis=0) for a, b in zip(low, high, strict=True)])
    return ItemTree(np.array(ids, np.int64)[order], rows, *(np.array(x) for x in (low, high, left, right)), top)


def frequencies(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms of the text), terms, tfs: how often each term of the vocabulary occurs. Only texts with terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            sizes, ids, tfs, counts = [], [], [], []
            for words in terms_of(batch.column("text")):
                own, often = np.unique(np.array([k for k in map(known.get, words) if k is not None], np.int32), return_counts=True)
                sizes.append(len(words))
                ids.append(own)
                tfs.append(often.astype(np.int32))
                counts.append(len(own))
            flat = lambda x: list_array(np.concatenate([np.zeros(0, np.int32), *x]), np.array(counts, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), flat(ids), flat(tfs)], names=["doc_id", "n", "terms", "tfs"])

    source = small_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return source.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>").where("n > 0")


@dataclass(frozen=True)
class Ranker:
    """What tasks need: a bounded lot of items, term weights, corpus sums, and k-th scores known so far."""

    conf: Search
    tree: ItemTree
    weight: np.ndarray
    documents: int
    length: int
    floor: np.ndarray

    def impacts(self, n: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 50 + (50 * n * self.documents) // self.length
        return self.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def product(one: np.ndarray, two: np.ndarray, most: int) -> np.ndarray:
    """Exact product of 0/1 rows with rows of integers up to ``most``, as integers."""
    if most * one.shape[1] < EXACT:
        return (one.astype(np.float64) @ two.T.astype(np.float64)).astype(np.int64)
    return one.astype(np.int64) @ two.T


class DocumentTree:
    """A block of documents: rows of impacts in an order that brings like together, and coordinate maxima up to the root."""

    def __init__(self, batch: pa.Table, ranker: Ranker) -> None:
        ids, n = batch.column("doc_id").fill_null(NO_ID).to_numpy(), batch.column("n").to_numpy()
        lists = batch.column("terms").combine_chunks()
        count = np.diff(lists.offsets.to_numpy())
        row, term = np.repeat(np.arange(len(n)), count), lists.flatten().to_numpy()
        tf = batch.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        # By the most frequent term (which follows the language), then by length.
        first = np.full(len(n), -1)
        by_tf = np.lexsort((term, tf))
        first[row[by_tf]] = term[by_tf]
        order = np.lexsort((n, first))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.ids, self.row, self.term, self.impact = ids[order], place[row], term, ranker.impacts(n[row], term, tf)
        sort = np.argsort(self.row, kind="stable")
        self.row, self.term, self.impact = self.row[sort], self.term[sort], self.impact[sort]
        self.leaf, self.width = ranker.conf.doc_leaf, len(ranker.weight)
        self.most = int(self.impact.max(initial=0))
        leaves = -(-len(n) // self.leaf)
        maxima = np.zeros((leaves, self.width), np.int64)
        np.maximum.at(maxima, (self.row // self.leaf, self.term), self.impact)
        self.levels = [maxima]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            above = below[::2].copy()
            np.maximum(above[: len(below) // 2], below[1::2], out=above[: len(below) // 2])
            self.levels.append(above)

    def rows(self, leaf: int) -> np.ndarray:
        a, b = np.searchsorted(self.row, [leaf * self.leaf, (leaf + 1) * self.leaf])
        out = np.zeros((min(self.leaf, len(self.ids) - leaf * self.leaf), self.width), np.int64)
        out[self.row[a:b] - leaf * self.leaf, self.term[a:b]] = self.impact[a:b]
        return out


def open_leaves(docs: DocumentTree, items: ItemTree, floor: np.ndarray) -> dict[int, list[int]]:
    """Item leaves by document leaf that bounds do not rule out, descending both trees in step."""
    weakest = np.array([floor[a:b].min() for a, b in zip(items.low, items.high, strict=True)])
    pairs = {(0, 0)}
    for depth in range(len(docs.levels) - 1, -1, -1):
        while True:
            node, doc = (np.array(x) for x in zip(*sorted(pairs), strict=True)) if pairs else (np.zeros(0, int),) * 2
            if not len(node):
                return {}
            nodes, docs_here = np.unique(node), np.unique(doc)
            bound = product(items.top[nodes], docs.levels[depth][docs_here], docs.most)[np.searchsorted(nodes, node), np.searchsorted(docs_here, doc)]
            stay = (bound > 0) & (bound >= weakest[node])
            node, doc = node[stay], doc[stay]
            inner = items.left[node] >= 0
            pairs = set(zip(node[~inner].tolist(), doc[~inner].tolist(), strict=True))
            for side in (items.left, items.right):
                pairs |= set(zip(side[node[inner]].tolist(), doc[inner].tolist(), strict=True))
            if depth or not inner.any():  # above the leaves, both sides go down one level at a time
                break
        if depth:
            size = len(docs.levels[depth - 1])
            pairs = {(a, c) for a, b in pairs for c in (2 * b, 2 * b + 1) if c < size}
    out: dict[int, list[int]] = {}
    for a, b in sorted(pairs):
        out.setdefault(b, []).append(a)
    return out


class Best:
    """The k best documents of each item of a lot so far."""

    def __init__(self, ranker: Ranker) -> None:
        items, self.k = len(ranker.tree.ids), ranker.conf.k
        self.ranker, self.scores, self.floor = ranker, np.zeros((items, self.k), np.int64), ranker.floor.copy()
        self.item, self.doc, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def search(self, batch: pa.Table) -> None:
        tree = self.ranker.tree
        docs = DocumentTree(batch, self.ranker)
        found = [(self.item, self.doc, self.score)]
        for leaf, nodes in open_leaves(docs, tree, self.floor).items():
            items = np.concatenate([np.arange(tree.low[k], tree.high[k]) for k in nodes])
            score = product(tree.rows[items], docs.rows(leaf), docs.most)
            self.scores[items] = np.partition(np.concatenate([self.scores[items], score], axis=1), -self.k, axis=1)[:, -self.k :]
            self.floor[items] = np.maximum(self.floor[items], self.scores[items].min(axis=1))
            i, d = np.nonzero((score > 0) & (score >= self.floor[items][:, None]))
            found.append((items[i], docs.ids[leaf * docs.leaf + d], score[i, d]))
        item, doc, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        start = np.concatenate([[0], np.flatnonzero(np.diff(item)) + 1]) if len(item) else np.zeros(0, int)
        place = np.arange(len(item)) - np.repeat(start, np.diff(np.append(start, len(item))))
        keep = place < self.k
        self.item, self.doc, self.score = item[keep], doc[keep], score[keep]


def _found(posts: DataFrame, ranker: Ranker) -> DataFrame:
    """item_id, doc_id, score: per task, at most k documents an item, none below its known k-th score."""
    shared = posts.sparkSession.sparkContext.broadcast(ranker)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held = Best(shared.value), []
        size = shared.value.conf.block
        for batch in batches:
            for a in range(0, len(batch), size):
                held.append(batch.slice(a, size))
                if sum(map(len, held)) >= size:
                    best.search(pa.Table.from_batches(held))
                    held = []
        if held:
            best.search(pa.Table.from_batches(held))
        ids = pa.array(best.doc, mask=best.doc == NO_ID)
        yield pa.RecordBatch.from_arrays([pa.array(shared.value.tree.ids[best.item]), ids, pa.array(best.score)], names=["item_id", "doc_id", "score"])

    return posts.mapInArrow(run, "item_id long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _lot(docs: DataFrame, rows: list[tuple[int, bytes]], conf: Search) -> DataFrame | None:
    """Ranks the documents for the items of one lot, given as (item, term)."""
    vocabulary = {t: k for k, t in enumerate(sorted({t for _, t in rows}))}
    own: dict[int, list[int]] = {}
    for item, term in rows:
        own.setdefault(item, []).append(vocabulary[term])
    tree = item_tree(sorted(own), [np.array(own[i]) for i in sorted(own)], len(vocabulary), conf.item_leaf)
    posts = materialize(frequencies(docs, vocabulary), "frequencies")
    sums = posts.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    if not sums["documents"]:
        return None
    held = posts.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # at most one row a term of the lot
    df = np.zeros(len(vocabulary), np.int64)
    df[held.column("term").to_numpy()] = held.column("count").to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * sums["documents"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    ranker = Ranker(conf, tree, weight, sums["documents"], sums["length"], np.zeros(len(tree.ids), np.int64))
    share = max(1, sums["documents"] // SEED_ROWS)
    lot = F.pmod(F.xxhash64("doc_id", "n"), F.lit(share))
    first = materialize(_ranked(_found(posts.where(lot == 0), ranker), conf.k), "first-wave")
    floors = first.where(F.col("rank") == conf.k).select("item_id", "score").toArrow()  # at most one row an item of the lot
    known = dict(zip(floors.column("item_id").to_pylist(), floors.column("score").to_pylist(), strict=True))
    ranker = replace(ranker, floor=np.array([known.get(i, 0) for i in tree.ids.tolist()], np.int64))
    rest = _found(posts.where(lot != 0), ranker)
    return _ranked(first.drop("rank").unionByName(rest), conf.k)


def search(docs: DataFrame, items: DataFrame, conf: Search | None = None) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each item with a score above 0.

    ``docs``: doc_id, text; ``items``: item_id, text. Each lot of items reads the texts once.
    """
    conf = conf or Search()
    spark = docs.sparkSession
    terms = materialize(item_terms(items), "item-terms")
    lots = max(1, math.ceil(terms.count() / conf.lot_terms))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for lot in range(lots):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(lots)) == lot).toArrow()
        if len(rows):
            found = _lot(docs, list(zip(rows.column("item_id").to_pylist(), rows.column("term").to_pylist(), strict=True)), conf)
            out = out if found is None else out.unionByName(found)
    return out


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents
), size AS (
  SELECT r, doc_id, len(w) AS n FROM d WHERE len(w) > 0
), sums AS (
  SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS length FROM size
), item AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark
), tf AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM item) GROUP BY 1, 2
), df AS (
  SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM tf, sums GROUP BY term, documents
), impact AS (
  SELECT size.doc_id, r, term, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * documents) // length))) AS impact
  FROM tf JOIN df USING (term) JOIN size USING (r), sums
), score AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, CAST(sum(impact) AS BIGINT) AS score FROM item JOIN impact USING (term) WHERE item_id IS NOT NULL GROUP BY 1, 2
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM score WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
