"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star edges.

1. Each text becomes the set of its word shingles (64-bit hashes) and one signature: a single hash
   ranks all shingles, the range is cut into bins, a bin keeps its least value, and an empty bin borrows
   from a non-empty one found in a fixed random order of its own. Equal sets are one node from here on.
2. Bands of the signature are bucket keys. In each bucket of two or more nodes every member is paired with
   one centre only: a star, so pairs grow with members, not with their square. The centre is the member
   that shares most of its bands with anyone: the text that a group of edited copies goes back to. Pairs
   whose signatures agree enough are confirmed on the full shingle sets. Stars only save work, they
   decide nothing.
3. Components of the confirmed links. A bucket that still holds several components may hide a link that
   does not touch its centre. All members of such a bucket that are outside its largest component are
   compared with all members of other components, on the full sets: both are dealt into blocks of about
   ``CELL`` shingles, each pair of blocks is a cell that counts the common shingles of many members at once, and
   only the links that join two components leave it. So a hot bucket is spread over
   cells of bounded size, and no table of pairs is made.

So every two texts that share a bucket are in one component or have been compared. A pair at the threshold
shares no bucket with a probability of about ``MISS``; a reported link is exact.

Defined results: lower-casing touches A-Z only; words are runs without ASCII white space; a text of fewer
words than a shingle has is one shingle of all its words; a null text, or one without words, has no
shingles and is linked with nothing; repeated rows are copies of each other; rows whose id is null are
not linked; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.common import materialize, small_batches
from bidlake.llm.bpe import list_array
from bidlake.llm.graph import connected_components

ROWS = 6
MISS = 1e-7
CELL = 1_000_000
DENSE = 8
SLACK_SIGMAS = 5.0
SEED = 20240229
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class NearDup:
    width: int = 5
    percent: int = 80

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** ROWS))

    @property
    def bins(self) -> int:
        return self.bands * ROWS

    @property
    def least_agreeing(self) -> int:
        """Signature rows that a link at the threshold agrees in, less five standard deviations."""
        t = self.percent / 100
        return math.floor(self.bins * t - SLACK_SIGMAS * math.sqrt(self.bins * t * (1 - t)))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * A
    x = (x ^ (x >> np.uint64(29))) * B
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z in lower case: what is between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = words_of(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    used = min(width, len(words))
    out = np.full(len(words) - used + 1, used, dtype=np.uint64)
    for k in range(used):
        out = mix(out * A + codes[k : len(words) - used + 1 + k])
    return np.unique(out)


@lru_cache(maxsize=4)
def borrow_order(bins: int) -> np.ndarray:
    """For each bin, a fixed random order of all bins in which it looks for a value when empty."""
    rng = np.random.default_rng(SEED)
    return np.argsort(rng.random((bins, bins)), axis=1)


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """Least value of each bin (densified) as uint64; ``hashes`` sorted, not empty."""
    of_bin = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    first = np.concatenate([[0], np.flatnonzero(np.diff(of_bin)) + 1])
    filled = np.zeros(bins, dtype=bool)
    at = of_bin[first].astype(np.int64)
    filled[at] = True
    out = np.zeros(bins, dtype=np.uint64)
    out[at] = mix(hashes[first])
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = borrow_order(bins)[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    key = np.arange(1, bands + 1, dtype=np.uint64) * B
    for row in sig.reshape(bands, ROWS).T:
        key = mix(key + row)
    return key.view(np.int64)


def _signatures(docs: DataFrame, conf: NearDup, id_col: str, text_col: str) -> DataFrame:
    """doc_id, copy (digest of the text), n_shingles, node (digest of the set, null if empty), bands, sig (16 bits a row)."""
    width, bands, bins = conf.width, conf.bands, conf.bins

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, keys, sigs = [], [], [], []
            for text in batch.column("text"):
                own = shingles(text.as_py(), width)
                sizes.append(len(own))
                if len(own):
                    sig = signature(own, bins)
                    nodes.append(xxhash.xxh3_128_digest(own.tobytes()))
                    keys.append(band_keys(sig, bands))
                    sigs.append(sig.astype(np.uint16).tobytes())
                else:
                    nodes.append(None)
                    keys.append(np.zeros(0, np.int64))
                    sigs.append(None)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("copy"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), list_array(flat, np.array([len(k) for k in keys], np.int64)), pa.array(sigs, pa.binary())],
                names=["doc_id", "copy", "n_shingles", "node", "bands", "sig"],
            )

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("copy"))
    return source.mapInArrow(sign, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, copy long, n_shingles long, node binary, bands array<long>, sig binary")


def bit_filter(keys: DataFrame, key: str, bits_per_key: int = 16, most_bits: int = 1 << 26) -> tuple[np.ndarray, int]:
    """A bitmap of hashed keys. Its size follows their number up to 8 MB; a full one lets more through, which only costs time."""
    count = keys.count()
    bits = 1 << max(16, min(most_bits.bit_length() - 1, (bits_per_key * max(count, 1)).bit_length()))
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    words = keys.select((at / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}), 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(bits // 64, dtype=np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column("w").to_numpy()] = batch.column("b").to_numpy()
    return out.view(np.uint64), bits


def maybe_in(bitmap: np.ndarray, bits: int, hashed: np.ndarray) -> np.ndarray:
    at = np.mod(hashed, bits)
    return (bitmap[at // 64] >> np.mod(hashed, 64).astype(np.uint64)) & np.uint64(1) == 1


def _sets(docs: DataFrame, nodes: DataFrame, conf: NearDup, id_col: str, text_col: str) -> DataFrame:
    """node, set: the shingle hashes of these nodes (and of a few others that the bitmap lets through)."""
    bitmap, bits = bit_filter(nodes.select("rep"), "rep")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    width = conf.width
    source = docs.where(F.col(id_col).isNotNull()).select(F.xxhash64(id_col).alias("hashed"), F.col(text_col).alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").filter(pa.array(maybe_in(shared.value, bits, batch.column("hashed").to_numpy())))
            for a in range(0, len(texts), 1000):
                own = [s for s in (shingles(t.as_py(), width) for t in texts.slice(a, 1000)) if len(s)]
                if own:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in own], pa.binary()), list_array(np.concatenate(own).view(np.int64), np.array([len(s) for s in own]))],
                        names=["node", "set"],
                    )

    return source.mapInArrow(build, "node binary, set array<long>")


def _agreeing(pairs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree in at least so many rows."""
    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            lanes = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(len(batch), -1) for c in ("sa", "sb")]
            hit = (lanes[0] == lanes[1]).sum(axis=1) >= least
            yield batch.select(["a", "b"]).filter(pa.array(hit))

    return both.select("a", "b", "sa", "sb").mapInArrow(agree, "a binary, b binary")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs confirmed on the full sets, as edges u, v."""
    one = sets.select(F.col("node").alias("a"), F.col("set").alias("xa"))
    two = sets.select(F.col("node").alias("b"), F.col("set").alias("xb"))
    common = F.size(F.array_intersect("xa", "xb"))
    sized = pairs.join(one, "a").join(two, "b").select("a", "b", common.alias("i"), (F.size("xa") + F.size("xb")).alias("n"))
    return sized.where(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _shared(keys: DataFrame) -> DataFrame:
    """Members (key, node, size, deg) of buckets of two nodes or more; ``deg``: in how many such buckets the node is."""
    several = keys.groupBy("key").count().where(F.col("count") > 1).select("key")
    members = materialize(keys.join(several, "key", "left_semi").select("key", "node", "size"), "members")
    return materialize(members.join(members.groupBy("node").agg(F.count("*").alias("deg")), "node"), "members")


def _star_pairs(members: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket with the centre of its bucket."""
    centre = members.groupBy("key").agg(F.max(F.struct("deg", "node")).alias("top")).select("key", F.col("top.node").alias("b"))
    return members.join(centre, "key").where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b").distinct()


def _cells(members: DataFrame, found: DataFrame, sets: DataFrame, cell: int | None = None) -> DataFrame:
    """(key, cell, node, c, minor, resident, set): the open buckets, cut into cells of about twice ``cell`` (``CELL``) shingles at most.

    All members of a bucket are dealt into blocks, and those outside its largest component once more into blocks of their
    own; a cell holds one block of each kind, so each pair of different components meets in one cell, and no cell holds more than two blocks.
    """
    placed = members.join(found, "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("c"))
    parts = placed.groupBy("key", "c").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    open_ = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("size").alias("size"), F.max(F.struct("n", "c", "size")).alias("largest")).where("parts > 1")
    blocks = lambda size: F.ceil(size / (cell or CELL)).cast("int")
    open_ = materialize(open_.select("key", F.col("largest.c").alias("largest"), blocks(F.col("size")).alias("homes"), blocks(F.col("size") - F.col("largest.size")).alias("lots")), "open")
    of = lambda count, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(count)).cast("int")
    rows = placed.join(open_, "key").select("key", "node", "c", (F.col("c") != F.col("largest")).alias("outside"), "homes", "lots", of("homes", SEED).alias("home"), of("lots", SEED + 1).alias("lot"))
    every = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    home = F.transform(every("lots"), lambda i: F.struct(F.struct(i.alias("lot"), F.col("home")).alias("cell"), F.lit(False).alias("minor"), F.lit(True).alias("resident")))
    visit = F.transform(every("homes"), lambda j: F.struct(F.struct(F.col("lot"), j.alias("home")).alias("cell"), F.lit(True).alias("minor"), F.lit(False).alias("resident")))
    dealt = rows.select("key", "node", "c", F.inline(F.concat(home, F.when(F.col("outside"), visit).otherwise(F.slice(visit, 1, 0)))))
    dealt = dealt.select("key", (F.col("cell.lot").cast("long") * (1 << 31) + F.col("cell.home")).alias("cell"), "node", "c", "minor", "resident")
    return dealt.join(sets, "node").select("key", "cell", "node", "c", "minor", "resident", "set").repartition("key", "cell").sortWithinPartitions("key", "cell")


def _common(rows: np.ndarray, values: np.ndarray, edges: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of ``rows``: the run, and how many values each of its rows has in common with each row of ``own``.

    ``values``, ``edges``: distinct values row by row. What many rows of ``own`` hold is counted by a product of
    0/1 matrices, whose size follows that of the input; the rest by posting lists, which are short.
    """
    sizes, n = np.diff(edges), len(own)
    taken = lambda some: np.concatenate([values[edges[k] : edges[k + 1]] for k in some])
    items = taken(own)
    order = np.argsort(items, kind="stable")
    items, holder = items[order], np.repeat(np.arange(n), sizes[own])[order]
    keys, first, count = np.unique(items, return_index=True, return_counts=True)
    often = count * DENSE >= n
    column = np.where(often, np.cumsum(often) - 1, -1)
    wide = int(often.sum())

    def matrix(key: np.ndarray, row: np.ndarray, height: int) -> np.ndarray:
        out = np.zeros((height, wide), np.float32)
        hit = column[key] >= 0
        out[row[hit], column[key[hit]]] = 1
        return out

    dense = matrix(np.repeat(np.arange(len(keys)), count), holder, n).T
    step = max(1, min(512, 4_000_000 // n, 8_000_000 // max(wide, 1)))
    for a in range(0, len(rows), step):
        run = rows[a : a + step]
        mine, row = taken(run), np.repeat(np.arange(len(run)), sizes[run])
        key = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
        known = keys[key] == mine
        key, row = key[known], row[known]
        common = (matrix(key, row, len(run)) @ dense).astype(np.int64)
        seldom = ~often[key]
        key, row = key[seldom], row[seldom]
        length = count[key]
        at = np.repeat(first[key] - np.cumsum(length) + length, length) + np.arange(length.sum())
        yield run, common + np.bincount(np.repeat(row, length) * n + holder[at], minlength=len(run) * n).reshape(len(run), n)


def _cell_links(rows: pa.Table, percent: int) -> Iterator[tuple[bytes, bytes]]:
    """Links between the components of one cell, counted on the full sets."""
    column = lambda name: rows.column(name).combine_chunks()
    part = column("c").dictionary_encode().indices.to_numpy()
    minor, resident = (column(c).to_numpy(zero_copy_only=False) for c in ("minor", "resident"))
    own = np.flatnonzero(resident)
    if part.max() == 0 or not len(own):
        return
    root = np.arange(part.max() + 1)
    nodes, lists = column("node"), column("set")
    edges = lists.offsets.to_numpy()
    sizes = np.diff(edges)
    for run, common in _common(np.flatnonzero(minor), lists.values.to_numpy(), edges, own):
        linked = 100 * common >= percent * (sizes[run][:, None] + sizes[own] - common)
        for i, j in zip(*np.nonzero(linked & (root[part[run]][:, None] != root[part[own]])), strict=True):
            k, m = int(run[i]), int(own[j])
            if root[part[k]] != root[part[m]]:  # one link joins two components
                yield nodes[k].as_py(), nodes[m].as_py()
                root[root == root[part[m]]] = root[part[k]]


def _bucket_links(members: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges u, v that join all components with a linked pair in a common bucket."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links_of(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            links = list(_cell_links(pa.Table.from_batches(rows), percent))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["u", "v"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            ids = np.stack([batch.column(c).to_numpy() for c in ("key", "cell")])
            cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and last != tuple(ids[:, a]):
                    yield links_of(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = tuple(ids[:, a])
        if held:
            yield links_of(held)

    return _cells(members, found, sets).mapInArrow(compare, "u binary, v binary").distinct()


def _placed(docs: DataFrame, conf: NearDup, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, node, copy (digest of the text), least (least id reachable, null for a null id), first (that row's id and node)."""
    docs = small_batches(docs)
    signed = materialize(_signatures(docs, conf, id_col, text_col), "signatures")
    nodes = (
        signed.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("node")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    )
    nodes = materialize(nodes, "nodes")
    members = _shared(nodes.select("node", "size", F.explode("bands").alias("key")))
    active = materialize(members.select("node").distinct().join(nodes.select("node", "rep", "sig"), "node"), "active")
    sets = materialize(_sets(docs, active, conf, id_col, text_col).dropDuplicates(["node"]), "sets")
    stars = materialize(_linked(_agreeing(_star_pairs(members), active.select("node", "sig"), conf.least_agreeing), sets, conf.percent), "links")
    found = materialize(connected_components(stars), "components")
    more = materialize(_bucket_links(members, found, sets, conf.percent), "links")
    if not more.isEmpty():
        chains = found.where(F.col("node") != F.col("component")).select(F.col("node").alias("u"), F.col("component").alias("v"))
        found = materialize(connected_components(chains.unionByName(more)), "components")

    # Only sets that several rows hold, or that are linked, have to be looked up: any other row is its own component.
    reps = nodes.select("node", "rep", "rows").join(found, "node", "left")
    reps = materialize(reps.where("rows > 1 or component is not null").select("node", F.struct("rep", "node").alias("own"), F.coalesce("component", "node").alias("c")), "representatives")
    least = materialize(reps.groupBy("c").agg(F.min("own").alias("first")), "least")
    lookup = reps.join(least, "c").select("node", "first")
    placed = signed.select("doc_id", "n_shingles", "node", "copy").join(lookup, "node", "left")
    first = F.coalesce("first", F.struct(F.col("doc_id").alias("rep"), "node"))
    return placed.select("doc_id", "n_shingles", "node", "copy", F.when(F.col("doc_id").isNotNull(), first).alias("first"))


def near_duplicates(docs: DataFrame, conf: NearDup | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (least id reachable), kept."""
    component = F.col("first.rep")
    return _placed(docs, conf or NearDup(), id_col, text_col).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _may_be_in(rows: DataFrame, keys: DataFrame) -> Column:
    """Whether a row of ``rows`` may stand in ``keys`` by its columns: always true where it does, seldom where not. So only few whole texts
    meet ``keys`` in a join, whether or not these are few enough to be broadcast."""
    bitmap, bits = bit_filter(keys.select(F.xxhash64(*keys.columns).alias("_key")), "_key")
    shared = keys.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def hit(hashed: pd.Series) -> pd.Series:
        return pd.Series(maybe_in(shared.value, bits, hashed.to_numpy()))

    return hit(F.xxhash64(F.xxhash64(*[rows[c] for c in keys.columns])))


def keep_one_of_each(docs: DataFrame, conf: NearDup | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the least id. Rows with a null id, or without words, stay.

    Rows are told apart by id and text, so of rows that repeat an id each is judged by its own text.
    """
    rows = _placed(docs, conf or NearDup(), id_col, text_col).where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    by_text = rows.groupBy("first", "doc_id", "node", "copy").agg(F.count("*").alias("n"))
    chosen = F.struct(F.col("doc_id").alias("rep"), "node") == F.col("first")
    by_text = materialize(by_text.select("doc_id", "node", "copy", "n", chosen.alias("chosen")), "copies")
    # Where the chosen id repeats, one of its texts and one row of that stays.
    again = by_text.where("chosen").groupBy("doc_id", "node").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.min("copy").alias("copy")).where("n > 1")
    again = materialize(again, "repeated")
    gone = by_text.where("not chosen").select(F.col("doc_id").alias(id_col), F.col("copy").alias("_copy"))
    marked = docs.withColumn("_copy", F.xxhash64(F.col(text_col)))
    if again.isEmpty():
        gone = materialize(gone.distinct(), "gone")
        touched = _may_be_in(marked, gone)
        return marked.where(~touched).unionByName(marked.where(touched).join(gone, [id_col, "_copy"], "left_anti")).select(*docs.columns)
    others = by_text.where("chosen").alias("t").join(again.alias("r"), ["doc_id", "node"]).where(F.col("t.copy") != F.col("r.copy"))
    gone = materialize(gone.unionByName(others.select(F.col("doc_id").alias(id_col), F.col("t.copy").alias("_copy"))).distinct(), "gone")
    once = again.select(F.col("doc_id").alias(id_col), F.col("copy").alias("_copy"))
    touched = _may_be_in(marked, gone.unionByName(once))
    left = marked.where(touched).join(gone, [id_col, "_copy"], "left_anti")
    single = left.join(once, [id_col, "_copy"], "left_anti")
    kept = single.unionByName(left.join(once, [id_col, "_copy"], "left_semi").dropDuplicates([id_col, "_copy"]))
    return marked.where(~touched).unionByName(kept).select(*docs.columns)


def _sql_words(column: str) -> str:
    return f"string_split_regex(trim({column}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\\x20\\x09-\\x0D]+')"


ORACLE_SQL = f"""
WITH RECURSIVE lowered AS (
  SELECT doc_id, trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM documents
), split AS (
  SELECT doc_id, CASE WHEN t = '' THEN [] ELSE {_sql_words("t")} END AS w FROM lowered
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM split
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common WHERE 100 * i >= 85 * (na + nb - i)
), ways AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT ways.b, reach.r FROM reach JOIN ways ON ways.a = reach.doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.r) AS component_id, s.doc_id = min(r.r) AS kept
FROM sets s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s
"""
