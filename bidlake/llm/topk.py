"""Exact top-k by inner product with a pivot-distance index.

Vectors become integers, and one more coordinate sqrt(M^2 - |v|^2) brings them all to the same norm M, so
that a larger inner product is a smaller distance and the triangle inequality holds. The index keys every
vector by its nearest pivot and its distance to it, cut into rings (annuli) and, where a ring has many
rows, into parts by hash of the id.

A query first meets one part of its own ring, which gives it a lower bound for its k-th score. It then
expands to the rings in order of their least possible distance, in waves of which each opens ``WAVE`` times
as many rings as all before it and raises the bound, and stops where the triangle inequality says that no
vector of a further ring can reach it. Rings and queries meet in blocks of bounded size.

Pivots are fitted on a bounded sample (``SAMPLE`` vectors by hash of the id); every vector is indexed.
Arithmetic is exact: integer-valued doubles while their products stay below 2^53, 64-bit integers beyond.

Defined results: a vector that is null or holds null or non-finite components takes no part, nor does a
row without id; components that a shorter vector lacks count as 0, so those of a query beyond the longest vector do not matter; ties go to the smaller id; a query that
repeats an id is answered once; other rows that repeat an id stay candidates; extra columns are ignored; an
empty table gives an empty table. A score that does not fit 64 bits (norms of about 1e7 and more) has no
defined value, and components of 1e300 and more count as not finite.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.common import materialize

PIVOTS = 24
RINGS = 24
SAMPLE = 2_048
LEAST_SEGMENT, MOST_SEGMENT = 128, 8_192
QUERY_BLOCK = 512
WAVE = 4
STEP = 1_024  # queries whose bounds to all rings are held at once
EXACT = float(1 << 53)


def to_integers(vectors: list, dim: int) -> np.ndarray:
    """floor(256 x) of each component, as integer-valued doubles, padded with zeros or cut to ``dim``."""
    out = np.zeros((len(vectors), dim))
    for k, v in enumerate(vectors):
        part = np.floor(256.0 * np.asarray(v[:dim], dtype=np.float64))
        out[k, : len(part)] = part
    return out


def usable(vector: Column) -> Column:
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e300))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


@dataclass(frozen=True)
class Rings:
    """The directory of the index: bounded by pivots times rings, whatever the number of vectors."""

    pivots: np.ndarray
    norm2: float
    width: float
    dim: int
    key: np.ndarray  # pivot, ring
    low: np.ndarray
    high: np.ndarray
    parts: np.ndarray

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.norm2 - (x * x).sum(axis=1), 0.0))

    def distances(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        full = np.concatenate([x, last[:, None]], axis=1)
        square = (full * full).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * full @ self.pivots.T
        return np.sqrt(np.maximum(square, 0.0))

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and ring: the least distance, and the highest inner product that allows."""
        to_pivot = self.distances(x, np.zeros(len(x)))[:, self.key[:, 0]]
        least = np.maximum(np.maximum(to_pivot - self.high, self.low - to_pivot), 0.0)
        return least, ((x * x).sum(axis=1)[:, None] + self.norm2 - least * least) / 2


def fit_pivots(sample: np.ndarray, count: int, steps: int = 5) -> np.ndarray:
    """Spread starting points, then a few k-means steps."""
    rng = np.random.default_rng(7)
    chosen = [sample[rng.integers(len(sample))]]
    gap = ((sample - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < count and gap.max() > 0:
        chosen.append(sample[gap.argmax()])
        gap = np.minimum(gap, ((sample - chosen[-1]) ** 2).sum(axis=1))
    pivots = np.array(chosen)
    for _ in range(steps):
        near = ((sample * sample).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * sample @ pivots.T).argmin(axis=1)
        pivots = np.array([sample[near == k].mean(axis=0) if (near == k).any() else pivots[k] for k in range(len(pivots))])
    return pivots


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products as int64."""
    most = max(np.abs(q).max(initial=0), 1) * max(np.abs(v).max(initial=0), 1) * q.shape[1]
    return (q @ v.T).astype(np.int64) if most < EXACT else q.astype(np.int64) @ v.astype(np.int64).T


def build_index(vectors: DataFrame) -> tuple[DataFrame, Rings] | None:
    """``vectors``: vec_id, vector, all usable. Returns the index (pivot, ring, part, vec_id, x) and its shared.value."""
    spark = vectors.sparkSession
    square = F.aggregate(F.transform("vector", lambda c: F.floor(256 * c.cast("double")).cast("double")), F.lit(0.0), lambda s, c: s + c * c)
    stats = vectors.agg(F.count("*").alias("n"), F.max(square).alias("norm2"), F.max(F.size("vector")).alias("dim")).first()
    if not stats["n"]:
        return None
    n, norm2, dim = stats["n"], float(stats["norm2"]), int(stats["dim"])
    chance = F.pmod(F.xxhash64(F.lit("pivot"), "vec_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = vectors.where(chance < min(1.0, SAMPLE / n)).select("vector").limit(4 * SAMPLE).toArrow().column("vector").to_pylist()
    sample = to_integers(picked or vectors.select("vector").limit(1).toArrow().column("vector").to_pylist(), dim)
    none = np.zeros((0, 2), dtype=np.int64)
    start = Rings(np.zeros((1, dim + 1)), norm2, 1.0, dim, none, none[:, 0], none[:, 0], none[:, 0])
    pivots = fit_pivots(np.concatenate([sample, start.lifted(sample)[:, None]], axis=1), PIVOTS)
    width = max(2 * math.sqrt(norm2) / RINGS, 1e-9)
    start = Rings(pivots, norm2, width, dim, none, none[:, 0], none[:, 0], none[:, 0])
    shared = spark.sparkContext.broadcast(start)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings = shared.value
        for batch in batches:
            if len(batch):
                x = to_integers(batch.column("vector").to_pylist(), rings.dim)
                far = rings.distances(x, rings.lifted(x))
                pivot = far.argmin(axis=1)
                own = far[np.arange(len(x)), pivot]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pivot.astype(np.int32)), pa.array((own // rings.width).astype(np.int32)), pa.array(own), batch.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary())],
                    names=["pivot", "ring", "far", "vec_id", "x"],
                )

    keyed = materialize(vectors.select("vec_id", "vector").mapInArrow(key, "pivot int, ring int, far double, vec_id long, x binary"), "pivot-keys")
    table = keyed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).toPandas()
    segment = max(LEAST_SEGMENT, min(MOST_SEGMENT, math.isqrt(n)))
    rings = Rings(
        pivots, norm2, width, dim, table[["pivot", "ring"]].to_numpy(np.int64), table["low"].to_numpy(), table["high"].to_numpy(), np.ceil(table["n"].to_numpy() / segment).astype(np.int64)
    )
    parts = spark.createDataFrame([(int(p), int(r), int(c)) for (p, r), c in zip(rings.key, rings.parts, strict=True)], "pivot int, ring int, parts int")
    cut = F.pmod(F.xxhash64(F.lit("part"), "vec_id"), F.col("parts")).cast("int").alias("part")
    return keyed.join(F.broadcast(parts), ["pivot", "ring"]).select("pivot", "ring", cut, "vec_id", "x"), rings


def _search(index: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each visited part. ``visits``: query_id, block, q, pivot, ring, part."""
    keys = ["pivot", "ring", "part", "block"]
    # Each block of queries gets its own copy of the parts that it visits, and no other part.
    wanted = visits.select(*keys).distinct().select(*[F.col(c).alias(f"w_{c}") for c in keys])
    same = (F.col("pivot") == F.col("w_pivot")) & (F.col("ring") == F.col("w_ring")) & (F.col("part") == F.col("w_part"))
    rows = index.join(wanted, same).select("pivot", "ring", "part", F.col("w_block").alias("block"), "vec_id", "x")

    def best(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(vectors):
            vectors = vectors.sort_by("vec_id")
            q = np.frombuffer(b"".join(queries.column("q").to_pylist())).reshape(len(queries), -1)
            v = np.frombuffer(b"".join(vectors.column("x").to_pylist())).reshape(len(vectors), -1)
            ids, own = vectors.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
            score = products(q, v)
            for a, line in zip(own, score, strict=True):
                other = np.flatnonzero(ids != a)
                top = other[np.argsort(-line[other], kind="stable")[:k]]
                out["query_id"].append(np.full(len(top), a))
                out["vec_id"].append(ids[top])
                out["score"].append(line[top])
        return pa.table({c: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)) for c, x in out.items()})

    grouped = visits.select(*keys, "query_id", "q").groupBy(*keys).cogroup(rows.select(*keys, "vec_id", "x").groupBy(*keys))
    return grouped.applyInArrow(best, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score. Both inputs: vec_id long, vector array; a query's own id is no candidate."""
    spark = vectors.sparkSession
    usable_rows = F.col("vec_id").isNotNull() & usable(F.col("vector"))
    vectors, queries = vectors.where(usable_rows), queries.where(usable_rows)
    built = build_index(vectors)
    schema = "query_id long, rank int, vec_id long, score long"
    if built is None:
        return spark.createDataFrame([], schema)
    index, rings = materialize(built[0], "pivot-index"), built[1]
    asked = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    shared = spark.sparkContext.broadcast(rings)

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                q = to_integers(batch.column("vector").to_pylist(), shared.value.dim)
                home = np.concatenate([shared.value.bounds(q[a : a + STEP])[0].argmin(axis=1) for a in range(0, len(q), STEP)])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(home.astype(np.int32)), pa.array([r.tobytes() for r in q], pa.binary())], names=["query_id", "home", "q"])

    asked = materialize(asked.select("vec_id", "vector").mapInArrow(integers, "query_id long, home int, q binary"), "queries")
    # Queries of neighbouring home rings share a block, so that a block opens few rings; a crowded home fills several.
    homes, before = [], 0
    for r in asked.groupBy("home").count().orderBy("home").collect():
        homes.append((r["home"], before // QUERY_BLOCK, -(-r["count"] // QUERY_BLOCK)))
        before += r["count"]
    lots = F.broadcast(spark.createDataFrame(homes, "home int, _from long, _lots long"))
    lot = F.pmod(F.xxhash64(F.lit("block"), "query_id"), F.col("_lots"))
    asked = asked.join(lots, "home").select("query_id", (F.col("_from") + lot).cast("int").alias("block"), "q")

    def opened(batch: pa.RecordBatch, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, ring, whether it is the query's home) of the rings at places ``first`` to ``last`` from the nearest outwards that may still hold one of the k best."""
        q = np.frombuffer(b"".join(batch.column("q").to_pylist())).reshape(len(batch), -1)
        least, most = shared.value.bounds(q)
        order = least.argsort(axis=1, kind="stable")[:, first:last]
        floor = batch.column("floor").fill_null(-(1 << 62)).to_numpy(zero_copy_only=False).astype(np.float64)
        slack = 1e-3 + 1e-9 * ((q * q).sum(axis=1) + shared.value.norm2)
        row, place = np.nonzero(np.take_along_axis(most, order, axis=1) >= (floor - slack)[:, None])
        return row, order[row, place], place + first == 0

    def left(batches: Iterator[pa.RecordBatch], first: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = sum(len(opened(batch.slice(a, STEP), first, len(shared.value.parts))[0]) for a in range(0, len(batch), STEP))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    def visits(batches: Iterator[pa.RecordBatch], first: int, last: int, seed: bool) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), STEP):
                batch = whole.slice(a, STEP)
                row, ring, home = opened(batch, first, last)
                parts = shared.value.parts[ring]
                start = np.repeat(np.cumsum(parts) - parts, parts)
                row, ring, home = np.repeat(row, parts), np.repeat(ring, parts), np.repeat(home, parts)
                part = np.arange(len(row)) - start
                own = home & (part == np.mod(batch.column("query_id").to_numpy()[row], shared.value.parts[ring]))
                keep = own if seed else ~own
                row, ring, part = row[keep], ring[keep], part[keep]
                for b in range(0, len(row), 20_000):
                    take, g = pa.array(row[b : b + 20_000]), shared.value.key[ring[b : b + 20_000]].astype(np.int32)
                    columns = [batch.column(c).take(take) for c in ("query_id", "block", "q")] + [pa.array(g[:, 0]), pa.array(g[:, 1]), pa.array(part[b : b + 20_000].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "block", "q", "pivot", "ring", "part"])

    visit = "query_id long, block int, q binary, pivot int, ring int, part int"
    in_order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= k)
    seeds = asked.withColumn("floor", F.lit(None).cast("long")).mapInArrow(lambda b: visits(b, 0, 1, True), visit)
    best = materialize(ranked(_search(index, seeds, k)), "nearest")
    first, last = 0, WAVE
    while first < len(rings.parts):
        floors = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        bounded = materialize(asked.join(floors, "query_id", "left").select("query_id", "block", "q", "floor"), "bounds")
        if not bounded.mapInArrow(lambda b, first=first: left(b, first), "n long").agg(F.sum("n")).first()[0]:
            break
        found = _search(index, bounded.mapInArrow(lambda b, first=first, last=last: visits(b, first, last, False), visit), k)
        best = materialize(ranked(best.drop("rank").unionByName(found)), "nearest")
        first, last = last, last * WAVE
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def embedding_neighbours(embeddings: DataFrame) -> DataFrame:
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
