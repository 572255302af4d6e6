"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlake.common import materialize

MAX_ROUNDS = 40


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: hook the neighbours of each node onto the least node seen there."""
    forward = edges.select("u", "v")
    around = forward.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = around.join(least, "u").where(F.col("v") > F.col("u"))
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = around.where(F.col("v") < F.col("u"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its least node) of every node that has an edge. ``edges``: columns u, v.

    Each round is written to the shared folder, so a lost executor costs one round at most; the driver
    sees only a count and a checksum.
    """
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    current = materialize(edges.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "edges")
    seen = mark(current)
    for _ in range(MAX_ROUNDS):
        if seen[0] == 0:
            break
        current = materialize(_stars(_stars(current, True), False), "edges")
        now = mark(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
