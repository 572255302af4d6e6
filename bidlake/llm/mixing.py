"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources a document belongs to). Flow runs from
each pattern, as capacity in words, to the quotas of its sources; the first use of a pattern's words is
free and each repetition costs more than the one before, so repetition is spread before it is deepened.
The flow gives each pattern a mean number of uses; its documents are used ``floor`` of it times, and a
seeded part of them once more. That part is chosen by hash: sums over hash buckets find the bucket in
which the wanted number of words is reached, and a running sum inside this bucket finds the document.

Only the pattern table (one row a pattern) and the flow are handled by the driver; a pattern count over
``MAX_PATTERNS`` is refused. Documents are never collected.

Defined results: a null text has size 0; a document of size 0 takes 0 words; rows that share an id are told
apart by their texts; rows of equal id and text have one place in the order, and are used equally often; a null source is a source, last in order; an empty
table gives an empty table. No document is used more than ``repeats`` times. Reruns agree.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
REPEATS = 3
SEED = "mix-1"
BUCKETS = 4096
MAX_PATTERNS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quotas(sizes: dict, weights: dict, total: int, repeats: int = REPEATS) -> dict:
    """Share ``total`` by weight; no quota over ``repeats`` times its size, the excess shared again by weight."""
    left, open_, out = Fraction(total), set(sizes), {}
    while open_:
        share = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if weights[s] * share > repeats * sizes[s]]
        if not full:
            out.update({s: weights[s] * share for s in open_})
            break
        for s in full:
            out[s] = Fraction(repeats * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


def route(patterns: dict[tuple, int], quota: dict, repeats: int = REPEATS) -> dict[tuple, dict[int, Fraction]]:
    """Min-cost flow from patterns to source quotas: for each pattern, the words sent at each repetition.

    Layers of a pattern cost 0, 1, 2 ... a word. Successive shortest paths over the residual graph of
    sources: a path starts at a pattern layer with room, may move flow between sources through shared
    patterns, and ends at a source whose quota is open.
    """
    members = {p: list(p) for p in patterns}
    sent = {(p, s): Fraction(0) for p in patterns for s in members[p]}
    need = dict(quota)
    used = {p: Fraction(0) for p in patterns}
    of_source: dict = {}
    for p in patterns:
        for s in members[p]:
            of_source.setdefault(s, []).append(p)

    def layer(p) -> int | None:
        return int(used[p] // patterns[p]) if patterns[p] and used[p] < repeats * patterns[p] else None

    for level in range(repeats):
        moved = True
        while moved:
            moved = False
            for s in [s for s in need if need[s] > 0]:
                # Breadth first from the source backwards: a pattern with room in this layer, or one whose flow to another source can be replaced.
                queue, came, goal = [(0, 0, s)], {s: None}, None
                n = 1
                while queue and goal is None:
                    depth, _, t = heapq.heappop(queue)
                    for p in of_source.get(t, ()):
                        if layer(p) == level:
                            goal = (p, t)
                            break
                        for u in members[p]:
                            if u not in came and u != t and sent[p, u] > 0:
                                came[u] = (p, t)
                                heapq.heappush(queue, (depth + 1, n, u))
                                n += 1
                if goal is None:
                    continue
                p, t = goal
                path, at = [], t
                while came[at] is not None:
                    q, nxt = came[at]
                    path.append((q, at, nxt))
                    at = nxt
                amount = min([need[s], (level + 1) * patterns[p] - used[p]] + [sent[q, a] for q, a, _ in path])
                sent[p, t] += amount
                used[p] += amount
                for q, a, b in path:
                    sent[q, a] -= amount
                    sent[q, b] += amount
                need[s] -= amount
                moved = True
    return {p: {s: sent[p, s] for s in members[p]} for p in patterns}


def mix(docs: DataFrame, memberships: Column, size: Column, targets, order: Column, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """Add ``times``: how often each document is used.

    ``memberships``: sorted array of the document's sources; ``size``: its words; ``targets``: a function
    from {source: size} to {source: quota}; ``order``: what identifies a document for the seeded order.
    Texts are read twice: for a table of sizes and hashes from which the cut is found, and for the result.
    """
    spark = docs.sparkSession
    ranked = docs.withColumns({"_of": memberships, "_size": size, "_hash": F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), order), 256), 1, 15), 16, 10).cast("long")})
    ranked = ranked.withColumn("_bucket", F.shiftright("_hash", 48).cast("int"))
    slim = materialize(ranked.select("_of", "_size", "_hash", "_bucket"), "mix-sizes")
    table = slim.groupBy("_of").agg(F.sum("_size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(table) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r["_of"]): int(r["size"] or 0) for r in table}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    flow = route(patterns, targets(sizes), repeats)
    plan = []
    for p, n in patterns.items():
        words = sum(flow[p].values(), Fraction(0))
        whole = int(words // n) if n else 0
        plan.append((list(p), whole, round(words - whole * n)))
    plan_df = F.broadcast(spark.createDataFrame(plan, "_of array<string>, _whole int, _rest long"))

    buckets = slim.groupBy("_of", "_bucket").agg(F.sum("_size").alias("_sum"))
    in_order = Window.partitionBy("_of").orderBy("_bucket")
    edges = buckets.withColumn("_before", F.sum("_sum").over(in_order.rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["_before"])
    edges = edges.join(plan_df, "_of").where((F.col("_before") < F.col("_rest")) & (F.col("_rest") <= F.col("_before") + F.col("_sum")))
    edges = edges.select("_of", F.col("_bucket").alias("_edge"), "_before")
    inside = slim.join(F.broadcast(edges.withColumnRenamed("_edge", "_bucket")), ["_of", "_bucket"])
    inside = inside.groupBy("_of", "_bucket", "_hash", "_before").agg(F.sum("_size").alias("_own"))
    in_bucket = Window.partitionBy("_of", "_bucket").orderBy("_hash")
    inside = inside.join(plan_df, "_of").withColumn("_upto", F.col("_before") + F.sum("_own").over(in_bucket))
    # A document that crosses the goal is used when that ends nearer to it.
    inside = inside.where(F.col("_upto") - F.col("_rest") <= F.greatest(F.col("_own") - (F.col("_upto") - F.col("_rest")), F.lit(0)))
    cut = inside.groupBy("_of", F.col("_bucket").alias("_edge")).agg(F.max("_hash").alias("_last"))
    plan_cut = plan_df.join(edges.select("_of", "_edge"), "_of", "left").join(cut, ["_of", "_edge"], "left")
    once_more = (F.col("_bucket") < F.col("_edge")) | ((F.col("_bucket") == F.col("_edge")) & (F.col("_hash") <= F.coalesce("_last", F.lit(-1))))
    extra = F.when((F.col("_rest") > 0) & once_more & (F.col("_whole") < repeats), 1).otherwise(0)
    used = ranked.join(F.broadcast(plan_cut), "_of", "left").withColumn("times", F.when(F.col("_size") > 0, F.col("_whole") + extra).otherwise(0).cast("int"))
    return used.drop("_of", "_size", "_hash", "_bucket", "_whole", "_rest", "_edge", "_last")


NULL_SOURCE = "\0"  # stands for a null source in patterns; sorted last by ``source_order``


def source_order(source: str) -> tuple:
    return (source == NULL_SOURCE, source)


def cycle_targets(sizes: dict) -> dict:
    """Sources by code point, null last, weigh 5, 2, 1, 5, 2, 1 ... and share all words."""
    names = sorted(sizes, key=source_order)
    return quotas(sizes, {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}, sum(sizes.values()))


def mix_documents(docs: DataFrame, size: Column, digest: Column) -> DataFrame:
    """``docs`` with ``times``; each document belongs to its one source. ``digest``: of its text, to tell apart rows that share an id."""
    return mix(docs, F.array(F.coalesce("source", F.lit(NULL_SOURCE))), size, cycle_targets, F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest))


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes of it."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5("text").alias("digest")), "mix-documents")
    used = mix_documents(sized, F.col("size"), F.col("digest"))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = {NULL_SOURCE if r["source"] is None else r["source"]: int(r["source_size"]) for r in sizes.collect()}
    target = cycle_targets(rows)
    lookup = docs.sparkSession.createDataFrame([(s, n, float(target[s])) for s, n in rows.items()], "_key string, source_size long, target double")
    return (
        used.withColumn("_key", F.coalesce("source", F.lit(NULL_SOURCE)))
        .join(F.broadcast(lookup), "_key", "left")
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
    )


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is used, with the columns of ``docs``."""
    used = mix_documents(docs, word_count(F.col("text")), F.md5("text"))
    repeated = used.where(F.col("times") > 0).withColumn("_n", F.explode(F.sequence(F.lit(1), "times")))
    return repeated.select(*docs.columns)
