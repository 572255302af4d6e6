"""Fuzzy look-up of labels in a dictionary of aliases, without comparing every label with every alias.

The score of two keys is the weighted ratio: the indel ratio (twice the longest common subsequence over both lengths),
that of the sorted words and of the word sets at 95 %, and, where one key is at least half as long again as the other, the best
ratio of the shorter with a part of the longer at 90 % (60 % beyond eight times the length). A match needs ``ENOUGH`` points
and ``SECOND`` points of a second opinion that knows no parts: the better of the plain and the sorted ratio.

Such a pair agrees in one of a few ways, each of which is an equi-join that loses none of them (``candidates``):
* the plain or the sorted ratio is high. Then the keys share so many pairs of letters that, in any common order of all
  pairs, the first few of each key must meet; the order puts rare pairs first;
* they share a word;
* one holds nearly all of the other. Then the rarest few pairs of the shorter are among those of the longer.
Scores are counted for candidates only, many at a time, by bit-parallel subsequences.

Defined results: a null or empty key is unmatched; keys that repeat are looked up once; of equal aliases the first wins; an empty
dictionary leaves all unmatched.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.common import materialize

ENOUGH, SECOND, MARGIN = 85.0, 75.0, 8.0
SETS, PARTS, FAR_PARTS = 0.95, 0.9, 0.6
LONGER, FAR = 1.5, 8.0
CHUNK = 20_000
ALL_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one addition a letter on numbers as long as ``a``."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        hit = open_ & where.get(c, 0)
        open_ = (open_ + hit | open_ - hit) & full
    return len(a) - open_.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * subsequence(a, b) / (len(a) + len(b)) if a or b else 100.0


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """``ratio`` of many pairs at once; keys of over 64 letters one by one."""
    size_a, size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out = np.zeros(len(a))
    for k in np.flatnonzero(size_a > 64):
        out[k] = ratio(a[k], b[k])
    short = np.flatnonzero(size_a <= 64)
    for s in range(0, len(short), CHUNK):
        rows = short[s : s + CHUNK]
        own, other = [a[k] for k in rows], [b[k] for k in rows]
        letters, code = np.unique(np.array(list("".join(own + other)), dtype="<U1"), return_inverse=True)
        pad = len(letters)

        def table(sizes: np.ndarray, flat: np.ndarray, pad: int = pad) -> np.ndarray:
            grid = np.full((len(sizes), max(int(sizes.max(initial=0)), 1)), pad)
            grid[np.arange(grid.shape[1]) < sizes[:, None]] = flat
            return grid

        first = int(size_a[rows].sum())
        one, two = table(size_a[rows], code[:first]), table(size_b[rows], code[first:])
        at = np.arange(len(rows))
        where = np.zeros((len(rows), pad + 1), np.uint64)
        for k in range(one.shape[1]):
            where[at, one[:, k]] |= np.uint64(1 << k)
        where[:, pad] = 0
        open_ = np.full(len(rows), ALL_ONES)
        for k in range(two.shape[1]):
            hit = open_ & where[at, two[:, k]]
            open_ = (open_ + hit) | (open_ - hit)
        held = ~open_
        full = np.where(size_a[rows] == 64, ALL_ONES, (np.uint64(1) << (size_a[rows] % 64).astype(np.uint64)) - np.uint64(1))
        length = size_a[rows] + size_b[rows]
        out[rows] = np.where(length > 0, 200.0 * np.bitwise_count(held & full) / np.maximum(length, 1), 100.0)
    return out


def sorted_words(key: str) -> str:
    return " ".join(sorted(key.split()))


def part_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter key with a run of letters of the longer that is as long, or shorter at an end."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not a or a in b:
        return 100.0 if a or not b else 0.0
    return max(ratio(a, b[max(k, 0) : k + len(a)]) for k in range(1 - len(a), len(b)))


def set_ratio(a: str, b: str) -> float:
    """Ratio of what the words in common make up, alone or with the words of either side."""
    one, two = set(a.split()), set(b.split())
    if not one or not two:
        return 0.0
    both, left, right = (" ".join(sorted(x)) for x in (one & two, one - two, two - one))
    if both and (not left or not right):
        return 100.0
    gap = len(both) + 1 if both else 0
    lengths = gap + len(left), gap + len(right)
    apart = len(left) + len(right) - 2 * subsequence(left, right)
    best = 100.0 * (1 - apart / sum(lengths))
    if both:
        best = max(best, *(200.0 * len(both) / (len(both) + n) for n in lengths))
    return best


def weighted(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    long = max(len(a), len(b)) / min(len(a), len(b))
    if long < LONGER:
        return max(ratio(a, b), SETS * ratio(sorted_words(a), sorted_words(b)), SETS * set_ratio(a, b))
    scale = PARTS if long <= FAR else FAR_PARTS
    words = 100.0 if set(a.split()) & set(b.split()) else part_ratio(sorted_words(a), sorted_words(b))
    return max(ratio(a, b), scale * part_ratio(a, b), SETS * scale * words)


def letter_pairs(key: str) -> list[str]:
    """Pairs of neighbouring letters, told apart by how often they have occurred before."""
    seen: Counter = Counter()
    out = []
    for k in range(len(key) - 1):
        pair = key[k : k + 2]
        out.append(f"{pair}{seen[pair]}")
        seen[pair] += 1
    return out


def least_shared(length: int, percent: float) -> int:
    """Letter pairs that a key shares with any key whose ratio with it is ``percent``.

    A subsequence of L letters of keys of S letters in all leaves 3 L - S - 1 pairs, since a letter that is
    left out breaks two pairs of its key and one of the other's.
    """
    t = percent / 100
    total = length + math.ceil(length * t / (2 - t) - 1e-9)
    return max(1, math.ceil((1.5 * t - 1) * total - 1 - 1e-9))


def _grams(rank: dict[str, int], percent: float | None):
    """UDF: the first pairs of a key in the common order that have to be looked up; all of them without a percentage."""

    @F.pandas_udf("array<string>")
    def run(keys: pd.Series) -> pd.Series:
        out = []
        for key in keys:
            pairs = sorted(letter_pairs(key), key=lambda p: (rank.get(p[:2], 0), p))
            if percent is not None:
                pairs = pairs[: max(len(pairs) - least_shared(len(key), percent) + 1, 0)]
            out.append(pairs)
        return pd.Series(out, dtype=object)

    return run


def _held_grams(rank: dict[str, int]):
    """UDF: pairs of a shorter key of which one at least is in a key that holds nearly all of it; single letters stand for themselves."""
    part = ENOUGH / PARTS / 100

    @F.pandas_udf("array<string>")
    def run(keys: pd.Series) -> pd.Series:
        out = []
        for key in keys:
            pairs = sorted(letter_pairs(key), key=lambda p: (rank.get(p[:2], 0), p))
            run_length = math.ceil(len(key) * part / (2 - part) - 1e-9)
            least = max(1, math.ceil((1.5 * part - 1) * (len(key) + run_length) - 1 - 1e-9))
            out.append(pairs[: max(len(pairs) - least + 1, 0)] if len(key) > 1 else list(key))
        return pd.Series(out, dtype=object)

    return run


def _all_grams():
    """UDF: all pairs and letters of a key."""

    @F.pandas_udf("array<string>")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series([letter_pairs(k) + sorted(set(k)) for k in keys], dtype=object)

    return run


def _words(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, " "), lambda w: w != ""))


def _ranks(keys: DataFrame, aliases: DataFrame) -> dict[str, int]:
    """Place of each pair of letters, rare ones first. Keys are of ASCII letters, digits and spaces: 37^2 pairs at most."""
    both = keys.select("key").unionByName(aliases.select(F.col("alias").alias("key"))).where(F.length("key") > 1)
    pairs = both.select("key", F.explode(F.sequence(F.lit(1), F.length("key") - 1)).alias("k")).groupBy(F.col("key").substr(F.col("k"), F.lit(2)).alias("pair")).count()
    return {r["pair"]: k for k, r in enumerate(pairs.orderBy("count", "pair").limit(37 * 37).collect())}


FORMS = {
    "plain": (lambda k: k, ENOUGH),
    "sorted": (lambda k: F.array_join(F.array_sort(F.split(k, " ")), " "), ENOUGH / SETS),
    "set": (lambda k: F.array_join(F.array_sort(_words(k)), " "), ENOUGH / SETS),
}


def _alike(percent: float) -> Column:
    """Whether lengths allow for such a ratio."""
    t = percent / 100
    return F.least(F.length("key"), F.length("alias")) >= F.greatest(F.length("key"), F.length("alias")) * (t / (2 - t)) - 1e-9


def _by_pairs(keys: DataFrame, aliases: DataFrame, rank: dict[str, int], name: str) -> DataFrame:
    """(key, alias) whose ratio in the named form may be high enough."""
    form, percent = FORMS[name]
    side = lambda df, c: df.select(c, F.explode(_grams(rank, percent)(form(F.col(c)))).alias("gram"))
    met = side(keys, "key").join(side(aliases, "alias"), "gram")
    return (met if name == "set" else met.where(_alike(percent))).select("key", "alias")  # a set of words may be shorter than its key


def candidates(keys: DataFrame, aliases: DataFrame, rank: dict[str, int] | None = None) -> DataFrame:
    """Distinct (key, alias) that hold every pair with a weighted ratio of ``ENOUGH`` and a second opinion of ``SECOND``.

    ``keys``: key; ``aliases``: alias; both distinct, neither null nor empty.
    """
    rank = _ranks(keys, aliases) if rank is None else rank
    words = keys.select("key", F.explode(_words(F.col("key"))).alias("word")).join(aliases.select("alias", F.explode(_words(F.col("alias"))).alias("word")), "word")
    found = words.select("key", "alias").unionByName(_holding(keys, aliases, rank)).where(_alike(SECOND))
    for name in FORMS:
        found = found.unionByName(_by_pairs(keys, aliases, rank, name))
    return found.distinct()


def _holding(keys: DataFrame, aliases: DataFrame, rank: dict[str, int]) -> DataFrame:
    """(key, alias) of which one, at least half as long again, may hold nearly all of the other, plainly or with its words sorted."""
    ordered = lambda c: F.array_join(F.array_sort(F.split(F.col(c), " ")), " ")
    out = None
    for form in (F.col, ordered):
        few = lambda df, c, form=form: df.select(c, F.explode(_held_grams(rank)(form(c))).alias("gram"))
        every = lambda df, c, form=form: df.select(c, F.explode(_all_grams()(form(c))).alias("gram"))
        one = few(keys, "key").join(every(aliases, "alias"), "gram").where(F.length("alias") >= LONGER * F.length("key"))
        two = every(keys, "key").join(few(aliases, "alias"), "gram").where(F.length("key") >= LONGER * F.length("alias"))
        both = one.select("key", "alias").unionByName(two.select("key", "alias"))
        out = both if out is None else out.unionByName(both)
    return out.where(F.greatest(F.length("key"), F.length("alias")) <= FAR * F.least(F.length("key"), F.length("alias")))


def scored(pairs: DataFrame, least_second: float = SECOND) -> DataFrame:
    """key, alias, score, second of the pairs whose second opinion is at least ``least_second``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, alias = batch.column("key").to_pylist(), batch.column("alias").to_pylist()
            second = np.maximum(ratios(key, alias), ratios([sorted_words(k) for k in key], [sorted_words(a) for a in alias]))
            keep = np.flatnonzero(second >= least_second - 1e-9)
            score = np.array([weighted(key[k], alias[k]) for k in keep], np.float64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(keep)) for c in ("key", "alias")), pa.array(score), pa.array(second[keep])], names=["key", "alias", "score", "second"])

    return pairs.select("key", "alias").mapInArrow(run, "key string, alias string, score double, second double")


def _echoes(keys: DataFrame, aliases: DataFrame, rank: dict[str, int]) -> DataFrame:
    """Keys that reach ``ENOUGH`` with some alias only through parts or word sets, while no second opinion supports it."""
    words = lambda df, c: df.select(c, F.size(_words(F.col(c))).alias(f"{c}_words"), F.explode(_words(F.col(c))).alias("word"))
    own = words(keys, "key")
    # A word in common is enough where lengths differ much: only the lengths of the aliases with the word matter.
    lengths = words(aliases, "alias").select("word", F.length("alias").alias("n")).distinct()
    long = F.greatest(F.length("key"), F.col("n")) / F.least(F.length("key"), F.col("n"))
    by_word = own.join(lengths, "word").where((long >= LONGER) & (long <= FAR)).select("key")
    # Word sets of keys of like length, and parts without a word in common, are scored.
    like = F.greatest(F.length("key"), F.length("alias")) < LONGER * F.least(F.length("key"), F.length("alias"))
    sets = own.join(words(aliases, "alias"), "word").where(like).select("key", "alias")
    pairs = sets.unionByName(_holding(keys, aliases, rank)).unionByName(_by_pairs(keys, aliases, rank, "set")).distinct()
    return by_word.unionByName(scored(pairs, 0.0).where(F.col("score") >= ENOUGH).select("key")).distinct()


def look_up(keys: DataFrame, aliases: DataFrame, enough: float = ENOUGH, margin: float = MARGIN) -> DataFrame:
    """(key, canonical, alias, score, status) of each distinct key: matched, ambiguous, low_corroboration or unmatched.

    ``keys``: key, normalised; ``aliases``: alias (normalised), canonical, position. ``enough`` may ask for more than ``ENOUGH``.
    A second field within ``margin`` points of the best makes a key ambiguous; ``canonical`` is that of the best score.
    """
    if enough < ENOUGH:
        raise ValueError(f"candidates are sought for {ENOUGH} points")
    every = materialize(keys.select("key").distinct(), "keys")  # read by each of the joins
    keys = every.where("key is not null and key <> ''")
    known = aliases.where("alias is not null and alias <> ''").groupBy("alias").agg(F.min_by("canonical", "position").alias("canonical"))
    known = materialize(known, "aliases")
    rank = _ranks(keys, known)
    good = scored(candidates(keys, known, rank)).where(F.col("score") >= ENOUGH).join(known, "alias")
    best = good.groupBy("key", "canonical").agg(F.max(F.struct("score", "alias")).alias("b")).select("key", "canonical", "b.score", "b.alias")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "canonical")
    ranked = best.withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).where("n = 1")
    status = F.when(F.col("score") < enough, "unmatched").when(F.col("score") - F.col("next") < margin, "ambiguous").otherwise("matched")
    top = materialize(ranked.select("key", "canonical", "alias", "score", status.alias("status")), "matched")
    none = keys.join(top.select("key"), "key", "left_anti")
    echo = _echoes(none, known.select("alias"), rank).select("key", F.lit("low_corroboration").alias("echo"))
    out = every.join(top, "key", "left").join(echo, "key", "left")
    return out.select("key", "canonical", "alias", "score", F.coalesce("status", "echo", F.lit("unmatched")).alias("status"))
