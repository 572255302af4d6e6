"""Running totals and exact quantiles over whole columns, without a task that sees a whole column.

Values are counted first, then dealt into buckets that keep their order. Bucket totals are a small table (1,024
buckets for each doubling of the values, whatever the rows), so only its running sum goes through one task;
inside the buckets all tasks work at once. Group and bucket form one struct key: structs with null fields are equal
where their fields are, and counts, windows and joins on the key share one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.common import materialize

PER_DOUBLING, ORIGIN, FARTHEST = 1024, 2_000_000, 1200.0


def bucket(value: Column) -> Column:
    """A whole number that never falls where the value rises; infinities and NaN have the last one."""
    size = F.abs(value)
    power = F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), F.log2(size)))
    place = F.floor(power * PER_DOUBLING).cast("long") + ORIGIN
    return F.when(value > 0, place).when(value < 0, -place).otherwise(F.lit(0).cast("long"))


def running(counts: DataFrame, by: list[str], value: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """``counts`` (one row a group and value, no null value) with, for each name of ``sums``, the running sum of its
    column up to and with the row, from the least value up, or from the greatest down."""
    order = lambda c: F.desc(c) if descending else F.asc(c)
    own = counts.withColumn("_key", F.struct(*by, bucket(F.col(value).cast("double")).alias("_b")))
    totals = own.groupBy("_key").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*[F.col(f"_key.{c}") for c in by]).orderBy(order("_key._b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_key", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy("_key").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    ranked = own.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    return ranked.join(offsets, "_key").select(*counts.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def quantiles(long: DataFrame, at: list[float], by: str = "column", value: str = "value") -> DataFrame:
    """(by, q): exact quantiles of each group's non-null values as an array, between two values in proportion."""
    counts = long.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    ranked = running(counts, [by], value, {"_upto": "_n"})
    total = counts.groupBy(F.col(by).alias("_g")).agg(F.sum("_n").alias("_all"))
    placed = ranked.join(total, F.col(by).eqNullSafe(F.col("_g")))
    holds = lambda rank: F.max(F.when((F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto")), F.col(value)))
    spots = [(p * (F.col("_all") - 1)) for p in at]
    ends = [holds(F.floor(s)).alias(f"_l{i}") for i, s in enumerate(spots)] + [holds(F.ceil(s)).alias(f"_h{i}") for i, s in enumerate(spots)]
    found = placed.groupBy(by).agg(F.max("_all").alias("_all"), *ends)
    between = [F.when(F.col(f"_l{i}") == F.col(f"_h{i}"), F.col(f"_l{i}")).otherwise(F.col(f"_l{i}") + (s - F.floor(s)) * (F.col(f"_h{i}") - F.col(f"_l{i}"))) for i, s in enumerate(spots)]
    return found.select(by, F.array(*between).alias("q"))


def positions(df: DataFrame, by: list[str], hashed: Column, at: str, buckets: int = 1024) -> DataFrame:
    """``df`` with ``at``: the places 1 to n of each group in the order of a hash, ties in any order.

    A group is dealt into ``buckets`` parts by the hash and each part is ordered by itself, so a hot group is no one's task.
    """
    key = F.struct(*by, _part("_h", buckets).alias("_b"))
    rest = [c for c in df.columns if c not in by and c != "_h"]
    own = df.withColumn("_h", hashed).select(key.alias("_key"), "_h", *rest)  # the group moves as part of the key alone
    placed = _placed(own, at, [F.col(f"_key.{c}") for c in by], F.col("_key._b"))
    return placed.select(*[F.col(f"_key.{c}").alias(c) if c in by else F.col(c) for c in df.columns], at)


def numbered_positions(df: DataFrame, group: str, at: str, buckets: int = 1024) -> DataFrame:
    """``positions`` by the hash ``_h`` in groups that are small whole numbers: group and part move and are sorted as one number."""
    own = df.select((F.col(group) * buckets + _part("_h", buckets)).alias("_key"), *[c for c in df.columns if c != group])
    placed = _placed(own, at, [F.expr(f"_key div {buckets}")], F.col("_key"))
    return placed.select(*[F.expr(f"_key div {buckets}").alias(c) if c == group else F.col(c) for c in df.columns], at)


def _part(hashed: str, buckets: int) -> Column:
    return F.shiftrightunsigned(hashed, 32) % buckets


def _placed(own: DataFrame, at: str, group: list[Column], part: Column) -> DataFrame:
    before = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.groupBy("_key").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_key", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    ranked = own.withColumn("_r", F.row_number().over(Window.partitionBy("_key").orderBy("_h")))
    return ranked.join(offsets, "_key").withColumn(at, F.col("_o") + F.col("_r"))


def running_over(df: DataFrame, by: list[str], order: list[str], measures: dict[str, tuple[str, str]], exclusive: bool = False) -> DataFrame:
    """``df`` with running measures of each group in any order of columns; no task holds a whole group.

    ``measures``: name to (kind, column); ``sum`` (0 at the start), ``max``, or ``last`` (the last that is not null). ``exclusive`` leaves the
    row itself out. Rows are dealt out by ranges of group and order, so a hot group is many slices; each slice runs by itself, and
    starts from what the slices before it add up to: one row a group and slice. Rows that agree in group and order come in any order.
    """
    own = materialize(df.repartitionByRange(*by, *order).select("*", F.spark_partition_id().alias("_slice"), F.struct(F.lit(0).alias("_all"), *by).alias("_key")), "slices")
    end = -1 if exclusive else 0
    inside = Window.partitionBy("_key", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    before = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    spot = F.struct(*order)
    whole = {"sum": F.sum, "max": F.max, "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), spot))}
    over = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}
    totals = own.groupBy("_key", "_slice").agg(*[whole[kind](c).alias(f"_{n}") for n, (kind, c) in measures.items()])
    totals = totals.select("_key", "_slice", *[over[kind](f"_{n}").over(before).alias(f"_{n}") for n, (kind, _) in measures.items()])
    ran = own.withColumns({n: over[kind](c).over(inside) for n, (kind, c) in measures.items()}).join(totals, ["_key", "_slice"])
    both = {"sum": lambda n: F.coalesce(n, F.lit(0)) + F.coalesce(f"_{n}", F.lit(0)), "max": lambda n: F.greatest(n, f"_{n}"), "last": lambda n: F.coalesce(n, f"_{n}")}
    return ran.select(*df.columns, *[both[kind](n).alias(n) for n, (kind, _) in measures.items()])
