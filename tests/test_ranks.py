"""Bucketed running totals, quantiles and positions against plain Python."""

import math
import random
import statistics

from pyspark.sql import Window
from pyspark.sql import functions as F

from bidlake.operators import ranks as K
from bidlake.operators.evaluation import auc_table, score_counts
from bidlake.operators.ranks import running_over
from bidlake.operators.reports import rolling_count

VALUES = [0.0, -0.0, 1e-300, 5e-324, -1e300, 1e308, math.inf, -math.inf, 0.5, 1.0, 2.0, -3.5, 1023.9999, 1024.0]


def test_buckets_keep_the_order(spark):
    rng = random.Random(5)
    values = sorted(VALUES + [rng.uniform(-2, 2) for _ in range(3000)] + [rng.uniform(0, 1) ** 20 for _ in range(500)] + [2.0**k for k in range(-1070, 1023, 7)])
    got = [r["b"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", K.bucket(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got)


def test_running_totals_and_nan(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", None]), rng.choice([rng.uniform(-5, 5), 0.25, math.nan, math.inf]), rng.randint(0, 3)) for _ in range(400)]
    counts = spark.createDataFrame(rows, "g string, v double, n int").groupBy("g", "v").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    place = lambda v: (1, 0.0) if math.isnan(v) else (0, v)  # noqa: E731  NaN is above all
    for down in (False, True):
        for r in K.running(counts, ["g"], "v", {"upto": "n"}, down).collect():
            inside = (lambda v: place(v) >= place(r["v"])) if down else (lambda v: place(v) <= place(r["v"]))  # noqa: B023
            assert r["upto"] == sum(n for g, v, n in rows if g == r["g"] and inside(v))


def test_quantiles_are_exact(spark):
    rng = random.Random(9)
    groups = {"a": [rng.gauss(0, 100) for _ in range(1001)], "b": [float(rng.randint(0, 9)) for _ in range(500)], "c": [4.0]}
    long = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("d", None)], "column string, value double")
    got = {r["column"]: r["q"] for r in K.quantiles(long, [0.0, 0.5, 1.0]).collect()}
    assert set(got) == {"a", "b", "c"}
    for g, vs in groups.items():
        assert got[g][0] == min(vs) and got[g][2] == max(vs) and math.isclose(got[g][1], statistics.median(vs), abs_tol=1e-12)
    assert K.quantiles(long.limit(0), [0.5]).count() == 0


def test_positions_are_a_permutation_of_each_group(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 30 == 0, "x").alias("g"))
    rows = K.positions(df, ["g"], F.xxhash64(F.lit("s"), "id"), "at", 16).collect()
    for g in ("hot", "x", None):
        at = sorted(r["at"] for r in rows if r["g"] == g)
        assert at == list(range(1, len(at) + 1))
    assert len(rows) == 3000


def test_auc_against_all_pairs(spark):
    rng = random.Random(11)
    rows = [(rng.choice([rng.random(), 0.5, -1.5, 7.0]), rng.randint(0, 1)) for _ in range(300)] + [(None, 1), (0.5, None)]
    df = spark.createDataFrame(rows, "score double, label int")
    good = [s for s, y in rows if s is not None and y == 1]
    bad = [s for s, y in rows if s is not None and y == 0]
    want = sum((p > q) + 0.5 * (p == q) for p in good for q in bad) / (len(good) * len(bad))
    assert math.isclose(auc_table(df).first()["roc_auc"], want)
    assert score_counts(df).count() == len({s for s, y in rows if s is not None and y is not None})


def test_running_over_slices_equals_windows(spark):
    rnd = random.Random(12)
    rows = [(rnd.choice(["hot", "hot", "hot", "b", None]), rnd.randrange(100), k, rnd.choice([None, 1, 2, 5])) for k in range(1500)]
    df = spark.createDataFrame(rows, "g string, a int, b int, x int").repartition(4)
    for exclusive in (False, True):
        got = running_over(df, ["g"], ["a", "b"], {"s": ("sum", "x"), "m": ("max", "x"), "l": ("last", "x")}, exclusive)
        assert got.columns == [*df.columns, "s", "m", "l"]
        over = Window.partitionBy("g").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
        want = df.select("*", F.coalesce(F.sum("x").over(over), F.lit(0)), F.max("x").over(over), F.last("x", True).over(over))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert running_over(df.limit(0), ["g"], ["a"], {"s": ("sum", "x")}).count() == 0


def test_rolling_counts_with_ties_nulls_and_one_hot_key(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot"] * 9 + [None]), rnd.randrange(3000), k) for k in range(2000)] + [("hot", None, -1)]
    df = spark.createDataFrame(rows, "key string, s int, id int").withColumn("at", F.timestamp_seconds("s"))
    got = {r["id"]: r["recent"] for r in rolling_count(df, "key", "at", 60).collect()}
    assert got == {i: None if s is None else sum(k == k2 and s2 is not None and s - 60 <= s2 <= s for k2, s2, _ in rows) for k, s, i in rows}
