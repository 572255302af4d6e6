"""Profiling: each report is one pass over the table, not one per column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlake.operators.ranks import quantiles
from pyspark.sql import types as T


def schema_report(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)], "position int, name string, type string")


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    rows = [(c, "left") for c in a.columns if c not in b.columns] + [(c, "right") for c in b.columns if c not in a.columns]
    return a.sparkSession.createDataFrame(rows, "name string, only_in string")


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows of each source and the total (source ``all``)."""
    tagged = None
    for name, df in frames.items():
        one = df.select(F.lit(name).alias("source"))
        tagged = one if tagged is None else tagged.unionAll(one)
    return tagged.rollup("source").agg(F.count("*").alias("n_rows")).select(F.coalesce("source", F.lit("all")).alias("source"), "n_rows")


def sample_rows(df: DataFrame, n: int = 5, width: int = 120) -> DataFrame:
    return df.limit(n).select(*[F.substring(F.col(f.name), 1, width).alias(f.name) if isinstance(f.dataType, T.StringType) else f.name for f in df.schema.fields])


def null_rates(df: DataFrame, high: float = 50.0) -> DataFrame:
    """(column, null_pct, flag): per cent of nulls, two decimals, marked HIGH above the limit."""
    one = df.agg(*[F.round(100.0 * F.avg(F.col(c).isNull().cast("int")), 2).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column", "null_pct").withColumn("flag", F.when(F.col("null_pct") > high, "HIGH"))


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value").where(F.col("value").isNotNull())


def top_values(df: DataFrame, columns: list[str], k: int = 15) -> DataFrame:
    """The k most frequent values of each column, one aggregation for all columns; ties by value."""
    counts = _long(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= k)


def range_report(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """(column, least, greatest, n_distinct) over non-null values as text."""
    distinct = F.approx_count_distinct("value") if approximate else F.countDistinct("value")
    return _long(df, columns).groupBy("column").agg(F.min("value").alias("least"), F.max("value").alias("greatest"), distinct.alias("n_distinct"))


def numeric_summary(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Castable count, least, quartiles, 95 %, greatest and mean of each column; text that is no number is left out."""
    values = df.select(*[F.col(c).cast("string").try_cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value").where(F.col("value").isNotNull())
    at = [0.25, 0.5, 0.75, 0.95]
    own = [F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.avg("value").alias("mean")]
    if approximate:
        out = values.groupBy("column").agg(*own, F.percentile_approx("value", at, 10_000).alias("q"))
    else:
        out = values.groupBy("column").agg(*own).join(quantiles(values, at), "column")
    return out.select("column", "n", "least", *[F.col("q")[i].alias(name) for i, name in enumerate(("p25", "p50", "p75", "p95"))], "greatest", "mean")


def columns_like(df: DataFrame, keywords: dict[str, list[str]]) -> dict[str, list[str]]:
    """Columns whose name holds one of the keywords of each group."""
    return {group: [c for c in df.columns if any(w in c.lower() for w in words)] for group, words in keywords.items()}


def label_distribution(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(label, "n", F.round(100.0 * F.col("n") / F.col("_total"), 2).alias("pct"))


def feature_stats(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Mean, deviation, range, nulls and correlation with the label of each feature, in one aggregation."""
    one = df.agg(
        *[
            F.struct(F.avg(c).alias("mean"), F.stddev(c).alias("std"), F.min(F.col(c).cast("double")).alias("least"), F.max(F.col(c).cast("double")).alias("greatest"), F.count_if(F.col(c).isNull()).alias("nulls"), F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias("corr")).alias(c)
            for c in features
        ]
    )
    return one.unpivot([], features, "feature", "s").select("feature", "s.*")


def leaking_features(df: DataFrame, features: list[str], label: str, most: float = 0.5) -> DataFrame:
    return feature_stats(df, features, label).where(F.abs("corr") > most).select("feature", "corr")
