"""Model evaluation from (score, label) tables: exact, set-level, with no row on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.operators.ranks import running


def score_counts(df: DataFrame, by: list[str] = (), score: str = "score", label: str = "label", times: str | None = None) -> DataFrame:
    """Positives and negatives of each distinct score, with running totals from the highest score down.

    Scores are counted first; the running totals are made inside buckets of scores, not in one task. ``times``: how many rows a row stands for.
    """
    of = lambda c: F.count_if(c) if times is None else F.sum(F.when(c, F.col(times)).otherwise(0)).cast("long")
    per = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(of(F.col(label) == 1).alias("pos"), of(F.col(label) == 0).alias("neg"))
    return running(per, list(by), score, {"tp": "pos", "fp": "neg"}, descending=True)


def auc_table(df: DataFrame, by: list[str] = (), score: str = "score", label: str = "label", times: str | None = None) -> DataFrame:
    """Exact ROC-AUC and average precision; ties count half. Null where a class is missing."""
    runs = score_counts(df, by, score, label, times)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + 0.5 * F.col("pos") * F.col("neg"))
    precision = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    out = runs.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), area.alias("_a"), precision.alias("_p"))
    return out.select(*by, "positives", "negatives", F.try_divide(F.col("_a"), F.col("positives") * F.col("negatives")).alias("roc_auc"), F.try_divide(F.col("_p"), F.col("positives")).alias("pr_auc"))


def log_loss(score: Column, label: Column, eps: float = 1e-15) -> Column:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), score))
    return F.avg(-(label * F.ln(p) + (1 - label) * F.ln(1 - p)))


def confusion(df: DataFrame, threshold: float, by: list[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    said, true = F.col(score) >= threshold, F.col(label) == 1
    out = df.groupBy(*by).agg(
        F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"), F.count_if(~said & ~true).alias("tn"), log_loss(F.col(score), F.col(label)).alias("log_loss")
    )
    return out.withColumns({"precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))})


def threshold_f1(df: DataFrame, low: int = 10, high: int = 90, score: str = "score", label: str = "label") -> DataFrame:
    """F1 at each hundredth from ``low`` to ``high``; ``best`` marks the first of the best.

    Scores are counted by the hundredth they reach first, so each row is read once.
    """
    spark = df.sparkSession
    grid = spark.range(low, high + 1).select(F.col("id").cast("int").alias("t"))
    reach = F.least(F.lit(high), F.floor(F.round(F.col(score) * 100, 9)).cast("int"))
    counts = df.where(F.col(score).isNotNull()).groupBy(reach.alias("r")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    total = counts.agg(F.sum("pos").alias("all_pos"))
    hits = grid.join(F.broadcast(counts), F.col("r") >= F.col("t"), "left").groupBy("t").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("all_pos")), F.lit(0.0))
    out = hits.crossJoin(F.broadcast(total)).select((F.col("t") / 100).alias("threshold"), f1.alias("f1"))
    return out.withColumn("best", F.row_number().over(Window.orderBy(F.desc(F.round("f1", 12)), "threshold")) == 1)


def threshold_business(df: DataFrame, wanted: float = 0.40, fallback: float = 0.35, score: str = "score", label: str = "label") -> DataFrame:
    """One row: the lowest score whose precision at or above it is ``wanted``; else ``fallback``; else that of most precision."""
    runs = score_counts(df, (), score, label)
    p = F.col("tp") / (F.col("tp") + F.col("fp"))
    rows = runs.select(F.col(score).alias("threshold"), p.alias("precision"), F.col("tp"))
    least = lambda limit: F.min(F.when(F.col("precision") >= limit, F.struct("threshold", "precision", "tp")))
    best = F.max(F.struct("precision", (-F.col("threshold")).alias("neg"), "tp"))
    one = rows.agg(least(wanted).alias("a"), least(fallback).alias("b"), best.alias("c"), F.max("tp").alias("all_pos"))
    pick = lambda f: F.coalesce(F.col(f"a.{f}"), F.col(f"b.{f}"), F.col("c.precision") if f == "precision" else F.col(f"c.{f}") if f == "tp" else -F.col("c.neg"))
    return one.select(pick("threshold").alias("threshold"), pick("precision").alias("precision"), F.try_divide(pick("tp"), F.col("all_pos")).alias("recall"))


def calibration_bins(df: DataFrame, n: int = 10, score: str = "score", label: str = "label") -> DataFrame:
    """Count, mean score and rate of positives in n equal bins of [0, 1]; the last is closed, empty ones are kept."""
    bins = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
    own = F.least(F.lit(n - 1), F.floor(F.round(F.col(score) * n, 9)).cast("int"))
    per = df.where((F.col(score) >= 0) & (F.col(score) <= 1)).groupBy(own.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_predicted"), F.avg(label).alias("actual_rate"))
    return bins.join(per, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def hit_rate_at_k(df: DataFrame, group: str, key: str, k: int = 20, score: str = "score", label: str = "label") -> DataFrame:
    """One row: of the groups with a positive, the share that has one among its k best (ties by key)."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key)))
    per = ranked.groupBy(group).agg(F.max(label).alias("any"), F.max(F.when(F.col("_n") <= k, F.col(label)).otherwise(0)).alias("hit"))
    return per.where(F.col("any") == 1).agg(F.count("*").alias("groups"), F.avg("hit").alias("hit_rate"))


def year_folds(df: DataFrame, year: str = "publish_year", label: str = "did_win") -> DataFrame:
    """(fold, val_year, train_rows, val_rows): train on earlier years, validate on this one; both need both classes."""
    per = df.where(F.col(year).isNotNull()).groupBy(year).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos"))
    before = Window.orderBy(year).rowsBetween(Window.unboundedPreceding, -1)
    rows = per.withColumns({"tn": F.sum("n").over(before), "tp": F.sum("pos").over(before)})
    mixed = lambda n, p: (F.col(p) > 0) & (F.col(p) < F.col(n))
    good = rows.where(mixed("n", "pos") & mixed("tn", "tp"))
    return good.select(F.row_number().over(Window.orderBy(year)).alias("fold"), F.col(year).alias("val_year"), F.col("tn").alias("train_rows"), F.col("n").alias("val_rows"))


def time_blocks(df: DataFrame, order: str, blocks: int = 5) -> DataFrame:
    """``df`` with ``block``: 0 for the first rows by ``order``, then 1 to ``blocks`` for equal parts of the rest.

    Of n rows a block takes n / (blocks + 1), rounded down, and block 0 what is left; rows of one ``order`` stay together, in
    the block of their last; without an order there is no block.
    """
    upto = running(df.where(F.col(order).isNotNull()).groupBy(order).agg(F.count("*").alias("_n")), [], order, {"_upto": "_n"})
    total = upto.agg(F.max("_upto").alias("_all"))  # one row
    size = F.floor(F.col("_all") / (blocks + 1))
    past = F.col("_upto") - (F.col("_all") - blocks * size)
    placed = upto.crossJoin(F.broadcast(total)).select(order, F.when(past <= 0, 0).otherwise(F.ceil(F.try_divide(past, size))).cast("int").alias("block"))
    return df.join(placed, order, "left")


def block_folds(df: DataFrame, order: str, label: str = "did_win", blocks: int = 5) -> DataFrame:
    """(fold, val_block, train_rows, val_rows): as ``year_folds``, over blocks of rows; for data whose years give no fold."""
    return year_folds(time_blocks(df, order, blocks), "block", label).withColumnRenamed("val_year", "val_block")


def validation_status(metrics: DataFrame, bar: float = 0.60) -> DataFrame:
    """Whether the held-out AUC (test, else val) reaches the bar; a missing metric never does."""
    auc = F.coalesce(F.max(F.when(F.col("split") == "test", F.col("roc_auc"))), F.max(F.when(F.col("split") == "val", F.col("roc_auc"))))
    return metrics.agg(auc.alias("auc")).select("auc", F.when(F.coalesce(F.col("auc") >= bar, F.lit(False)), "VALIDATED").otherwise("NOT_VALIDATED").alias("status"))
