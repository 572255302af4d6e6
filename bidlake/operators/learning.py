"""Win-probability models with Spark's own learners: stacking, search, calibration, scoring.

Metrics come from rows the model has not seen; no metric is floored or defaulted.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.common import materialize
from bidlake.functions.scoring import recommend
from bidlake.operators.evaluation import auc_table

SEED = 42
PARALLEL = 4  # fits that are sent to the cluster at once
BINS = 32  # of a feature, as many as Spark's tree learners make of it
PASSES = 25  # of a logistic fit over its rows, at most; five or six settle it
LOTS = 8  # of the rows of a cell, where a learner draws bags or subsamples


def learners(seed: int = SEED, trees: int = 20, depth: int = 4) -> dict:
    """Base learners by name. The label column is a double ``label``."""
    common = {"featuresCol": "features", "labelCol": "label", "weightCol": "weight", "seed": seed}
    return {
        "gbt": GBTClassifier(maxIter=trees, maxDepth=depth, **common),
        "forest": RandomForestClassifier(numTrees=trees, maxDepth=depth, **common),
        "logistic": LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight"),
    }


def bin_edges(df: DataFrame, features: list[str]) -> list[list[float]]:
    """For each feature the least values of its second and later bins: quantiles of all rows, whose rank is off by a 1,024th at most."""
    doubles = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    return [sorted(set(found)) for found in doubles.approxQuantile(features, [k / BINS for k in range(1, BINS)], 1 / 1024)]


def assemble(df: DataFrame, features: list[str], label: str | None = None, weight: float = 1.0, edges: list[list[float]] | None = None) -> DataFrame:
    """``features`` as one vector; with a label also ``label`` and ``weight`` (``weight`` for positives); with ``edges`` also ``cells``, the vector
    of their bins. What is null or NaN is in the last bin, where trees see it too."""
    out = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)
    if label:
        out = out.withColumn("label", F.col(label).cast("double")).withColumn("weight", F.when(F.col("label") == 1, weight).otherwise(1.0))
    if edges is not None:
        cut = [(f"_x{k}", f"_b{k}", least) for k, least in enumerate(edges) if least]
        out = out.withColumns({x: F.coalesce(F.col(features[int(x[2:])]).cast("double"), F.lit(float("nan"))) for x, _, _ in cut})
        if cut:
            inputs, outputs, least = (list(c) for c in zip(*cut, strict=True))
            out = Bucketizer(inputCols=inputs, outputCols=outputs, splitsArray=[[-math.inf, *e, math.inf] for e in least], handleInvalid="keep").transform(out)
        bins = [F.least(F.col(f"_b{k}"), F.lit(float(len(least)))) if least else F.lit(0.0) for k, least in enumerate(edges)]
        out = out.withColumn("cells", array_to_vector(F.array(*bins))).drop(*[c for x, b, _ in cut for c in (x, b)])
    return out


def grouped(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` (cells, label, weight) with one row for each cell and label, that weighs as much as all of them.

    Boosted trees see a row only through its bins, label and weight, so they learn from this what they learn from the rows; and it has
    at most ``BINS`` to the power of the features and twice that many rows, however many there are.
    """
    return rows.groupBy(*by, vector_to_array("cells").alias("cells"), "label").agg(F.sum("weight").alias("weight")).withColumn("cells", array_to_vector("cells"))


def _positive(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


@dataclass
class Logit:
    """A logistic model on standardised columns; what is null or NaN counts as the column's mean."""

    inputs: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the intercept first

    def score(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with the probability ``name``."""
        z = F.lit(float(self.weights[0]))
        for c, mean, scale, w in zip(self.inputs, self.mean, self.scale, self.weights[1:], strict=True):
            z = z + F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(float(mean))) - float(mean), F.lit(0.0)) * float(scale * w)
        return df.withColumn(name, 1 / (1 + F.exp(-z)))


def _sums(rows: DataFrame, inputs: list[str], within: list[Column], of: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """For each condition of ``within`` the sum of ``of(its place, inputs, label, weight)`` over batches of its rows: one pass for all, numbers of a fixed count come back."""
    width, count = len(inputs), len(within)
    asked = rows.select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(inputs)], "label", "weight", *[F.coalesce(c, F.lit(False)).alias(f"in{k}") for k, c in enumerate(within)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.stack([batch.column(f"x{k}").to_numpy(zero_copy_only=False) for k in range(width)], axis=1).astype(np.float64)
            y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight"))
            for k in range(count):
                own = batch.column(f"in{k}").to_numpy(zero_copy_only=False)
                if own.any():
                    found = of(k, x[own], y[own], w[own])
                    out[k] = out[k] + found if k in out else found
        for k, found in out.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()), pa.array(found)], names=["k", "at", "v"])

    total: list[dict] = [{} for _ in within]
    for r in asked.mapInArrow(run, "k int, at int, v double").groupBy("k", "at").agg(F.sum("v").alias("v")).collect():
        total[r["k"]][r["at"]] = r["v"]
    return [np.array([t[i] for i in range(len(t))]) for t in total]


def logits(rows: DataFrame, inputs: list[str], within: list[Column]) -> list[Logit]:
    """Logistic models without penalty, one for the rows of each condition, by Newton's method: ``rows`` has the inputs, label and weight.

    All models take each pass over the rows together and nothing is cached; a step that raises the loss is halved.
    """
    n, width = len(within), len(inputs)

    def moments(k: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        known, x = ~np.isnan(x), np.nan_to_num(x)
        return np.concatenate([w @ known, w @ x, w @ (x * x), [w.sum(), w @ y]])

    mean, scale, at = [], [], []
    for m in _sums(rows, inputs, within, moments):
        seen = np.maximum(m[:width], 1e-300)
        mean.append(m[width : 2 * width] / seen)
        spread = np.sqrt(np.maximum(m[2 * width : 3 * width] / seen - mean[-1] ** 2, 0.0))
        constant = spread <= 1e-7 * np.abs(mean[-1])
        scale.append(np.where(constant, 0.0, 1 / np.where(constant, 1.0, spread)))
        share = min(max(m[-1] / m[-2], 1e-9), 1 - 1e-9)
        at.append(np.concatenate([[math.log(share / (1 - share))], np.zeros(width)]))
    best, step, loss, left = [a.copy() for a in at], [np.zeros(width + 1) for _ in at], [math.inf] * n, set(range(n))
    for _ in range(PASSES):
        asked = sorted(left)

        def gradient(place: int, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
            k = asked[place]
            s = np.concatenate([np.ones((len(x), 1)), np.nan_to_num((x - mean[k]) * scale[k])], axis=1)
            z = s @ at[k]
            p = 1 / (1 + np.exp(-z))
            return np.concatenate([[w @ (np.logaddexp(0, z) - y * z)], s.T @ (w * (y - p)), ((s * (w * p * (1 - p))[:, None]).T @ s).ravel()])

        for k, m in zip(asked, _sums(rows, inputs, [within[k] for k in asked], gradient), strict=True):
            if m[0] > loss[k] * (1 + 1e-12):
                step[k] = step[k] / 2
            else:
                best[k], loss[k] = at[k], m[0]
                step[k] = np.linalg.lstsq(m[width + 2 :].reshape(width + 1, -1), m[1 : width + 2], rcond=None)[0]
            at[k] = best[k] + step[k]
            if np.abs(step[k]).max() < 1e-7:
                left.discard(k)
        if not left:
            break
    return [Logit(inputs, *x) for x in zip(mean, scale, best, strict=True)]


@dataclass
class Stack:
    features: list[str]
    base: dict
    meta: Logit | None = None
    calibrator: IsotonicRegressionModel | None = None
    importances: list = field(default_factory=list)
    edges: list[list[float]] | None = None


def _base_scores(base: dict, df: DataFrame) -> DataFrame:
    for name, model in base.items():
        df = model.score(df, f"p_{name}") if isinstance(model, Logit) else _positive(model.transform(df), f"p_{name}")
    return df


def side_by_side(jobs: list[Callable[[], object]], parallelism: int = PARALLEL) -> list:
    """Results of Spark jobs that are sent at once; the first failure is raised."""
    with ThreadPoolExecutor(parallelism) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def train_stack(train: DataFrame, features: list[str], label: str, fold_year: str, years: list[int], weight: float = 1.0, parallelism: int = PARALLEL) -> Stack:
    """Base models on all rows; a logistic meta-model on their predictions for years later than those they saw.

    Features are put together and written once. Trees pass their rows once a level, so boosting gets them ``grouped``, and the forest draws its bags
    from up to ``LOTS`` lots of each cell's rows, dealt by hash of the row; several such fits run at a time. The logistic models of all folds
    take few passes over single rows together (``logits``).
    """
    edges, made = bin_edges(train, features), learners()
    lot = F.pmod(F.xxhash64(F.lit("lot"), *train.columns), F.lit(LOTS)).alias("lot")
    columns = dict.fromkeys([*features, "cells", "label", "weight", label, fold_year])
    rows = materialize(assemble(train.select("*", lot), features, label, weight, edges).select(*columns, "lot"), "features")
    lots = materialize(grouped(rows, fold_year, "lot"), "lots")
    cells = materialize(grouped(lots, fold_year), "cells")
    seen = lambda df, year: df if year is None else df.where(F.col(fold_year) < year)
    past = lambda year, name: grouped(seen(cells, year)) if name == "gbt" else grouped(seen(lots, year), "lot")
    every = [None, *years]
    tasks = [(year, name) for name in made if name != "logistic" for year in every]
    fitted = dict(zip(tasks, side_by_side([lambda t=t: made[t[1]].copy().setFeaturesCol("cells").fit(past(*t)) for t in tasks], parallelism), strict=True))
    fitted |= {(year, "logistic"): m for year, m in zip(every, logits(rows, features, [F.lit(True) if year is None else F.col(fold_year) < year for year in every]), strict=True)}
    held = None
    for year in years:
        part = _base_scores({n: fitted[year, n] for n in made}, rows.where(F.col(fold_year) == year)).select(*[f"p_{n}" for n in made], "label", F.lit(1.0).alias("weight"))
        held = part if held is None else held.unionByName(part)
    base = {n: fitted[None, n] for n in made}
    meta = None if held is None else logits(materialize(held, "held-out"), [f"p_{n}" for n in made], [F.lit(True)])[0]
    return Stack(features, base, meta, importances=list(zip(features, base["gbt"].featureImportances.toArray().tolist(), strict=True)), edges=edges)


def raw_scores(stack: Stack, df: DataFrame) -> DataFrame:
    """``raw``: the meta-model's probability, or the mean of the base models without one."""
    out = _base_scores(stack.base, assemble(df, stack.features, edges=stack.edges).withColumn("weight", F.lit(1.0))).drop("features", "cells", "weight")
    names = [f"p_{n}" for n in stack.base]
    if stack.meta is None:
        return out.withColumn("raw", sum(F.col(n) for n in names) / len(names)).drop(*names)
    return stack.meta.score(out, "raw").drop(*names)


def calibrate(stack: Stack, val: DataFrame, label: str) -> Stack:
    """Isotonic on validation rows; outside their range the ends are held."""
    rows = materialize(raw_scores(stack, val).select(F.col("raw"), F.col(label).cast("double").alias("label")), "validation")  # the fit reads it three times
    stack.calibrator = IsotonicRegression(featuresCol="raw", labelCol="label").fit(VectorAssembler(inputCols=["raw"], outputCol="raw_v").transform(rows).select(F.col("raw_v").alias("raw"), "label"))
    return stack


def score_batch(stack: Stack, df: DataFrame, threshold: float, tie_break: float = 0.0) -> DataFrame:
    """probability (calibrated, clipped to [0.01, 0.99]), recommendation and confidence of each row."""
    out = raw_scores(stack, df)
    if stack.calibrator is not None:
        vector = VectorAssembler(inputCols=["raw"], outputCol="raw_v").transform(out)
        out = stack.calibrator.setFeaturesCol("raw_v").setPredictionCol("calibrated").transform(vector).drop("raw_v")
    else:
        out = out.withColumn("calibrated", F.col("raw"))
    p = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("calibrated") + tie_break * (F.col("raw") - 0.5)))
    out = out.withColumn("probability", p).withColumn("_r", recommend(F.col("probability"), threshold))
    return out.select(*df.columns, "raw", "probability", "_r.recommendation", "_r.confidence")


def random_settings(n: int, seed: int = SEED) -> list[tuple[str, dict]]:
    """Distinct seeded settings of the three learners, in turn."""
    rnd, out = random.Random(seed), []
    grids = {
        "gbt": {"maxDepth": [2, 3, 4, 5], "maxIter": [5, 10, 20], "stepSize": [0.05, 0.1, 0.2], "subsamplingRate": [0.7, 1.0]},
        "forest": {"maxDepth": [3, 5, 8], "numTrees": [10, 20, 40], "subsamplingRate": [0.5, 0.8, 1.0]},
        "logistic": {"regParam": [0.0, 1e-3, 1e-2, 0.1], "elasticNetParam": [0.0, 0.5, 1.0]},
    }
    everything = {name: [dict(zip(grid, values, strict=True)) for values in product(*grid.values())] for name, grid in grids.items()}
    for settings in everything.values():
        rnd.shuffle(settings)
    names = list(grids)
    while len(out) < n and any(everything.values()):
        name = names[0]
        names = names[1:] + [name]
        if everything[name]:
            out.append((name, everything[name].pop()))
    return out


def search_params(train: DataFrame, val: DataFrame, features: list[str], label: str, key: str, n: int = 24, cut: int = 3, rounds: int = 3, seed: int = SEED, parallelism: int = PARALLEL) -> DataFrame:
    """(round, learner, setting, auc): validation AUC of random settings by successive halving.

    The first round fits all ``n`` settings on a share of the training rows by hash of ``key``; each further round fits the best of every ``cut``
    on ``cut`` times the rows, the last on all of them. Every AUC is over all validation rows. Features are built once, fits
    run side by side, and the AUCs of a round come out of one pass over its scores. Trees see bins: boosting without subsamples learns
    from ``grouped`` rows, bags and subsamples are drawn from up to ``LOTS`` lots of each cell's rows, dealt by hash of ``key``, and trees score each
    cell of the validation rows once, for all of its rows.
    """
    edges = bin_edges(train, features)
    put = lambda df, name: materialize(assemble(df, features, label, edges=edges).select(key, "features", "cells", "label", "weight"), name)
    rows, held = put(train, "search-train"), put(val, "search-val")
    held_cells = materialize(grouped(held), "search-val-cells")
    left = [(f"{k}", name, setting) for k, (name, setting) in enumerate(random_settings(n, seed))]
    share = lambda r: F.pmod(F.xxhash64(F.lit("search"), key), F.lit(cut ** (rounds - 1 - r))) == 0
    out = None
    for r in range(rounds):
        some = rows.where(share(r))
        lots = materialize(grouped(some.withColumn("lot", F.pmod(F.xxhash64(F.lit("lot"), key), F.lit(LOTS))), "lot"), "search-lots")
        some_cells = materialize(grouped(lots), "search-cells")
        made = []
        for _, name, setting in left:
            learner = learners(seed)[name].copy({getattr(learners(seed)[name], p): v for p, v in setting.items()})
            if name == "logistic":
                made.append((learner, some))
            else:
                made.append((learner.setFeaturesCol("cells"), some_cells if name == "gbt" and learner.getSubsamplingRate() == 1.0 else lots))
        models = side_by_side([lambda m=m, seen=seen: m.fit(seen) for m, seen in made], parallelism)
        scored = None
        for (place, name, _), model in zip(left, models, strict=True):
            part = _positive(model.transform(held if name == "logistic" else held_cells), "score").select(F.lit(place).alias("place"), "score", "label", "weight")
            scored = part if scored is None else scored.unionByName(part)
        names = F.create_map(*[F.lit(x) for place, name, _ in left for x in (place, name)])
        settings = F.create_map(*[F.lit(x) for place, _, setting in left for x in (place, json.dumps(setting, sort_keys=True))])
        found = auc_table(scored, by=["place"], times="weight").select(F.lit(r + 1).alias("round"), "place", names[F.col("place")].alias("learner"), settings[F.col("place")].alias("setting"), F.col("roc_auc").alias("auc"))
        found = materialize(found, "round")
        out = found if out is None else out.unionByName(found)
        best = {x["place"]: x["auc"] for x in found.collect()}  # one row a setting
        left = sorted(left, key=lambda x: (-(best.get(x[0]) or 0.0), int(x[0])))[: max(1, -(-len(left) // cut))]
    return out.drop("place")


def top_factors(stack: Stack, df: DataFrame, medians: dict[str, float], key: str, n: int = 5) -> DataFrame:
    """The n features of most gain with each row's value and its side of the training median."""
    best = sorted(stack.importances, key=lambda x: (-x[1], x[0]))[:n]
    parts = [F.struct(F.lit(i + 1).alias("rank"), F.lit(f).alias("feature"), F.lit(g).alias("gain"), F.col(f).cast("double").alias("value"), F.when(F.col(f) >= medians[f], "above").otherwise("below").alias("side")) for i, (f, g) in enumerate(best)]
    return df.select(key, F.explode(F.array(*parts)).alias("f")).select(key, "f.*")


def tender_supplier_lookup(tenders: DataFrame, history: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Features of each asked (tender, supplier): its own row by name, by id, any row of the tender, the supplier's latest row, else medians.

    ``tenders``: tender_id, supplier_name, supplier_id; ``history``: tender_id, bidder_name, bidder_masterid, publish_year and the features.
    """
    features = list(medians)
    have = history.select("tender_id", "bidder_name", "bidder_masterid", "publish_year", F.struct(*features).alias("f"))
    by_name = have.groupBy("tender_id", "bidder_name").agg(F.max_by("f", F.struct("bidder_masterid", "f")).alias("f1")).withColumnRenamed("bidder_name", "supplier_name")
    by_id = have.groupBy("tender_id", "bidder_masterid").agg(F.max_by("f", F.struct("bidder_name", "f")).alias("f2")).withColumnRenamed("bidder_masterid", "supplier_id")
    of_tender = have.groupBy("tender_id").agg(F.min_by("f", F.struct("bidder_name", "bidder_masterid", "f")).alias("f3"))
    of_supplier = have.groupBy("bidder_name").agg(F.max_by("f", F.struct("publish_year", "tender_id", "bidder_masterid", "f")).alias("f4")).withColumnRenamed("bidder_name", "supplier_name")
    out = tenders.join(by_name, ["tender_id", "supplier_name"], "left").join(by_id, ["tender_id", "supplier_id"], "left").join(of_tender, "tender_id", "left").join(of_supplier, "supplier_name", "left")
    rank = F.when(F.col("f1").isNotNull(), 1).when(F.col("f2").isNotNull(), 2).when(F.col("f3").isNotNull(), 3).when(F.col("f4").isNotNull(), 4).otherwise(5)
    best = F.coalesce("f1", "f2", "f3", "f4")
    return out.select("tender_id", "supplier_name", "supplier_id", rank.alias("matched_by"), *[F.coalesce(best[c], F.lit(medians[c])).alias(c) for c in features])


