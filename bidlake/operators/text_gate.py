"""A gate on the head of a document: is it worth reading on? A persisted text classifier, for tables and for streams.

Words, numbers and marks of the first ``HEAD`` characters, hashed counts, inverse document frequencies and a logistic regression, all in one
``PipelineModel``; rows of the rarer class weigh more. The classifier is fitted once, saved in a shared folder, and only transforms
rows afterwards, so the same model serves batch and stream.

Defined results: a null text is an empty one; texts with fewer than ``LEAST`` characters in their head are unreadable and are not
scored; rows without label take no part in fitting; a sample without both classes is refused.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters of the head, characters that make it readable, and the confidence from which a document passes.
HEAD, LEAST, ENOUGH = 1500, 40, 0.7
FEATURES = 1 << 16


def head_of(text: Column) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, HEAD)


def head_gate(text: Column, score: Column, least: int = LEAST, enough: float = ENOUGH) -> Column:
    """unreadable, tender or not_tender by the score of the first characters; no score is not_tender."""
    return F.when(F.length(F.trim(head_of(text))) < least, "unreadable").when(score >= enough, "tender").otherwise("not_tender")


def fit_gate(labelled: DataFrame, regularisation: float = 0.1, rounds: int = 50, least_docs: int = 60) -> PipelineModel:
    """``labelled``: text, label (0 or 1). Words of fewer than ``least_docs`` heads are left out."""
    rows = labelled.where("label in (0, 1)").select("text", F.col("label").cast("double").alias("label"))
    share = rows.agg(F.avg("label")).first()[0]
    if share is None or not 0 < share < 1:
        raise ValueError("both classes are needed")
    weighed = rows.withColumn("weight", F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    stages = [
        SQLTransformer(statement=f"SELECT *, substring(coalesce(text, ''), 1, {HEAD}) AS _head FROM __THIS__"),
        RegexTokenizer(inputCol="_head", outputCol="_words", pattern=r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]", gaps=False),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=FEATURES),
        IDF(inputCol="_counts", outputCol="_features", minDocFreq=least_docs),
        LogisticRegression(featuresCol="_features", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction", weightCol="weight", regParam=regularisation, maxIter=rounds),
    ]
    return Pipeline(stages=stages).fit(weighed)


def gate(docs: DataFrame, model: PipelineModel, enough: float = ENOUGH) -> DataFrame:
    """``docs`` (text and any keys, on a table or a stream) without text, with score (null where unreadable) and verdict."""
    scored = model.transform(docs).withColumn("_score", vector_to_array("_probability")[1])
    verdict = head_gate(F.col("text"), F.col("_score"), enough=enough)
    score = F.when(verdict != "unreadable", F.col("_score"))
    return scored.select(*[c for c in docs.columns if c != "text"], score.alias("score"), verdict.alias("verdict"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
