"""Tender documents scored for one firm: extraction, gates, model, points and recommendation in one plan.

Only column expressions, model transforms and a join with the firm's one row: the plan is the same on a stream and on a table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.functions import documents as D
from bidlake.functions import scoring as R
from bidlake.operators.eligibility import firm_verdicts
from bidlake.operators.learning import Stack, score_batch

PROFILE = "company_name string, pit_total_wins int, province string, municipality string, has_csd boolean, has_cidb boolean, has_tax_clearance boolean"


@dataclass(frozen=True)
class Offer:
    """What the firm brings to every tender of the batch; None where it is not known."""

    level: int | None = None
    price: float | None = None
    lowest: float | None = None
    competitors: int | None = None


def extracted(docs: DataFrame, as_of: Column) -> DataFrame:
    """``docs`` with what scoring asks of ``text``, each as a column of its own: of a struct that is used twice, Spark makes all fields."""
    text = F.col("text")
    money, days = D.extract_money(text), D.extract_dates(text, as_of)
    single = {"_type": D.document_type(text)["type"], "_region": D.region(text, F.lit(None).cast("string"))["region"], "_number": D.extract_company(text)["supplier_number"]}
    read = docs.withColumns({"_value": money["value"], "_bid": money["bid"], "_days": days["deadline_days"]} | single)
    terms = D.extract_terms(text, F.col("_value"))
    return read.withColumns({"_system": terms["system"], "_inferred": terms["low_confidence"], "_goals": terms["goals_ratio"], "_procedure": terms["procedure"], "_supply": terms["supply"]})


def score_documents(docs: DataFrame, firm: DataFrame, offer: Offer, stack: Stack, medians: dict[str, float], threshold: float, as_of: Column) -> DataFrame:
    """One row a document: its columns but ``text``, what was read from it, its gates, probabilities, recommendation and error.

    ``docs``: ``text`` and any keys; ``firm``: one row of ``PROFILE``; ``medians`` stand for features that the text lacks. A document
    without text gives a row with an ``error``, no probability and PASS; nothing stops the others.
    """
    keys = [c for c in docs.columns if c != "text"]
    read = extracted(firm_verdicts(docs, firm), as_of)
    read = read.withColumn("error", F.when(F.col("text").isNull(), "unreadable").when(F.trim("text") == "", "no text"))
    found = {"bid_price": F.col("_bid"), "estimate": F.col("_value"), "publish_month": F.month(as_of), "deadline_days": F.col("_days")}
    read = read.withColumns({f: F.coalesce(found.get(f, F.lit(None)).cast("double"), F.lit(float(medians[f]))) for f in stack.features})
    read = score_batch(stack, read, threshold).drop("recommendation", "raw").withColumnRenamed("confidence", "_c")
    system = F.col("_system")
    number = lambda x, kind: F.lit(x).cast(kind)
    points = R.total_score(R.price_score(number(offer.price, "double"), number(offer.lowest, "double"), system), R.bbbee_points(number(offer.level, "int"), system).cast("double"), F.col("_goals"))
    adjusted = R.adjust_probability(F.col("probability"), F.coalesce(points["total"], F.lit(0.0)), number(offer.competitors, "int"))
    bad = F.col("error").isNotNull()
    out = read.withColumns({"_points": points, "adjusted": F.when(~bad, adjusted), "win_probability": F.when(~bad, F.col("probability"))})
    advice = R.recommend(F.col("adjusted"), threshold, ~bad & ~F.col("eligible"))
    share = D.completeness({"value": F.col("_value"), "bid": F.col("_bid")}, {"deadline_days": F.col("_days")}, {"procedure": F.col("_procedure"), "supply": F.col("_supply")})["share"]
    return out.withColumn("_advice", advice).select(
        *keys, "company_name", F.col("_type").alias("type"), F.col("_region").alias("region"), F.col("_number").alias("supplier_number"), F.col("_value").alias("value"), F.col("_system").alias("system"), F.col("_inferred").alias("system_inferred"),
        F.when(bad, 0.0).otherwise(share).alias("completeness"), "eligible", "hard_failures", "warnings", "win_probability", "adjusted", F.col("_points.band").alias("band"),
        F.when(bad, "PASS").otherwise(F.col("_advice.recommendation")).alias("recommendation"), F.col("_advice.confidence").alias("confidence"), "error",
    )


def ranked(scored: DataFrame, *keys: str) -> DataFrame:
    """The best first: eligible by adjusted probability, then the others, error rows last."""
    return scored.orderBy(F.col("error").isNotNull(), F.desc("eligible"), F.desc_nulls_last("adjusted"), *keys)
