"""Statutory preference scoring as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The value from which 90/10 applies; points by contribution level for 80/20 and 90/10.
SYSTEM_LIMIT = 50_000_000
POINTS = {"80/20": {1: 20, 2: 18, 3: 14, 4: 12, 5: 8, 6: 6, 7: 4, 8: 2}, "90/10": {1: 10, 2: 9, 3: 6, 4: 5, 5: 4, 6: 3, 7: 2, 8: 1}}
PRICE_WEIGHT = {"80/20": 80.0, "90/10": 90.0}
STRONG, MODERATE = 75.0, 50.0
HIGH_MARGIN, MEDIUM_MARGIN = 0.15, 0.05
FLOOR, CEILING = 0.02, 0.95


def _lookup(key: Column, values: dict, otherwise=None) -> Column:
    out = F.lit(otherwise)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def evaluation_system(value: Column) -> Column:
    return F.when(value.isNull(), F.lit(None)).when(value < SYSTEM_LIMIT, "80/20").otherwise("90/10")


def bbbee_points(level: Column, system: Column) -> Column:
    """0 for no level or one without points; null for an unknown system."""
    own = F.coalesce(level.cast("int"), F.lit(0))
    return F.when(system == "80/20", _lookup(own, POINTS["80/20"], 0)).when(system == "90/10", _lookup(own, POINTS["90/10"], 0))


def price_score(price: Column, lowest: Column, system: Column) -> Column:
    """Weight * (1 - (p - lowest) / lowest), p not under the lowest, not under 0; null where a part is missing."""
    weight = _lookup(system, PRICE_WEIGHT)
    return F.when(price.isNotNull() & (lowest > 0), F.greatest(F.lit(0.0), weight * (1 - (F.greatest(price, lowest) - lowest) / lowest)))


def total_score(price_points: Column, level_points: Column, goals: Column) -> Column:
    """struct(total, band, withheld): points with the level part scaled by the goals ratio."""
    total = price_points + level_points * F.coalesce(goals, F.lit(1.0))
    band = F.when(total >= STRONG, "Strong").when(total >= MODERATE, "Moderate").when(total.isNotNull(), "Weak")
    reason = F.when(price_points.isNull(), "price missing").when(level_points.isNull(), "system unknown")
    return F.struct(total.alias("total"), band.alias("band"), reason.alias("withheld"))


def adjust_probability(p: Column, score: Column, competitors: Column) -> Column:
    """0.6 p + 0.4 sqrt(share / n), or 0.4 * 0.3 * share where n is unknown; share = score / 100; clipped."""
    share = score / 100
    pull = F.when(competitors > 0, F.sqrt(share / competitors)).otherwise(0.3 * share)
    return F.greatest(F.lit(FLOOR), F.least(F.lit(CEILING), 0.6 * p + 0.4 * pull))


def recommend(p: Column, threshold: float, disqualified: Column | None = None) -> Column:
    """struct(recommendation, confidence): DISQUALIFIED first, then PURSUE at or above the threshold; null stays null."""
    out = F.lit(False) if disqualified is None else F.coalesce(disqualified, F.lit(False))
    margin = p - threshold
    word = F.when(out, "DISQUALIFIED").when(p >= threshold, "PURSUE").when(p < threshold, "PASS")
    level = F.when(out, "DISQUALIFIED").when(margin > HIGH_MARGIN, "HIGH").when(margin > MEDIUM_MARGIN, "MEDIUM").when(margin > 0, "LOW").when(p.isNotNull(), "PASS")
    return F.struct(word.alias("recommendation"), level.alias("confidence"))


def score_bids_in_lot(bids: DataFrame, lot: str = "lot_id", key: str = "bidder_masterid") -> DataFrame:
    """Points and rank of every bid in its lot. Input: lot, key, price, value, level, goals."""
    lowest = F.min(F.when(F.col("price") > 0, F.col("price"))).over(Window.partitionBy(lot))
    out = bids.withColumn("system", evaluation_system(F.col("value"))).withColumn("_low", lowest)
    out = out.withColumns({"price_points": price_score(F.col("price"), F.col("_low"), F.col("system")), "level_points": bbbee_points(F.col("level"), F.col("system"))})
    out = out.withColumn("score", total_score(F.col("price_points"), F.col("level_points").cast("double"), F.col("goals")))
    out = out.withColumns({"total": F.col("score.total"), "band": F.col("score.band"), "withheld": F.col("score.withheld")}).drop("score", "_low")
    return out.withColumn("rank_in_lot", F.row_number().over(Window.partitionBy(lot).orderBy(F.desc_nulls_last("total"), key)))
