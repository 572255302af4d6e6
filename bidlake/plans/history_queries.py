"""Queries over bidder and buyer history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.common import forget_shuffles, materialize
from bidlake.operators import history as H
from bidlake.operators import prepare as P
from bidlake.plans.registry import query
from bidlake.plans.views import RAW_SQL, raw_contracts

PAIRS_SQL = RAW_SQL + """, pairs AS (
  SELECT lot_id || '_' || bidder_masterid AS pair_id, *, CAST(bid_iswinning AS INTEGER) AS did_win FROM raw
)"""


def pairs_of(spark: SparkSession, sf_dir: str, cpvs: bool = True) -> DataFrame:
    return P.build_pairs(raw_contracts(spark, sf_dir, cpvs))


@query("f5_build_pairs", f"""WITH {PAIRS_SQL} SELECT pair_id, tender_id, lot_id, bidder_masterid, buyer_masterid, did_win,
CASE WHEN bid_iswinning THEN 'winner' ELSE 'real_loser' END AS pair_type, publish_year FROM pairs""")
def build_pairs(spark, sf_dir):
    return pairs_of(spark, sf_dir).select("pair_id", "tender_id", "lot_id", "bidder_masterid", "buyer_masterid", "did_win", "pair_type", "publish_year")


@query("f6_temporal_features", f"""WITH {PAIRS_SQL} SELECT pair_id, CAST(month(call_date) AS INTEGER) AS publish_month, CAST(quarter(call_date) AS INTEGER) AS publish_quarter,
CAST(least(abs(date_diff('day', CAST(call_date AS DATE), CAST(deadline AS DATE))), 365) AS INTEGER) AS deadline_days FROM pairs""")
def temporal(spark, sf_dir):
    return P.temporal_features(pairs_of(spark, sf_dir)).select("pair_id", "publish_month", "publish_quarter", "deadline_days")


YEARS = "SELECT {keys}, publish_year, count(*) AS entries, count(*) FILTER (bid_iswinning) AS wins{more} FROM raw GROUP BY {keys}, publish_year"


@query("a1_bidder_year", f"WITH {RAW_SQL} " + YEARS.format(keys="bidder_name", more=", round(coalesce(sum(bid_price) FILTER (bid_iswinning), 0), 2) AS price_sum, count(bid_price) FILTER (bid_iswinning) AS priced_wins, max(publish_year) FILTER (bid_iswinning) AS last_win_year"))
def bidder_year(spark, sf_dir):
    return H.entries_by_year(raw_contracts(spark, sf_dir), [H.BIDDER]).withColumn("price_sum", F.round("price_sum", 2))


@query("a2_bidder_country_year", f"WITH {RAW_SQL} " + YEARS.format(keys="bidder_name, buyer_country", more=""))
def bidder_country_year(spark, sf_dir):
    return H.entries_by_year(raw_contracts(spark, sf_dir), [H.BIDDER, H.COUNTRY]).select(H.BIDDER, H.COUNTRY, H.YEAR, "entries", "wins")


@query("a3_bidder_buyer_year", f"WITH {RAW_SQL} " + YEARS.format(keys="bidder_name, buyer_masterid", more=""))
def bidder_buyer_year(spark, sf_dir):
    return H.entries_by_year(raw_contracts(spark, sf_dir), [H.BIDDER, H.BUYER]).select(H.BIDDER, H.BUYER, H.YEAR, "entries", "wins")


BY_YEAR_SQL = RAW_SQL + """, by_year AS (
  SELECT bidder_name, publish_year, count(*) AS entries, count(*) FILTER (bid_iswinning) AS wins, max(publish_year) FILTER (bid_iswinning) AS last_win_year FROM raw GROUP BY 1, 2
)"""


@query("w1_cumulative", f"""WITH {BY_YEAR_SQL} SELECT bidder_name, publish_year, CAST(sum(entries) OVER w AS BIGINT) AS cum_entries, CAST(sum(wins) OVER w AS BIGINT) AS cum_wins,
max(last_win_year) OVER w AS run_last_win_year FROM by_year WINDOW w AS (PARTITION BY bidder_name ORDER BY publish_year ROWS UNBOUNDED PRECEDING)""")
def cumulative(spark, sf_dir):
    totals = H.entries_by_year(raw_contracts(spark, sf_dir), [H.BIDDER])
    return H.cumulative(totals, [H.BIDDER], H.YEAR, ["entries", "wins"], ["last_win_year"]).select(H.BIDDER, H.YEAR, "cum_entries", "cum_wins", "run_last_win_year")


@query("w2_prior", f"""WITH {BY_YEAR_SQL} SELECT bidder_name, publish_year, CAST(sum(entries) OVER w AS BIGINT) AS prior_entries, CAST(sum(wins) OVER w AS BIGINT) AS prior_wins
FROM by_year WINDOW w AS (PARTITION BY bidder_name ORDER BY publish_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def prior(spark, sf_dir):
    totals = H.entries_by_year(raw_contracts(spark, sf_dir), [H.BIDDER])
    return H.prior(totals, [H.BIDDER], H.YEAR, ["entries", "wins"]).select(H.BIDDER, H.YEAR, "prior_entries", "prior_wins")


@query("w3_share", f"WITH {BY_YEAR_SQL} SELECT bidder_name, publish_year, round(wins / sum(wins) OVER (PARTITION BY bidder_name), 6) AS share FROM by_year")
def share(spark, sf_dir):
    totals = H.entries_by_year(raw_contracts(spark, sf_dir), [H.BIDDER])
    return H.share(totals, [H.BIDDER], "wins").select(H.BIDDER, H.YEAR, F.round("share", 6).alias("share"))


ASOF_SQL = f"""WITH {BY_YEAR_SQL}, running AS (
  SELECT bidder_name, publish_year, CAST(sum(entries) OVER w AS BIGINT) AS e, CAST(sum(wins) OVER w AS BIGINT) AS n
  FROM by_year WINDOW w AS (PARTITION BY bidder_name ORDER BY publish_year ROWS UNBOUNDED PRECEDING)
)
SELECT lot_id || '_' || bidder_masterid AS pair_id, r.publish_year, s.e AS prior_entries, s.n AS prior_wins,
       round(CASE WHEN s.e > 0 THEN s.n / s.e ELSE 0 END, 6) AS win_rate
FROM raw r ASOF LEFT JOIN running s ON r.bidder_name = s.bidder_name AND r.publish_year - 1 >= s.publish_year"""


@query("j2_asof_win_rate", ASOF_SQL)
def asof_win_rate(spark, sf_dir):
    """For every bid, the bidder's win rate in strictly earlier years."""
    bids = materialize(raw_contracts(spark, sf_dir).select("lot_id", "bidder_masterid", H.BIDDER, H.YEAR, "bid_iswinning", "bid_price", "tender_id"), "bids")
    pairs = P.build_pairs(bids).select("pair_id", H.BIDDER, H.YEAR)
    running = H.cumulative(H.entries_by_year(bids, [H.BIDDER]), [H.BIDDER], H.YEAR, ["entries", "wins"])
    stats = running.select(H.BIDDER, H.YEAR, F.col("cum_entries").alias("prior_entries"), F.col("cum_wins").alias("prior_wins"))
    out = H.asof_left(pairs, stats, [H.BIDDER], H.YEAR, H.YEAR, ["prior_entries", "prior_wins"])
    rate = F.when(F.col("prior_entries") > 0, F.col("prior_wins") / F.col("prior_entries")).otherwise(F.lit(0.0))
    return out.select("pair_id", H.YEAR, "prior_entries", "prior_wins", F.round(rate, 6).alias("win_rate"))


@query("j3_prior_category_wins", f"""WITH {RAW_SQL}, probe AS (SELECT DISTINCT bidder_name, publish_year FROM raw)
SELECT p.bidder_name, p.publish_year, substring(r.tender_cpvs, 1, 2) AS category, count(*) AS wins
FROM probe p JOIN raw r ON r.bidder_name = p.bidder_name AND r.bid_iswinning AND r.publish_year < p.publish_year GROUP BY 1, 2, 3""")
def prior_category_wins(spark, sf_dir):
    bids = raw_contracts(spark, sf_dir)
    return H.prior_category_wins(bids, bids).select(H.BIDDER, H.YEAR, "category", "wins")


@query("a4_category_hhi", f"""WITH {RAW_SQL}, probe AS (SELECT DISTINCT bidder_name, publish_year FROM raw), c AS (
SELECT p.bidder_name, p.publish_year, substring(r.tender_cpvs, 1, 2) AS category, count(*) AS n
FROM probe p JOIN raw r ON r.bidder_name = p.bidder_name AND r.bid_iswinning AND r.publish_year < p.publish_year GROUP BY 1, 2, 3)
SELECT bidder_name, publish_year, round(sum(n * n) / (sum(n) * sum(n)), 6) AS category_hhi FROM c GROUP BY 1, 2""")
def category_hhi(spark, sf_dir):
    bids = raw_contracts(spark, sf_dir)
    return H.category_hhi(bids, bids).withColumn("category_hhi", F.round("category_hhi", 6))


@query("j5_countries_so_far", f"""WITH {RAW_SQL}, first AS (SELECT bidder_name, buyer_country, min(publish_year) AS y FROM raw GROUP BY 1, 2)
SELECT f.bidder_name, f.y AS publish_year, (SELECT count(*) FROM first g WHERE g.bidder_name = f.bidder_name AND g.y <= f.y) AS country_count FROM first f GROUP BY 1, 2""")
def countries_so_far(spark, sf_dir):
    return H.countries_so_far(raw_contracts(spark, sf_dir))


FEATURES_SQL = f"""WITH {PAIRS_SQL}, b AS (
  SELECT p.pair_id, count(r.lot_id) AS t_entries, count(*) FILTER (r.bid_iswinning) AS t_wins, sum(r.bid_price) FILTER (r.bid_iswinning) AS t_sum, count(r.bid_price) FILTER (r.bid_iswinning) AS t_priced,
         max(r.publish_year) FILTER (r.bid_iswinning) AS t_last,
         count(*) FILTER (r.buyer_country = p.buyer_country) AS c_entries, count(*) FILTER (r.buyer_country = p.buyer_country AND r.bid_iswinning) AS c_wins,
         count(*) FILTER (r.buyer_masterid = p.buyer_masterid) AS b_entries, count(*) FILTER (r.buyer_masterid = p.buyer_masterid AND r.bid_iswinning) AS b_wins,
         count(DISTINCT r.buyer_country) AS countries, any_value(p.publish_year) AS y
  FROM pairs p LEFT JOIN raw r ON r.bidder_name = p.bidder_name AND r.publish_year < p.publish_year GROUP BY p.pair_id
), c AS (
  SELECT p.bidder_name, p.publish_year, substring(r.tender_cpvs, 1, 2) AS category, count(*) AS n
  FROM (SELECT DISTINCT bidder_name, publish_year FROM raw) p JOIN raw r ON r.bidder_name = p.bidder_name AND r.bid_iswinning AND r.publish_year < p.publish_year GROUP BY 1, 2, 3
), h AS (SELECT bidder_name, publish_year, sum(n * n) / (sum(n) * sum(n)) AS hhi FROM c GROUP BY 1, 2)
SELECT b.pair_id, t_entries AS pit_total_entries, t_wins AS pit_total_wins, round(CASE WHEN t_entries > 0 THEN t_wins / t_entries ELSE 0 END, 6) AS pit_win_rate_overall,
  round(CASE WHEN c_entries > 0 THEN c_wins / c_entries ELSE 0 END, 6) AS pit_win_rate_country, round(CASE WHEN t_priced > 0 THEN round(t_sum, 4) / t_priced ELSE 0 END, 2) AS pit_avg_contract_value,
  CAST(CASE WHEN t_last IS NULL THEN 10 ELSE greatest(0, y - t_last) END AS DOUBLE) AS pit_last_win_years_ago, round(ln(1 + t_wins), 6) AS pit_experience_score,
  round(1.0 / (1 + CASE WHEN t_last IS NULL THEN 10 ELSE greatest(0, y - t_last) END), 6) AS pit_recency_score, CAST(b_wins > 0 AS INTEGER) AS pit_is_incumbent,
  countries AS pit_country_count, CAST(countries > 1 AS INTEGER) AS pit_is_international, b_wins AS pit_buyer_win_count, b_entries AS pit_buyer_entry_count,
  round(CASE WHEN b_entries > 0 THEN b_wins / b_entries ELSE 0 END, 6) AS pit_win_rate_buyer, round(CASE WHEN t_wins > 0 THEN b_wins / t_wins ELSE 0 END, 6) AS buyer_loyalty_score,
  round(coalesce(hhi, 0), 6) AS category_hhi
FROM b JOIN pairs p ON p.pair_id = b.pair_id LEFT JOIN h ON h.bidder_name = p.bidder_name AND h.publish_year = p.publish_year"""
ROUNDED = ("pit_win_rate_overall", "pit_win_rate_country", "pit_experience_score", "pit_recency_score", "pit_win_rate_buyer", "buyer_loyalty_score", "category_hhi")


@query("a5_supplier_features", FEATURES_SQL)
def supplier_features(spark, sf_dir):
    columns = ["lot_id", "bidder_masterid", H.BIDDER, H.BUYER, H.COUNTRY, H.YEAR, "bid_iswinning", "bid_price", "tender_cpvs"]
    bids = materialize(raw_contracts(spark, sf_dir).select(*columns), "bids")
    forget_shuffles(spark)
    out = H.supplier_features(bids, P.build_pairs(bids))
    return out.withColumns({c: F.round(c, 6) for c in ROUNDED} | {"pit_avg_contract_value": F.round("pit_avg_contract_value", 2)})


@query("a6_competition", f"""WITH {PAIRS_SQL} SELECT pair_id, count(*) OVER (PARTITION BY lot_id) AS actual_num_competitors, round(1.0 / count(*) OVER (PARTITION BY lot_id), 6) AS competition_baseline FROM pairs""")
def competition(spark, sf_dir):
    out = H.competition(pairs_of(spark, sf_dir))
    return out.select("pair_id", "actual_num_competitors", F.round("competition_baseline", 6).alias("competition_baseline"))


BUYER_SQL = RAW_SQL + """, by_buyer AS (
  SELECT buyer_masterid, publish_year, count(*) FILTER (bid_iswinning) AS awards, coalesce(sum(bid_price) FILTER (bid_iswinning), 0) AS price_sum, count(bid_price) FILTER (bid_iswinning) AS priced_awards,
         count(DISTINCT lot_id) AS lots, count(*) AS n_rows FROM raw GROUP BY 1, 2
)"""


@query("a7_buyer_year", f"WITH {BUYER_SQL} SELECT buyer_masterid, publish_year, awards, round(price_sum, 2) AS price_sum, priced_awards, lots, n_rows FROM by_buyer")
def buyer_year(spark, sf_dir):
    return H.buyer_year(raw_contracts(spark, sf_dir)).withColumn("price_sum", F.round("price_sum", 2))


@query("a8_buyer_history", f"""WITH {BUYER_SQL} SELECT buyer_masterid, publish_year, CAST(coalesce(sum(awards) OVER w, 0) AS BIGINT) AS buyer_total_past_awards,
round(sum(price_sum) OVER w / nullif(sum(priced_awards) OVER w, 0), 7) AS buyer_avg_contract_value, round(sum(n_rows) OVER w / nullif(sum(lots) OVER w, 0), 6) AS buyer_avg_competitors
FROM by_buyer WINDOW w AS (PARTITION BY buyer_masterid ORDER BY publish_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def buyer_history(spark, sf_dir):
    out = H.buyer_history(raw_contracts(spark, sf_dir))
    return out.withColumns({"buyer_avg_contract_value": F.round("buyer_avg_contract_value", 7), "buyer_avg_competitors": F.round("buyer_avg_competitors", 6)})


@query("a9_buyer_specialisation", f"""WITH {RAW_SQL}, k AS (SELECT DISTINCT buyer_masterid, substring(tender_cpvs, 1, 2) AS category, publish_year FROM raw)
SELECT k.buyer_masterid, k.category, k.publish_year,
       round(coalesce(count(*) FILTER (substring(r.tender_cpvs, 1, 2) = k.category) / nullif(count(r.lot_id), 0), 0), 6) AS buyer_specialisation
FROM k LEFT JOIN raw r ON r.buyer_masterid = k.buyer_masterid AND r.publish_year < k.publish_year AND r.bid_iswinning GROUP BY 1, 2, 3""")
def buyer_specialisation(spark, sf_dir):
    return H.buyer_specialisation(raw_contracts(spark, sf_dir)).withColumn("buyer_specialisation", F.round("buyer_specialisation", 6))


@query("a10_buyer_openness", f"""WITH {PAIRS_SQL}, k AS (
  SELECT p.pair_id, p.buyer_masterid, p.publish_year, p.did_win, EXISTS (SELECT 1 FROM raw r WHERE r.bidder_name = p.bidder_name AND r.buyer_masterid = p.buyer_masterid AND r.bid_iswinning AND r.publish_year < p.publish_year) AS inc FROM pairs p
), o AS (SELECT buyer_masterid, round(avg(CASE WHEN inc THEN 0.0 ELSE 1.0 END), 4) AS v FROM k WHERE did_win = 1 AND publish_year <= 1998 GROUP BY 1)
SELECT pair_id, round(coalesce(v, (SELECT round(avg(v), 4) FROM o)), 3) AS buyer_openness FROM k LEFT JOIN o USING (buyer_masterid)""")
def buyer_openness(spark, sf_dir):
    columns = ["lot_id", "bidder_masterid", H.BIDDER, H.BUYER, H.YEAR, "bid_iswinning"]
    bids = materialize(raw_contracts(spark, sf_dir, cpvs=False).select(*columns), "bids")
    forget_shuffles(spark)
    pairs = P.build_pairs(bids)
    train = H.incumbents(bids, pairs.where("publish_year <= 1998 and did_win = 1").select(H.BIDDER, H.BUYER, H.YEAR, "did_win"))
    return H.buyer_openness(train, pairs.select("pair_id", H.BUYER)).select("pair_id", F.round("buyer_openness", 3).alias("buyer_openness"))


@query("u5_distinct_keys", f"WITH {RAW_SQL} SELECT DISTINCT bidder_name, publish_year FROM raw")
def distinct_keys(spark, sf_dir):
    return raw_contracts(spark, sf_dir).select(H.BIDDER, H.YEAR).dropDuplicates()


@query("j4_attach_features", f"WITH {PAIRS_SQL} SELECT pair_id, did_win, count(*) OVER (PARTITION BY lot_id) AS actual_num_competitors FROM pairs")
def attach_features(spark, sf_dir):
    pairs = pairs_of(spark, sf_dir)
    return pairs.select("pair_id", "did_win").join(H.competition(pairs).select("pair_id", "actual_num_competitors"), "pair_id", "left")
