"""Queries over scoring, profiling and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidlake.common import table
from bidlake.functions import scoring as R
from bidlake.operators import evaluation as M
from bidlake.operators import prepare as P
from bidlake.operators import profile as Q
from bidlake.plans.history_queries import PAIRS_SQL, pairs_of
from bidlake.plans.registry import query
from bidlake.plans.views import RAW_SQL, raw_contracts

# --- statutory scoring: order totals * 200 as tender values, levels from the supplier key -----------------------------

BIDS_SQL = RAW_SQL + """, b AS (
  SELECT lot_id, bidder_masterid, bid_price AS price, estimate * 200 AS value, CAST(CAST(bidder_masterid AS BIGINT) % 10 AS INTEGER) AS level, min(bid_price) FILTER (bid_price > 0) OVER (PARTITION BY lot_id) AS low FROM raw
), s AS (
  SELECT *, CASE WHEN value IS NULL THEN NULL WHEN value < 50000000 THEN '80/20' ELSE '90/10' END AS system FROM b
), p AS (
  SELECT *, CASE system WHEN '80/20' THEN coalesce([20, 18, 14, 12, 8, 6, 4, 2][level], 0) WHEN '90/10' THEN coalesce([10, 9, 6, 5, 4, 3, 2, 1][level], 0) END AS level_points,
         greatest(0.0, (CASE system WHEN '80/20' THEN 80.0 ELSE 90.0 END) * (1 - (price - low) / low)) AS price_points FROM s
)"""


def lot_bids(spark, sf_dir):
    raw = raw_contracts(spark, sf_dir)
    return raw.select("lot_id", "bidder_masterid", F.col("bid_price").alias("price"), (F.col("estimate") * 200).alias("value"), (F.col("bidder_masterid").cast("long") % 10).cast("int").alias("level"), F.lit(None).cast("double").alias("goals"))


@query("r1_evaluation_system", f"WITH {BIDS_SQL} SELECT lot_id, bidder_masterid, system FROM s")
def evaluation_system(spark, sf_dir):
    return lot_bids(spark, sf_dir).select("lot_id", "bidder_masterid", R.evaluation_system(F.col("value")).alias("system"))


@query("r2_bbbee_points", f"WITH {BIDS_SQL} SELECT lot_id, bidder_masterid, level, level_points FROM p")
def bbbee_points(spark, sf_dir):
    return lot_bids(spark, sf_dir).select("lot_id", "bidder_masterid", "level", R.bbbee_points(F.col("level"), R.evaluation_system(F.col("value"))).alias("level_points"))


@query("r3_price_score", f"WITH {BIDS_SQL} SELECT lot_id, bidder_masterid, round(price_points, 6) AS price_points FROM p")
def price_score(spark, sf_dir):
    return R.score_bids_in_lot(lot_bids(spark, sf_dir)).select("lot_id", "bidder_masterid", F.round("price_points", 6).alias("price_points"))


@query("r7_score_bids_in_lot", f"""WITH {BIDS_SQL} SELECT lot_id, bidder_masterid, system, round(price_points + level_points, 6) AS total,
CASE WHEN price_points + level_points >= 75 THEN 'Strong' WHEN price_points + level_points >= 50 THEN 'Moderate' ELSE 'Weak' END AS band,
CAST(row_number() OVER (PARTITION BY lot_id ORDER BY price_points + level_points DESC, bidder_masterid) AS INTEGER) AS rank_in_lot FROM p""")
def score_bids_in_lot(spark, sf_dir):
    out = R.score_bids_in_lot(lot_bids(spark, sf_dir))
    return out.select("lot_id", "bidder_masterid", "system", F.round("total", 6).alias("total"), "band", F.col("rank_in_lot").cast("int").alias("rank_in_lot"))


@query("r4_total_score", f"WITH {BIDS_SQL} SELECT lot_id, bidder_masterid, round(price_points + level_points * 0.5, 6) AS total, CAST(NULL AS VARCHAR) AS withheld FROM p")
def total_score(spark, sf_dir):
    out = R.score_bids_in_lot(lot_bids(spark, sf_dir).withColumn("goals", F.lit(0.5)))
    return out.select("lot_id", "bidder_masterid", F.round("total", 6).alias("total"), "withheld")


SCORED_SQL = """scored AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity / 50 AS score, CAST(l_returnflag <> 'R' AS INTEGER) AS label, l_discount, l_shipdate FROM lineitem)"""


def scored(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_quantity") / 50).alias("score"), (F.col("l_returnflag") != "R").cast("int").alias("label"), "l_discount", "l_shipdate")


@query("r5_adjust_probability", f"""WITH {SCORED_SQL} SELECT l_orderkey, l_linenumber, l_suppkey, score, round(greatest(0.02, least(0.95, 0.6 * score + 0.4 * sqrt(score * 0.8 / l_linenumber))), 6) AS adjusted FROM scored WHERE l_linenumber > 0""")
def adjust_probability(spark, sf_dir):
    out = scored(spark, sf_dir).where("l_linenumber > 0")
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "score", F.round(R.adjust_probability(F.col("score"), F.col("score") * 80, F.col("l_linenumber")), 6).alias("adjusted"))


@query("r6_recommend", f"""WITH {SCORED_SQL} SELECT l_orderkey, l_linenumber, l_suppkey, score, CASE WHEN l_discount > 0.09 THEN 'DISQUALIFIED' WHEN score >= 0.475 THEN 'PURSUE' ELSE 'PASS' END AS recommendation,
CASE WHEN l_discount > 0.09 THEN 'DISQUALIFIED' WHEN score - 0.475 > 0.15 THEN 'HIGH' WHEN score - 0.475 > 0.05 THEN 'MEDIUM' WHEN score - 0.475 > 0 THEN 'LOW' ELSE 'PASS' END AS confidence FROM scored""")
def recommend(spark, sf_dir):
    out = scored(spark, sf_dir).withColumn("r", R.recommend(F.col("score"), 0.475, F.col("l_discount") > 0.09))
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "score", "r.recommendation", "r.confidence")


# --- profiling ---------------------------------------------------------------------------------------------------------


@query("p1_schema_report")
def schema_report(spark, sf_dir):
    return Q.schema_report(table(spark, sf_dir, "lineitem"))


@query("p2_schema_diff")
def schema_diff(spark, sf_dir):
    return Q.schema_diff(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


@query("p3_row_counts", "SELECT coalesce(source, 'all') AS source, count(*) AS n_rows FROM (SELECT 'orders' AS source FROM orders UNION ALL SELECT 'lineitem' FROM lineitem UNION ALL SELECT 'events' FROM events) GROUP BY ROLLUP (source)")
def row_counts(spark, sf_dir):
    return Q.row_counts({n: table(spark, sf_dir, n) for n in ("orders", "lineitem", "events")})


@query("p5_null_rates", """SELECT 'lang' AS "column", round(100.0 * avg(CAST(lang IS NULL AS INTEGER)), 2) AS null_pct, CAST(CASE WHEN avg(CAST(lang IS NULL AS INTEGER)) > 0.5 THEN 'HIGH' END AS VARCHAR) AS flag FROM documents
UNION ALL SELECT 'toxic', round(100.0 * avg(CAST(toxic IS NULL AS INTEGER)), 2), CASE WHEN avg(CAST(toxic IS NULL AS INTEGER)) > 0.5 THEN 'HIGH' END FROM documents LEFT JOIN labels USING (doc_id)""")
def null_rates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return Q.null_rates(docs.join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left").select("lang", "toxic"))


@query("p6_top_values", """WITH v AS (SELECT 'event_type' AS "column", event_type AS value FROM events UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR) FROM events), c AS (
SELECT "column", value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank FROM c)
SELECT * FROM r WHERE rank <= 15""")
def top_values(spark, sf_dir):
    return Q.top_values(table(spark, sf_dir, "events"), ["event_type", "user_id"])


@query("p7_range_report", """SELECT 'o_orderstatus' AS "column", min(o_orderstatus) AS least, max(o_orderstatus) AS greatest, count(DISTINCT o_orderstatus) AS n_distinct FROM orders
UNION ALL SELECT 'o_orderpriority', min(o_orderpriority), max(o_orderpriority), count(DISTINCT o_orderpriority) FROM orders""")
def range_report(spark, sf_dir):
    return Q.range_report(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


def _summary_sql(c: str, t: str) -> str:
    q = lambda p: f"round(quantile_cont(v, {p}), 6)"
    return f"""SELECT '{c}' AS "column", count(v) AS n, min(v) AS least, {q(0.25)} AS p25, {q(0.5)} AS p50, {q(0.75)} AS p75, {q(0.95)} AS p95, max(v) AS greatest, round(avg(v), 6) AS mean FROM (SELECT try_cast({c} AS DOUBLE) AS v FROM {t})"""


@query("p8_numeric_summary", " UNION ALL ".join(_summary_sql(c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount")))
def numeric_summary(spark, sf_dir):
    out = Q.numeric_summary(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.withColumns({c: F.round(c, 6) for c in ("p25", "p50", "p75", "p95", "mean")})


@query("p9_bid_count_summary", f"WITH {RAW_SQL}, t AS (SELECT tender_id, count(*) AS n FROM raw GROUP BY 1) SELECT CAST(min(n) AS DOUBLE) AS least, CAST(max(n) AS DOUBLE) AS greatest, round(avg(n), 6) AS mean, count(n) AS n FROM t")
def bid_count_summary(spark, sf_dir):
    counts = raw_contracts(spark, sf_dir).groupBy("tender_id").agg(F.count("*").alias("n"))
    return Q.numeric_summary(counts, ["n"]).select("least", "greatest", F.round("mean", 6).alias("mean"), "n")


@query("p11_label_distribution", f"WITH {PAIRS_SQL} SELECT did_win, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM pairs), 2) AS pct FROM pairs GROUP BY 1")
def label_distribution(spark, sf_dir):
    return Q.label_distribution(pairs_of(spark, sf_dir), "did_win")


def _stats_sql(c: str) -> str:
    return f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS least, CAST(max({c}) AS DOUBLE) AS greatest, count(*) FILTER ({c} IS NULL) AS nulls, round(corr({c}, CAST(l_returnflag <> 'R' AS INTEGER)), 6) AS corr FROM lineitem"


@query("p12_feature_stats", " UNION ALL ".join(_stats_sql(c) for c in ("l_quantity", "l_discount", "l_tax")))
def feature_stats(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("label", (F.col("l_returnflag") != "R").cast("int"))
    return Q.feature_stats(line, ["l_quantity", "l_discount", "l_tax"], "label").withColumns({c: F.round(c, 6) for c in ("mean", "std", "corr")})


# --- evaluation --------------------------------------------------------------------------------------------------------


@query("m15_metrics", f"""WITH {SCORED_SQL}, r AS (SELECT label, score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ar FROM scored),
k AS (SELECT DISTINCT score, sum(label) OVER (ORDER BY score DESC) AS tp, count(*) OVER (ORDER BY score DESC) AS n, sum(label) OVER (PARTITION BY score) AS p FROM scored)
SELECT CAST(sum(label) AS BIGINT) AS positives, CAST(count(*) - sum(label) AS BIGINT) AS negatives,
  round((sum(ar) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 6) AS roc_auc, (SELECT round(sum(p * tp / n) / sum(p), 6) FROM k) AS pr_auc FROM r""")
def metrics(spark, sf_dir):
    return M.auc_table(scored(spark, sf_dir)).select("positives", "negatives", F.round("roc_auc", 6).alias("roc_auc"), F.round("pr_auc", 6).alias("pr_auc"))


@query("m15_confusion", f"""WITH {SCORED_SQL} SELECT count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label = 0) AS tn,
round(avg(-(label * ln(greatest(1e-15, least(1 - 1e-15, score))) + (1 - label) * ln(1 - greatest(1e-15, least(1 - 1e-15, score))))), 6) AS log_loss,
round(count(*) FILTER (score >= 0.5 AND label = 1) / count(*) FILTER (score >= 0.5), 6) AS precision, round(count(*) FILTER (score >= 0.5 AND label = 1) / sum(label), 6) AS recall FROM scored""")
def confusion(spark, sf_dir):
    return M.confusion(scored(spark, sf_dir), 0.5).withColumns({c: F.round(c, 6) for c in ("log_loss", "precision", "recall")})


@query("m13_threshold_f1", f"""WITH {SCORED_SQL}, g AS (SELECT CAST(range AS INTEGER) AS t FROM range(10, 91)), h AS (
SELECT t, count(*) FILTER (round(score * 100, 9) >= t AND label = 1) AS tp, count(*) FILTER (round(score * 100, 9) >= t AND label = 0) AS fp, sum(label) AS p FROM g, scored GROUP BY t),
f AS (SELECT t / 100 AS threshold, 2.0 * tp / (tp + fp + p) AS f1 FROM h)
SELECT threshold, round(f1, 9) AS f1, row_number() OVER (ORDER BY round(f1, 12) DESC, threshold) = 1 AS best FROM f""")
def threshold_f1(spark, sf_dir):
    return M.threshold_f1(scored(spark, sf_dir)).withColumn("f1", F.round("f1", 9))


@query("m14_threshold_business", f"""WITH {SCORED_SQL}, k AS (SELECT DISTINCT score, sum(label) OVER (ORDER BY score DESC) AS tp, count(*) OVER (ORDER BY score DESC) AS n FROM scored), r AS (SELECT score, tp / n AS pr, tp FROM k)
SELECT score AS threshold, round(pr, 6) AS precision, round(tp / (SELECT sum(label) FROM scored), 6) AS recall FROM r
ORDER BY CASE WHEN pr >= 0.67 THEN 0 WHEN pr >= 0.6 THEN 1 ELSE 2 END, CASE WHEN pr >= 0.6 THEN score ELSE -pr END, score LIMIT 1""")
def threshold_business(spark, sf_dir):
    return M.threshold_business(scored(spark, sf_dir), 0.67, 0.6).withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query("m16_calibration_bins", f"""WITH {SCORED_SQL}, g AS (SELECT CAST(range AS INTEGER) AS bin FROM range(10)), b AS (SELECT CAST(least(9, floor(round(score * 10, 9))) AS INTEGER) AS bin, score, label FROM scored WHERE score BETWEEN 0 AND 1)
SELECT g.bin, count(b.bin) AS n, round(avg(score), 6) AS mean_predicted, round(avg(label), 6) AS actual_rate FROM g LEFT JOIN b ON g.bin = b.bin GROUP BY g.bin""")
def calibration_bins(spark, sf_dir):
    return M.calibration_bins(scored(spark, sf_dir)).withColumns({"mean_predicted": F.round("mean_predicted", 6), "actual_rate": F.round("actual_rate", 6)})



@query("m17_hit_rate_at_k", f"""WITH {SCORED_SQL}, r AS (SELECT l_suppkey, label, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, l_orderkey, l_linenumber, label) AS n FROM scored), g AS (
SELECT l_suppkey, max(label) AS a, max(CASE WHEN n <= 3 THEN label ELSE 0 END) AS h FROM r GROUP BY 1) SELECT count(*) AS groups, round(avg(h), 6) AS hit_rate FROM g WHERE a = 1""")
def hit_rate_at_k(spark, sf_dir):
    keyed = scored(spark, sf_dir).withColumn("key", F.struct("l_orderkey", "l_linenumber", "label"))
    return M.hit_rate_at_k(keyed, "l_suppkey", "key", 3).withColumn("hit_rate", F.round("hit_rate", 6))


@query("m18_metrics_by_source", f"""WITH {SCORED_SQL}, r AS (SELECT l_linenumber AS source, label, rank() OVER (PARTITION BY l_linenumber ORDER BY score) + (count(*) OVER (PARTITION BY l_linenumber, score) - 1) / 2.0 AS ar FROM scored)
SELECT source, CAST(sum(label) AS BIGINT) AS positives, round((sum(ar) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / nullif(sum(label) * (count(*) - sum(label)), 0), 6) AS roc_auc FROM r GROUP BY 1""")
def metrics_by_source(spark, sf_dir):
    return M.auc_table(scored(spark, sf_dir), ["l_linenumber"]).select(F.col("l_linenumber").alias("source"), "positives", F.round("roc_auc", 6).alias("roc_auc"))


@query("m9_year_folds", f"""WITH {PAIRS_SQL}, y AS (SELECT publish_year, count(*) AS n, sum(did_win) AS p FROM pairs GROUP BY 1), c AS (
SELECT publish_year, n, p, sum(n) OVER w AS tn, sum(p) OVER w AS tp FROM y WINDOW w AS (ORDER BY publish_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT CAST(row_number() OVER (ORDER BY publish_year) AS INTEGER) AS fold, publish_year AS val_year, CAST(tn AS BIGINT) AS train_rows, n AS val_rows FROM c WHERE p > 0 AND p < n AND tp > 0 AND tp < tn""")
def year_folds(spark, sf_dir):
    return M.year_folds(pairs_of(spark, sf_dir))


@query("m9_block_folds", f"""WITH {PAIRS_SQL}, o AS (SELECT did_win, year(call_date) * 12 + month(call_date) AS k FROM pairs), u AS (SELECT did_win, count(*) OVER (ORDER BY k) AS upto, count(*) OVER () AS n FROM o), b AS (
SELECT did_win, CASE WHEN upto <= n - 5 * (n // 6) THEN 0 ELSE CAST(ceil((upto - (n - 5 * (n // 6))) / (n // 6)) AS INTEGER) END AS block FROM u), y AS (SELECT block, count(*) AS n, sum(did_win) AS p FROM b GROUP BY 1), c AS (
SELECT block, n, p, sum(n) OVER w AS tn, sum(p) OVER w AS tp FROM y WINDOW w AS (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT CAST(row_number() OVER (ORDER BY block) AS INTEGER) AS fold, block AS val_block, CAST(tn AS BIGINT) AS train_rows, n AS val_rows FROM c WHERE p > 0 AND p < n AND tp > 0 AND tp < tn""")
def block_folds(spark, sf_dir):
    return M.block_folds(pairs_of(spark, sf_dir).withColumn("months", F.year("call_date") * 12 + F.month("call_date")), "months")


@query("m20_validation_status", f"""WITH {SCORED_SQL}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ar FROM scored WHERE l_linenumber > 4), a AS (
SELECT round((sum(ar) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 6) AS auc FROM r) SELECT auc, CASE WHEN auc >= 0.6 THEN 'VALIDATED' ELSE 'NOT_VALIDATED' END AS status FROM a""")
def validation_status(spark, sf_dir):
    split = scored(spark, sf_dir).withColumn("split", F.when(F.col("l_linenumber") > 4, "test").otherwise("train"))
    return M.validation_status(M.auc_table(split, ["split"]).withColumn("roc_auc", F.round("roc_auc", 6)))


# --- splits and encoding -------------------------------------------------------------------------------------------------

SPLIT_SQL = PAIRS_SQL + """, y AS (SELECT publish_year, sum(count(*)) OVER (ORDER BY publish_year) / sum(count(*)) OVER () AS sh FROM pairs GROUP BY 1), m AS (SELECT max(publish_year) AS last FROM y),
t AS (SELECT arg_min(publish_year, (abs(sh - 0.6), publish_year)) AS te, arg_min(publish_year, (abs(sh - 0.8), publish_year)) AS ve FROM y, m WHERE publish_year < last),
c AS (SELECT te, CASE WHEN ve <= te THEN te + 1 ELSE ve END AS ve FROM t), d AS (SELECT CASE WHEN ve >= last AND te >= last - 1 THEN last - 2 ELSE te END AS te, CASE WHEN ve >= last THEN last - 1 ELSE ve END AS ve FROM c, m),
splits AS (SELECT pairs.*, CASE WHEN publish_year <= te THEN 'train' WHEN publish_year <= ve THEN 'val' ELSE 'test' END AS split FROM pairs, d)"""


@query("m2_time_split", f"WITH {SPLIT_SQL} SELECT pair_id, publish_year, split FROM splits")
def time_split(spark, sf_dir):
    return P.time_split(pairs_of(spark, sf_dir)).select("pair_id", "publish_year", "split")


@query("a13_split_stats", f"WITH {SPLIT_SQL} SELECT split, count(*) AS n_rows, min(publish_year) AS first_year, max(publish_year) AS last_year, CAST(sum(did_win) AS BIGINT) AS pos, CAST(count(*) - sum(did_win) AS BIGINT) AS neg, round(100.0 * sum(did_win) / count(*), 2) AS pos_pct FROM splits GROUP BY 1")
def split_stats(spark, sf_dir):
    out = P.time_split(pairs_of(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("n_rows"), F.min("publish_year").alias("first_year"), F.max("publish_year").alias("last_year"), F.sum("did_win").alias("pos"))
    return out.withColumns({"neg": F.col("n_rows") - F.col("pos"), "pos_pct": F.round(100.0 * F.col("pos") / F.col("n_rows"), 2)})


@query("m3_check_split", f"""WITH {SPLIT_SQL}, s AS (SELECT split, count(*) AS n, min(publish_year) AS lo, max(publish_year) AS hi FROM splits GROUP BY 1)
SELECT min(n) >= 30 AS large_enough, max(hi) FILTER (split = 'train') < max(lo) FILTER (split = 'val') AND max(hi) FILTER (split = 'val') < max(lo) FILTER (split = 'test') AS in_order FROM s""")
def check_split(spark, sf_dir):
    return P.check_split(P.time_split(pairs_of(spark, sf_dir)))


@query("m5_ordinal_encode", f"""WITH {SPLIT_SQL}, codes AS (SELECT buyer_country, CAST(row_number() OVER (ORDER BY buyer_country) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT buyer_country FROM splits WHERE split = 'train' AND tender_cpvs <> 'ECONOMY'))
SELECT pair_id, coalesce(codes.code, -1) AS buyer_country FROM splits LEFT JOIN codes USING (buyer_country)""")
def ordinal_encode(spark, sf_dir):
    pairs = P.time_split(pairs_of(spark, sf_dir))
    dictionary = P.ordinal_dictionary(pairs.where("split = 'train' AND tender_cpvs <> 'ECONOMY'"), ["buyer_country"])
    return P.ordinal_encode(pairs.select("pair_id", "buyer_country"), dictionary, ["buyer_country"])


@query("m5_ordinal_scoring", f"""WITH {SPLIT_SQL}, codes AS (SELECT buyer_country, CAST(row_number() OVER (ORDER BY buyer_country) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT buyer_country FROM splits WHERE split = 'train' AND tender_cpvs <> 'ECONOMY'))
SELECT pair_id, CASE WHEN did_win = 1 THEN coalesce(codes.code, -1) ELSE -2 END AS buyer_country FROM splits LEFT JOIN codes USING (buyer_country)""")
def ordinal_scoring(spark, sf_dir):
    """Values in lower case with blanks around them, and missing ones."""
    pairs = P.time_split(pairs_of(spark, sf_dir))
    dictionary = P.ordinal_dictionary(pairs.where("split = 'train' AND tender_cpvs <> 'ECONOMY'"), ["buyer_country"])
    asked = pairs.select("pair_id", F.when(F.col("did_win") == 1, F.concat(F.lit(" "), F.lower("buyer_country"), F.lit(" "))).alias("buyer_country"))
    return P.ordinal_encode(asked, dictionary, ["buyer_country"], scoring=True)


@query("m6_median_impute", f"""WITH {SPLIT_SQL}, k AS (SELECT pair_id, split, CASE WHEN bid_iswinning THEN bid_price END AS price FROM splits)
SELECT pair_id, round(coalesce(price, (SELECT median(price) FROM k WHERE split = 'train')), 6) AS price FROM k""")
def median_impute(spark, sf_dir):
    pairs = P.time_split(pairs_of(spark, sf_dir)).select("pair_id", "split", F.when(F.col("did_win") == 1, F.col("bid_price")).alias("price"))
    return P.median_impute(pairs, pairs.where("split = 'train'"), ["price"]).select("pair_id", F.round("price", 6).alias("price"))


@query("m4_coerce_numeric", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, event_type FROM events")
def coerce_numeric(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    return P.coerce_numeric(events)


@query("m7_bool_to_int", f"WITH {RAW_SQL} SELECT lot_id, bidder_masterid, CAST(bid_iswinning AS INTEGER) AS bid_iswinning FROM raw")
def bool_to_int(spark, sf_dir):
    return P.bool_to_int(raw_contracts(spark, sf_dir).select("lot_id", "bidder_masterid", "bid_iswinning"))


@query("m8_null_check", """SELECT 'l_discount' AS "column", CAST(0 AS DOUBLE) AS null_pct FROM lineitem HAVING count(*) FILTER (l_discount IS NULL) = 0 UNION ALL SELECT 'l_quantity', CAST(0 AS DOUBLE) FROM lineitem HAVING count(*) FILTER (l_quantity IS NULL) = 0""")
def null_check(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount")
    return Q.null_rates(P.median_impute(line, line, ["l_quantity", "l_discount"])).select("column", "null_pct")


@query("w10_cumulative_share_by_year", f"WITH {PAIRS_SQL} SELECT publish_year, round(sum(count(*)) OVER (ORDER BY publish_year) / sum(count(*)) OVER (), 6) AS share FROM pairs GROUP BY 1")
def cumulative_share(spark, sf_dir):
    from pyspark.sql import Window

    years = pairs_of(spark, sf_dir).groupBy("publish_year").agg(F.count("*").alias("n"))
    upto = Window.orderBy("publish_year").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("publish_year").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return years.select("publish_year", F.round(F.sum("n").over(upto) / F.sum("n").over(whole), 6).alias("share"))


@query("a11_class_balance", f"WITH {PAIRS_SQL} SELECT CASE WHEN did_win = 1 THEN 'winner' ELSE 'real_loser' END AS pair_type, count(*) AS n, round((SELECT count(*) FILTER (did_win = 0) / count(*) FILTER (did_win = 1) FROM pairs), 6) AS scale_pos_weight FROM pairs GROUP BY 1")
def class_balance(spark, sf_dir):
    per = pairs_of(spark, sf_dir).groupBy("pair_type", "did_win").agg(F.count("*").alias("n"))
    weight = per.agg(F.coalesce(F.try_divide(F.sum(F.when(F.col("did_win") == 0, F.col("n"))), F.sum(F.when(F.col("did_win") == 1, F.col("n")))), F.lit(1.0)).alias("w"))
    return per.crossJoin(F.broadcast(weight)).select("pair_type", "n", F.round("w", 6).alias("scale_pos_weight"))


@query("a12_year_distribution", f"WITH {PAIRS_SQL} SELECT publish_year, count(*) AS pairs, CAST(sum(did_win) AS BIGINT) AS wins, round(100.0 * sum(did_win) / count(*), 2) AS win_pct FROM pairs GROUP BY 1")
def year_distribution(spark, sf_dir):
    return pairs_of(spark, sf_dir).groupBy("publish_year").agg(F.count("*").alias("pairs"), F.sum("did_win").alias("wins"), F.round(100.0 * F.avg("did_win"), 2).alias("win_pct"))


@query("f8_size_ratio", f"""WITH {PAIRS_SQL}, a AS (SELECT bidder_name, avg(bid_price) AS v FROM raw GROUP BY 1) SELECT pair_id, round(coalesce(estimate, bid_price) / v, 6) AS tender_size_ratio FROM pairs JOIN a USING (bidder_name)""")
def size_ratio(spark, sf_dir):
    pairs = pairs_of(spark, sf_dir)
    means = pairs.groupBy("bidder_name").agg(F.avg("bid_price").alias("v"))
    return pairs.join(means, "bidder_name").select("pair_id", F.round(P.size_ratio(F.col("estimate"), F.col("bid_price"), F.col("v")), 6).alias("tender_size_ratio"))


@query("f9_source_tag", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'SA' ELSE 'GPPD' END AS source FROM orders")
def source_tag(spark, sf_dir):
    """Orders of a South African source, of others, and without a country."""
    country = F.when(F.col("o_custkey") % 3 == 0, "ZA").when(F.col("o_custkey") % 3 == 1, "UK")
    return table(spark, sf_dir, "orders").select("o_orderkey", P.source_tag(country).alias("source"))


@query("f10_experience_tier", f"""WITH {RAW_SQL}, w AS (SELECT buyer_masterid, count(*) FILTER (bid_iswinning) AS wins FROM raw GROUP BY 1)
SELECT buyer_masterid, CAST(CASE WHEN wins <= 0 THEN 0 WHEN wins <= 5 THEN 1 WHEN wins <= 20 THEN 2 WHEN wins <= 50 THEN 3 ELSE 4 END AS INTEGER) AS tier FROM w""")
def experience_tier(spark, sf_dir):
    wins = raw_contracts(spark, sf_dir).groupBy("buyer_masterid").agg(F.count_if("bid_iswinning").alias("wins"))
    return wins.select("buyer_masterid", P.experience_tier(F.col("wins")).alias("tier"))


@query("f7_sample_pairs")
def sample_pairs(spark, sf_dir):
    return P.sample_pairs(pairs_of(spark, sf_dir), 0.25, "pair_id").select("pair_id", "did_win")


@query("f13_align_features", "SELECT l_orderkey, l_linenumber, l_tax, CAST(7.0 AS DOUBLE) AS absent, l_quantity FROM lineitem")
def align_features(spark, sf_dir):
    return P.align_features(table(spark, sf_dir, "lineitem"), ["l_tax", "absent", "l_quantity"], {"absent": 7.0}, keys=["l_orderkey", "l_linenumber"])


@query("f14_tenant", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def tenant(spark, sf_dir):
    return P.tenant(table(spark, sf_dir, "orders"), 7, "o_custkey").select("o_orderkey", "o_totalprice")


FX = [("AUTOMOBILE", 1.0), ("BUILDING", 0.053), ("FURNITURE", 1.27)]


@query("f15_convert_currency", "SELECT c_custkey, round(c_acctbal * CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1.0 WHEN 'BUILDING' THEN 0.053 WHEN 'FURNITURE' THEN 1.27 END, 6) AS amount_usd FROM customer")
def convert_currency(spark, sf_dir):
    rates = spark.createDataFrame(FX, "currency string, usd_rate double")
    out = P.convert_currency(table(spark, sf_dir, "customer"), rates, "c_acctbal", "c_mktsegment")
    return out.select("c_custkey", F.round("amount_usd", 6).alias("amount_usd"))


@query("f16_default_country", "SELECT doc_id, CASE WHEN trim(coalesce(CASE WHEN doc_id % 3 = 0 THEN 'nan' WHEN doc_id % 3 = 1 THEN lang END, '')) IN ('', 'Unknown', 'nan', 'None') THEN 'ZA' ELSE lang END AS country FROM documents")
def default_country(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "nan").when(F.col("doc_id") % 3 == 1, F.col("lang")).alias("c"))
    return docs.select("doc_id", P.default_country(F.col("c")).alias("country"))


@query("f17_override_features", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def override_features(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    parsed = orders.where("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return P.override_features(orders, parsed, "o_orderkey")


@query("f18_what_if", "SELECT s.scenario, o_orderkey, coalesce(s.p, o_totalprice) AS o_totalprice FROM orders, (VALUES ('as is', NULL), ('half a million', 500000.0::DOUBLE)) AS s(scenario, p)")
def what_if(spark, sf_dir):
    scenarios = spark.createDataFrame([("as is", None), ("half a million", 500000.0)], "scenario string, o_totalprice double")
    return P.what_if(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), scenarios)


@query("f11_momentum", f"""WITH {RAW_SQL}, w AS (SELECT bidder_name, count(*) FILTER (bid_iswinning) AS wins, count(*) AS n, max(publish_year) AS y FROM raw GROUP BY 1)
SELECT bidder_name, round(wins * (1.0::DOUBLE / (2002 - y)), 4) AS win_momentum, round((wins / n) * (1.0::DOUBLE / (2002 - y)), 6) AS supplier_momentum FROM w""")
def momentum(spark, sf_dir):
    w = raw_contracts(spark, sf_dir).groupBy("bidder_name").agg(F.count_if("bid_iswinning").alias("wins"), F.count("*").alias("n"), F.max("publish_year").alias("y"))
    recency = F.lit(1.0) / (2002 - F.col("y"))
    return w.select("bidder_name", P.win_momentum(F.col("wins"), recency).alias("win_momentum"), F.round(P.supplier_momentum(F.col("wins") / F.col("n"), recency), 6).alias("supplier_momentum"))
