"""Queries over operational reports, joins, set operations and ordered lists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bidlake.common import forget_shuffles, materialize, table
from bidlake.operators import prepare as P
from bidlake.operators import reports as A
from bidlake.plans.history_queries import PAIRS_SQL, pairs_of
from bidlake.operators.containment import contained
from bidlake.operators.ranks import running_over
from bidlake.plans.registry import query
from bidlake.plans.views import RAW_SQL, raw_contracts

OUT_SQL = """o AS (SELECT l_orderkey, l_suppkey, l_shipdate, l_quantity / 50 AS p, CASE WHEN l_quantity >= 25 THEN 'PURSUE' ELSE 'PASS' END AS r,
CASE WHEN l_linenumber = 1 THEN 'pending' WHEN l_linenumber = 2 THEN 'withdrawn' WHEN l_returnflag <> 'R' THEN 'won' ELSE 'lost' END AS a FROM lineitem)"""


def outcomes(spark, sf_dir):
    kind = F.when(F.col("l_linenumber") == 1, "pending").when(F.col("l_linenumber") == 2, "withdrawn").when(F.col("l_returnflag") != "R", "won").otherwise("lost")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_shipdate", (F.col("l_quantity") / 50).alias("predicted_probability"), F.when(F.col("l_quantity") >= 25, "PURSUE").otherwise("PASS").alias("recommendation"), kind.alias("actual_outcome")
    )


ACC = "round(count(*) FILTER ((r = 'PURSUE' AND a = 'won') OR (r = 'PASS' AND a = 'lost')) / nullif(count(*) FILTER (a IN ('won', 'lost')), 0), 6)"


@query("a14_accuracy_stats", f"""WITH {OUT_SQL} SELECT count(*) FILTER (a = 'pending') AS pending, count(*) FILTER (a = 'won') AS won, count(*) FILTER (a = 'lost') AS lost, count(*) FILTER (a = 'withdrawn') AS withdrawn,
coalesce({ACC}, 0) AS accuracy, round(count(*) FILTER (r = 'PURSUE' AND a = 'won') / count(*) FILTER (r = 'PURSUE' AND a IN ('won', 'lost')), 6) AS precision,
round(avg(p) FILTER (a = 'won'), 6) AS mean_won, round(avg(p) FILTER (a = 'lost'), 6) AS mean_lost FROM o""")
def accuracy_stats(spark, sf_dir):
    return A.accuracy_stats(outcomes(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "mean_won", "mean_lost")})


@query("a15_accuracy_trend", f"WITH {OUT_SQL} SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, count(*) FILTER (a = 'won') AS won, count(*) FILTER (a = 'lost') AS lost, coalesce({ACC}, 0) AS accuracy FROM o GROUP BY 1")
def accuracy_trend(spark, sf_dir):
    return A.accuracy_trend(outcomes(spark, sf_dir), "l_shipdate").withColumn("accuracy", F.round("accuracy", 6))


@query("a16_track_record", f"WITH {OUT_SQL} SELECT l_suppkey, count(*) FILTER (a = 'won') AS wins, count(*) FILTER (a = 'lost') AS losses, round(100.0 * count(*) FILTER (a = 'won') / nullif(count(*) FILTER (a IN ('won', 'lost')), 0), 2) AS win_pct FROM o GROUP BY 1")
def track_record(spark, sf_dir):
    return A.track_record(outcomes(spark, sf_dir), "l_suppkey")


@query("a17_pipeline_stats", f"WITH {OUT_SQL} SELECT count(*) AS total, count(*) FILTER (r = 'PURSUE') AS pursue, round(avg(p), 6) AS mean_probability FROM o")
def pipeline_stats(spark, sf_dir):
    return A.pipeline_stats(outcomes(spark, sf_dir)).withColumn("mean_probability", F.round("mean_probability", 6))


@query("a18_api_summary", """SELECT count(*) AS calls, round(sum(value) / 1000, 4) AS cost, count(*) FILTER (event_type = 'signup') AS rate_limited, count(*) FILTER (event_type = 'error') AS errors,
sum(value) / 1000 > 50 AS cost_alert, count(*) FILTER (event_type = 'signup') > 10 AS limit_alert FROM events""")
def api_summary(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select((F.col("value") / 1000).alias("cost_usd"), F.when(F.col("event_type") == "error", "error:500").otherwise("ok").alias("status"), (F.col("event_type") == "signup").alias("is_rate_limited"))
    return A.api_summary(calls).withColumn("cost", F.round("cost", 4))


LOG_SQL = "SELECT event_type AS endpoint, CAST(user_id AS VARCHAR) AS company, CASE WHEN value > 400 THEN 'ERROR' ELSE 'INFO' END AS severity FROM events"


@query("a19_log_report", f"SELECT endpoint, company, count(*) AS calls, count(*) FILTER (severity = 'ERROR') AS errors FROM ({LOG_SQL}) GROUP BY GROUPING SETS ((endpoint), (company), ())")
def log_report(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("endpoint"), F.col("user_id").cast("string").alias("company"), F.when(F.col("value") > 400, "ERROR").otherwise("INFO").alias("severity"))
    return A.log_report(log)


@query("a20_usage_today", """WITH u AS (SELECT user_id AS company_id, event_type AS action_type, CAST(ts AS DATE) AS day, count(*) AS used FROM events GROUP BY 1, 2, 3), l AS (
SELECT *, CASE WHEN action_type NOT IN ('purchase', 'view') THEN 0 WHEN company_id % 3 = 0 THEN 0 WHEN company_id % 3 = 1 THEN CASE action_type WHEN 'purchase' THEN 5 ELSE 3 END ELSE CASE action_type WHEN 'purchase' THEN 50 ELSE 25 END END AS daily FROM u)
SELECT company_id, action_type, day, used, CAST(daily AS INTEGER) AS daily, greatest(0, daily - used) AS remaining, used < daily AS allowed FROM l""")
def usage_today(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("company_id"), F.col("event_type").alias("action_type"), "ts")
    tier = F.when(F.col("company_id") % 3 == 0, "starter").when(F.col("company_id") % 3 == 1, "pro").otherwise("enterprise")
    companies = events.select("company_id").distinct().withColumn("tier", tier)
    tiers = spark.createDataFrame([(t, a, n) for t, quotes, fills in A.TIERS for a, n in (("purchase", quotes), ("view", fills))], "tier string, action_type string, daily int")
    return A.usage_today(events, companies, tiers)


@query("a21_token_cost", """SELECT user_id, round(sum((CAST(json_extract_string(props, '$.k') AS BIGINT) * CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 3.0 ELSE 15.0 END + 10 * CASE event_type WHEN 'view' THEN 5.0 WHEN 'click' THEN 15.0 ELSE 75.0 END) / 1e6), 9) AS cost_usd,
CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens_in, CAST(sum(10) AS BIGINT) AS tokens_out FROM events GROUP BY 1""")
def token_cost(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("model"), F.get_json_object("props", "$.k").cast("long").alias("tokens_in"), F.lit(10).alias("tokens_out"))
    prices = spark.createDataFrame([("view", 1.0, 5.0), ("click", 3.0, 15.0), ("large", 15.0, 75.0)], "model string, usd_in double, usd_out double")
    return A.token_cost(calls, prices, ["user_id"]).withColumn("cost_usd", F.round("cost_usd", 9))


ITEMS_SQL = """i AS (SELECT l_orderkey AS pack_id, CASE WHEN l_linenumber <= 4 THEN 'flag' ELSE 'value' END AS what, l_tax >= 0.06 AS advisory, l_linestatus = 'F' AS done, l_returnflag AS kind, l_linenumber, l_suppkey, l_shipdate FROM lineitem)"""


def items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pack_id"), F.when(F.col("l_linenumber") <= 4, "flag").otherwise("value").alias("what"), (F.col("l_tax") >= 0.06).alias("advisory"), (F.col("l_linestatus") == "F").alias("done"), F.col("l_returnflag").alias("kind"), "l_linenumber", "l_suppkey", "l_shipdate"
    )


ROLL_SQL = ITEMS_SQL + """, roll AS (SELECT pack_id, count(*) FILTER (what = 'flag') AS flags, count(*) FILTER (what = 'flag' AND done) AS acknowledged, count(*) FILTER (what = 'flag' AND NOT done AND NOT advisory) AS outstanding,
count(*) FILTER (what = 'flag' AND advisory) AS advisory, count(*) FILTER (what = 'value') AS filled, count(*) FILTER (what = 'value' AND NOT done) AS unconfirmed FROM i GROUP BY 1)"""


@query("a22_pack_progress", f"WITH {ITEMS_SQL} SELECT pack_id, count(*) AS total, count(*) FILTER (done) AS done FROM i GROUP BY 1")
def pack_progress(spark, sf_dir):
    return items(spark, sf_dir).groupBy("pack_id").agg(F.count("*").alias("total"), F.count_if("done").alias("done"))


@query("a23_pack_rollup", f"WITH {ROLL_SQL} SELECT * FROM roll")
def pack_rollup(spark, sf_dir):
    return A.pack_rollup(items(spark, sf_dir))


@query("a24_flags_by_kind", f"WITH {ITEMS_SQL} SELECT kind, count(*) AS n FROM i WHERE what = 'flag' AND NOT done AND NOT advisory GROUP BY 1")
def flags_by_kind(spark, sf_dir):
    return items(spark, sf_dir).where("what = 'flag' AND NOT done AND NOT advisory").groupBy("kind").agg(F.count("*").alias("n"))


@query("a25_pack_status", f"""WITH {ROLL_SQL} SELECT o_orderkey AS pack_id, CASE WHEN o_orderstatus = 'P' THEN 'processing' WHEN coalesce(outstanding, 0) = 0 AND coalesce(unconfirmed, 0) = 0 THEN 'reviewed' ELSE 'needs_review' END AS status
FROM orders LEFT JOIN roll ON pack_id = o_orderkey""")
def pack_status(spark, sf_dir):
    stored = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pack_id"), F.when(F.col("o_orderstatus") == "P", "processing").otherwise("submitted").alias("status"))
    return A.pack_status(A.pack_rollup(items(spark, sf_dir)), stored)


@query("a26_outstanding_groups", f"""WITH {ITEMS_SQL}, k AS (SELECT *, CASE WHEN kind IN ('A', 'N') THEN kind ELSE kind || ':' || pack_id || '/' || l_linenumber END AS group_key FROM i WHERE what = 'flag' AND NOT done)
SELECT group_key, count(*) AS n, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS pages, array_to_string(list_sort(list_distinct(list(CAST(l_suppkey AS VARCHAR))))[1:6], ',') AS labels FROM k GROUP BY 1""")
def outstanding_groups(spark, sf_dir):
    flat = items(spark, sf_dir).where("what = 'flag' AND NOT done").select(F.col("kind").alias("reason"), F.concat_ws("/", F.col("pack_id").cast("string"), F.col("l_linenumber").cast("string")).alias("item_key"), F.col("l_linenumber").alias("page"), F.col("l_suppkey").cast("string").alias("label"))
    out = A.outstanding_groups(flat, ["A", "N"])
    return out.select("group_key", "n", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), F.array_join("labels", ",").alias("labels"))


@query("a27_missing_fields", f"""WITH {ITEMS_SQL}, h AS (SELECT DISTINCT l_suppkey, kind FROM i WHERE what = 'value' AND l_linenumber = 5 AND done AND pack_id % 50 = 0)
SELECT i.l_suppkey AS company_id, i.kind AS field, count(*) AS n, array_to_string(list_sort(list_distinct(list(CAST(i.pack_id AS VARCHAR))))[1:5], ',') AS labels, array_to_string(list_sort(list_distinct(list(CASE WHEN i.pack_id % 4 > 0 THEN 'page ' || i.pack_id % 4 END))), ',') AS locations, CAST(row_number() OVER (PARTITION BY i.l_suppkey ORDER BY count(*) DESC, i.kind) AS INTEGER) AS need FROM i ANTI JOIN h ON i.l_suppkey = h.l_suppkey AND i.kind = h.kind WHERE what = 'flag' GROUP BY 1, 2""")
def missing_fields(spark, sf_dir):
    all_items = items(spark, sf_dir)
    wanted = all_items.where("what = 'flag'").select(F.col("l_suppkey").alias("company_id"), F.col("kind").alias("field"), F.col("pack_id").cast("string").alias("label"), F.when(F.col("pack_id") % 4 > 0, F.concat(F.lit("page "), (F.col("pack_id") % 4).cast("string"))).otherwise("").alias("location"))
    profile = all_items.where("what = 'value' AND l_linenumber = 5 AND done AND pack_id % 50 = 0").select(F.col("l_suppkey").alias("company_id"), F.col("kind").alias("field"), F.lit("x").alias("value"))
    return A.missing_fields(wanted, profile).withColumns({c: F.array_join(c, ",") for c in ("labels", "locations")})


@query("a28_status_counts", f"WITH {ITEMS_SQL} SELECT l_suppkey, count(*) FILTER (kind = 'A') AS \"A\", count(*) FILTER (kind = 'N') AS \"N\", count(*) FILTER (kind = 'R') AS \"R\" FROM i GROUP BY 1")
def status_counts(spark, sf_dir):
    return items(spark, sf_dir).groupBy("l_suppkey").pivot("kind", ["A", "N", "R"]).count().fillna(0)


@query("a29_merge_archive", f"""WITH {ITEMS_SQL}, d AS (SELECT l_suppkey % 3 AS company_id, CAST(l_suppkey AS VARCHAR) AS company_name, CASE kind WHEN 'A' THEN 'cipc' WHEN 'N' THEN 'csd' ELSE 'other' END AS k, CAST(pack_id AS VARCHAR) AS file, CASE WHEN pack_id % 2 = 0 THEN 'Pending' ELSE CAST(pack_id AS VARCHAR) END AS reg, pack_id * 100 + l_linenumber AS seen FROM i)
SELECT company_id, company_name, bool_or(k = 'cipc') AS cipc_uploaded, bool_or(k = 'csd') AS csd_uploaded, count(DISTINCT file) AS files, count(DISTINCT file) FILTER (k = 'cipc') AS cipc_count, count(DISTINCT file) FILTER (k = 'csd') AS csd_count, arg_max(reg, seen) FILTER (reg <> 'Pending') AS registration FROM d GROUP BY 1, 2""")
def merge_archive(spark, sf_dir):
    d = items(spark, sf_dir).select(
        (F.col("l_suppkey") % 3).alias("company_id"), F.col("l_suppkey").cast("string").alias("company_name"), F.when(F.col("kind") == "A", "cipc").when(F.col("kind") == "N", "csd").otherwise("other").alias("kind"), F.col("pack_id").cast("string").alias("file"),
        F.when(F.col("pack_id") % 2 == 0, "Pending").otherwise(F.col("pack_id").cast("string")).alias("registration"), (F.col("pack_id") * 100 + F.col("l_linenumber")).alias("at"),
    )
    return A.merge_archive(d)


GRID_SQL = """types(document_type, k) AS (VALUES ('tax_clearance', 0), ('csd_report', 1), ('bbbee_certificate', 2), ('cipc_registration', 3), ('cidb_certificate', 4)), docs AS (
SELECT o_custkey AS company_id, o_orderkey % 5 AS k, max(o_orderdate) AS e FROM orders GROUP BY 1, 2), grid AS (
SELECT c_custkey AS company_id, document_type, CAST(e AS DATE) AS expiry_date, CASE WHEN e IS NULL THEN 'missing' WHEN date_diff('day', DATE '1999-06-30', CAST(e AS DATE)) < 0 THEN 'expired' WHEN date_diff('day', DATE '1999-06-30', CAST(e AS DATE)) <= 30 THEN 'expiring_soon' ELSE 'valid' END AS status
FROM customer CROSS JOIN types LEFT JOIN docs ON docs.company_id = c_custkey AND docs.k = types.k)"""


def grid(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in A.REQUIRED_DOCUMENTS])
    docs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company_id"), F.element_at(names, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("document_type"), F.to_date("o_orderdate").alias("expiry_date"))
    companies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id"))
    return A.compliance_grid(companies, docs, F.lit("1999-06-30").cast("date"))


@query("j9_compliance_grid", f"WITH {GRID_SQL} SELECT * FROM grid")
def compliance_grid(spark, sf_dir):
    return grid(spark, sf_dir)


@query("a30_compliance_status", f"""WITH {GRID_SQL} SELECT company_id, CASE max(CASE WHEN status = 'expired' OR (status = 'missing' AND document_type IN ('tax_clearance', 'csd_report')) THEN 2 WHEN status = 'expiring_soon' THEN 1 ELSE 0 END) WHEN 2 THEN 'non_compliant' WHEN 1 THEN 'attention_needed' ELSE 'compliant' END AS status,
round(100.0 * avg(CAST(status = 'valid' AS INTEGER)), 2) AS valid_pct FROM grid GROUP BY 1""")
def compliance_status(spark, sf_dir):
    return A.compliance_status(grid(spark, sf_dir))


@query("a31_quote_totals", """WITH l AS (SELECT l_orderkey, l_quantity AS q, CASE WHEN l_discount < 0.095 THEN l_extendedprice END AS p FROM lineitem), s AS (SELECT l_orderkey, coalesce(sum(q * p), 0) AS t, count(*) FILTER (p IS NULL) AS unpriced FROM l GROUP BY 1)
SELECT l_orderkey, round(t, 2) AS subtotal, unpriced, round(CASE WHEN unpriced = 0 THEN t * 0.15 END, 4) AS vat, round(CASE WHEN unpriced = 0 THEN t * 1.15 END, 4) AS total FROM s""")
def quote_totals(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("quantity"), F.when(F.col("l_discount") < 0.095, F.col("l_extendedprice")).alias("price"))
    return A.quote_totals(lines, "l_orderkey").withColumns({"subtotal": F.round("subtotal", 2), "vat": F.round("vat", 4), "total": F.round("total", 4)})


@query("a32_quote_flags", "SELECT event_id AS quote_id, CAST(CASE WHEN event_id % 7 = 0 THEN -1 ELSE 1 END AS INTEGER) AS position FROM events WHERE event_id % 7 = 0 OR value < 100")
def quote_flags(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    second = F.when(F.col("value") < 100, F.lit('{"description": "b"}')).otherwise(F.concat(F.lit('{"description": "b", "price": '), F.col("value").cast("string"), F.lit("}")))
    text = F.when(F.col("event_id") % 7 == 0, F.lit("[not json")).otherwise(F.concat(F.lit('[{"description": "a", "price": 1.5}, '), second, F.lit("]")))
    return A.quote_flags(events.select(F.col("event_id").alias("quote_id"), text.alias("line_items")))


@query("a33_profile_completeness", """SELECT c_custkey AS company_id, CAST(4 - (c_acctbal < 0)::INT - (c_mktsegment = 'BUILDING')::INT AS INTEGER) AS filled, NOT (c_acctbal < 0) AS ready FROM customer""")
def profile_completeness(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("country"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"), F.when(F.col("c_mktsegment") == "BUILDING", "  ").otherwise(F.col("c_mktsegment")).alias("segment"))
    return A.profile_completeness(c, ["name", "country", "balance", "segment"], ["name", "balance"]).select("company_id", F.col("filled").cast("int").alias("filled"), "ready")


@query("a34_distinct_countries", f"WITH {RAW_SQL} SELECT DISTINCT buyer_country FROM raw WHERE buyer_country IS NOT NULL")
def distinct_countries(spark, sf_dir):
    return raw_contracts(spark, sf_dir).select("buyer_country").dropna().distinct().orderBy("buyer_country")


# --- windows -------------------------------------------------------------------------------------------------------------


@query("w4_rank_batch", """SELECT l_suppkey AS batch_id, l_orderkey, l_linenumber, l_shipdate, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY CAST(l_tax >= 0.07 AS INTEGER), CASE WHEN l_discount < 0.01 THEN 0 ELSE l_quantity / 50 END DESC, l_orderkey, l_linenumber, l_shipdate) AS INTEGER) AS position FROM lineitem""")
def rank_batch(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("batch_id"), "l_orderkey", "l_linenumber", "l_shipdate", (F.col("l_tax") >= 0.07).alias("disqualified"), F.when(F.col("l_discount") >= 0.01, F.col("l_quantity") / 50).alias("probability"), F.struct("l_orderkey", "l_linenumber", "l_shipdate").alias("key")
    )
    return A.rank_batch(line, "key").select("batch_id", "l_orderkey", "l_linenumber", "l_shipdate", "position")


@query("w5_latest_per_key", "SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def latest_per_key(spark, sf_dir):
    return P.latest_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("w6_next_seq", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq FROM events")
def next_seq(spark, sf_dir):
    return A.next_seq(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", F.col("seq").cast("int").alias("seq"))


@query("w7_market_permutation")
def market_permutation(spark, sf_dir):
    columns = ["pair_id", "bidder_masterid", "bidder_name", "buyer_country", "publish_year"]
    pairs = materialize(pairs_of(spark, sf_dir, cpvs=False).select(*columns), "pairs")
    forget_shuffles(spark)
    return A.market_permutation(pairs, columns[3:], "pair_id", columns[1:3]).select("pair_id", "bidder_masterid", "new_bidder_masterid", "new_bidder_name")


@query("w8_rolling_count", "SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM events")
def rolling_count(spark, sf_dir):
    return A.rolling_count(table(spark, sf_dir, "events"), "user_id", "ts", 3600).select("event_id", "user_id", "recent")


@query("w11_section_carry", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS heading FROM conversations")
def section_carry(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("opens"))
    return running_over(turns, ["conv_id"], ["turn"], {"heading": ("last", "opens")}).drop("opens")


@query("m1_synthetic_negatives")
def synthetic_negatives(spark, sf_dir):
    return A.narrow_negatives(pairs_of(spark, sf_dir, cpvs=False), ["buyer_country", "publish_year"])


# --- joins and sets ------------------------------------------------------------------------------------------------------


def release(spark, sf_dir):
    orders, line, supplier = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    main = orders.select(F.col("o_orderkey").alias("ocid"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey")).alias("buyer_id"), F.col("o_custkey").cast("string").alias("buyer_name"), F.lit(None).cast("string").alias("buyer_country"), F.col("o_orderdate").alias("date"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("end_date"), F.lit(None).cast("string").alias("tender_value_currency"))
    awards = line.groupBy("l_orderkey", "l_suppkey").agg(F.max("l_extendedprice").cast("string").alias("value_amount"), F.max("l_returnflag").alias("description")).select(F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")).alias("id"), F.col("l_orderkey").alias("main_ocid"), "value_amount", "description", "l_suppkey")
    suppliers = awards.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_suppkey").alias("id"), "main_ocid", F.col("id").alias("awards_id"), F.col("s_name").alias("name"))
    return main, awards.drop("l_suppkey"), suppliers


OCDS_SQL = """SELECT CAST(o_orderkey AS VARCHAR) AS tender_id, o_orderkey || '/' || l_suppkey AS lot_id, CAST(l_suppkey AS VARCHAR) AS bidder_masterid, any_value(s_name) AS bidder_name, CASE WHEN any_value(o_custkey) % 5 > 0 THEN CAST(any_value(o_custkey) AS VARCHAR) ELSE md5(CAST(any_value(o_custkey) AS VARCHAR)) END AS buyer_masterid,
'ZA' AS buyer_country, true AS bid_iswinning, max(l_extendedprice) AS bid_price, 'ZAR' AS currency, CAST(1 AS INTEGER) AS lot_description_length, CAST(30 AS INTEGER) AS submission_period, CAST(year(any_value(o_orderdate)) AS INTEGER) AS publish_year
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY o_orderkey, l_suppkey"""


@query("f2_ocds_to_bids", OCDS_SQL)
def ocds_to_bids(spark, sf_dir):
    return P.ocds_to_bids(*release(spark, sf_dir), {"country": "ZA", "currency": "ZAR"})


@query("j1_join_release", f"SELECT tender_id, lot_id, bidder_masterid FROM ({OCDS_SQL})")
def join_release(spark, sf_dir):
    return P.ocds_to_bids(*release(spark, sf_dir), {"country": "ZA", "currency": "ZAR"}).select("tender_id", "lot_id", "bidder_masterid")


@query("j6_matched_count", "SELECT count(*) AS matched FROM documents SEMI JOIN labels ON documents.doc_id = labels.doc_id")
def matched_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").agg(F.count("*").alias("matched"))


@query("j7_update_from", "SELECT c_custkey, n, round(s, 2) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def update_from(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    customer = table(spark, sf_dir, "customer").select("c_custkey")
    return customer.join(per, customer["c_custkey"] == per["o_custkey"], "left").select("c_custkey", "n", "total")


@query("j11_name_in_text", """WITH n AS (SELECT item_id, regexp_extract(lower(text), '^[^ \\n]+([ \\n]+[^ \\n]+){3}') AS name FROM benchmark)
SELECT doc_id, min(item_id) AS item_id, min_by(name, item_id) AS name FROM documents JOIN n ON name <> '' AND contains(lower(text), name) GROUP BY 1""")
def name_in_text(spark, sf_dir):
    """The first four words of each benchmark item as names, looked for in every document; the least item is kept."""
    names = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract(F.lower("text"), r"^[^ \n]+([ \n]+[^ \n]+){3}", 0).alias("name"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))
    return contained(names, docs).join(names, "name").groupBy(F.col("id").alias("doc_id")).agg(F.min("item_id").alias("item_id"), F.min_by("name", "item_id").alias("name"))


@query("j12_new_only", "SELECT doc_id, source FROM documents ANTI JOIN labels ON documents.doc_id = labels.doc_id")
def new_only(spark, sf_dir):
    return P.new_only(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("j13_packs_with_counts", "SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders")
def packs_with_counts(spark, sf_dir):
    orders, per = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return orders.join(per, orders["o_orderkey"] == per["l_orderkey"], "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("j14_unowned", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL")
def unowned(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").where(F.col("toxic").isNull()).select("doc_id")


@query("j15_reviews_ready", f"WITH {ITEMS_SQL} SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND NOT EXISTS (SELECT 1 FROM i WHERE pack_id = o_orderkey AND NOT done AND NOT advisory)")
def reviews_ready(spark, sf_dir):
    open_ = items(spark, sf_dir).where("NOT done AND NOT advisory").select(F.col("pack_id").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").join(open_, "o_orderkey", "left_anti").select("o_orderkey")


@query("j16_cascade_remove", "SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3)")
def cascade_remove(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "k")
    line = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k")
    _, children = P.cascade_remove(orders, line, orders.where("o_custkey % 10 = 3"), "k")
    return children.select(F.col("k").alias("l_orderkey"), "l_linenumber", "l_suppkey", "l_shipdate")


@query("j16_null_placeholders", "SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS o_orderpriority, nullif(o_orderstatus, 'F') AS o_orderstatus FROM orders")
def null_placeholders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return P.null_placeholders(orders, {"o_orderpriority": "5-LOW", "o_orderstatus": "F", "absent": "x"})


@query("u1_union_sources", "SELECT o_orderkey AS k, 'o' AS s FROM orders UNION ALL SELECT l_orderkey, 'l' FROM lineitem")
def union_sources(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit("o").alias("s")).unionByName(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.lit("l").alias("s")))


@query("u2_union_by_name", "SELECT doc_id, lang, NULL::INTEGER AS toxic FROM documents UNION ALL BY NAME SELECT doc_id, toxic FROM labels")
def union_by_name(spark, sf_dir):
    return P.union_by_name(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


@query("u3_concat_negatives")
def concat_negatives(spark, sf_dir):
    market = ["buyer_country", "publish_year"]
    pairs = A.shared_pairs(pairs_of(spark, sf_dir, cpvs=False).select("pair_id", "lot_id", "bidder_masterid", "bidder_name", "did_win", "pair_type", *market))
    made = A.narrow_negatives(pairs, market)
    return pairs.select(*made.columns).unionByName(made).groupBy("pair_type").agg(F.count("*").alias("n"))


@query("u4_set_equal", "SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id + 1 FROM labels) UNION ALL SELECT doc_id + 1, 'unknown' FROM labels WHERE doc_id + 1 NOT IN (SELECT doc_id FROM documents)")
def set_equal(spark, sf_dir):
    return P.set_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select((F.col("doc_id") + 1).alias("doc_id")), "doc_id")


@query("u6_common_keys", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def common_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


# --- ordered lists -------------------------------------------------------------------------------------------------------


@query("t1_search_pipeline", f"WITH {OUT_SQL} SELECT l_orderkey, s_name, p FROM o JOIN supplier ON s_suppkey = l_suppkey WHERE r = 'PURSUE' AND (contains(lower(s_name), '#000000003') OR contains(CAST(l_orderkey AS VARCHAR), '77'))")
def search_pipeline(spark, sf_dir):
    o, s = outcomes(spark, sf_dir), table(spark, sf_dir, "supplier")
    hit = F.lower("s_name").contains("#000000003") | F.col("l_orderkey").cast("string").contains("77")
    found = o.where("recommendation = 'PURSUE'").join(s, o["l_suppkey"] == s["s_suppkey"]).where(hit)
    return found.select("l_orderkey", "s_name", F.col("predicted_probability").alias("p")).orderBy(F.desc("p"))


@query("t2_search_history", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') ORDER BY conv_id DESC, turn DESC LIMIT 5")
def search_history(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(F.lower("text").contains("the")).orderBy(F.desc("conv_id"), F.desc("turn")).limit(5).select("conv_id", "turn")


@query("t3_risk_order", f"WITH {GRID_SQL} SELECT company_id, document_type, CAST(CASE status WHEN 'expired' THEN 0 WHEN 'missing' THEN 1 ELSE 2 END AS INTEGER) AS risk FROM grid WHERE status <> 'valid'")
def risk_order(spark, sf_dir):
    risk = F.when(F.col("status") == "expired", 0).when(F.col("status") == "missing", 1).otherwise(2)
    return grid(spark, sf_dir).where("status <> 'valid'").select("company_id", "document_type", risk.alias("risk")).orderBy("risk", "company_id", "document_type")


@query("t5_primary_document", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 0 WHEN l_returnflag = 'A' THEN 1 ELSE 2 END, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def primary_document(spark, sf_dir):
    rank = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return P.latest_per_key(table(spark, sf_dir, "lineitem"), ["l_orderkey"], rank, F.col("l_linenumber")).select("l_orderkey", "l_linenumber")


@query("t6_calendar", "SELECT CAST(o_orderdate AS DATE) AS day, 'briefing' AS kind, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT CAST(l_shipdate AS DATE), 'closing', count(*) FROM lineitem GROUP BY 1")
def calendar(spark, sf_dir):
    events = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.lit("briefing").alias("kind")).unionByName(table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("day"), F.lit("closing").alias("kind")))
    return events.groupBy("day", "kind").agg(F.count("*").alias("n"))


@query("t6_upcoming", "SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1997-01-01' ORDER BY 1, 2 LIMIT 20")
def upcoming(spark, sf_dir):
    events = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), "o_orderkey")
    return P.upcoming(events, "day", F.lit("1997-01-01").cast("date"), 20, "o_orderkey")


@query("t7_due_for_renewal", "SELECT event_id, ts <= TIMESTAMP '2024-01-10 00:00:00' AS expired FROM events WHERE event_type = 'view' AND ts <= TIMESTAMP '2024-01-12 00:00:00'")
def due_for_renewal(spark, sf_dir):
    ts, now = F.col("ts").cast("timestamp_ntz"), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    due = table(spark, sf_dir, "events").where("event_type = 'view'").where(ts <= now + F.expr("INTERVAL 2 DAYS"))
    return due.orderBy("ts").select("event_id", (ts <= now).alias("expired"))


@query("x12_quota_cut", """WITH f AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_shipdate, l_tax, l_linestatus = 'F' AS consumes, 7 AS remaining FROM lineitem), u AS (SELECT *, coalesce(sum(consumes::INT) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_shipdate, l_tax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM f),
n AS (SELECT *, sum((used >= remaining)::INT) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_shipdate, l_tax ROWS UNBOUNDED PRECEDING) AS nth FROM u)
SELECT l_suppkey, l_orderkey, l_linenumber, CASE WHEN used < remaining THEN 'run' WHEN nth = 1 THEN 'refused' ELSE 'not_processed' END AS decision FROM n""")
def quota_cut(spark, sf_dir):
    files = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_tax", (F.col("l_linestatus") == "F").alias("consumes"))
    quotas = files.select("l_suppkey").distinct().withColumn("remaining", F.lit(7))
    return A.quota_cut(files, quotas, "l_suppkey", ["l_orderkey", "l_linenumber", "l_shipdate", "l_tax"]).select("l_suppkey", "l_orderkey", "l_linenumber", "decision")


@query("x4_advance_high_water", "SELECT user_id, event_id FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM events) WHERE high IS NULL OR value > high")
def advance_high_water(spark, sf_dir):
    return A.accepted_messages(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", "event_id")


@query("s10_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def upsert(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    changes = orders.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return P.upsert(orders, changes, ["o_orderkey"], "o_orderdate").select("o_orderkey", "o_totalprice")
