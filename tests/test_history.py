from pyspark.sql import functions as F

from bidlake.operators import history as H

BIDS = "tender_id string, lot_id string, bidder_masterid string, bidder_name string, buyer_masterid string, buyer_country string, bid_iswinning boolean, bid_price double, tender_cpvs string, publish_year int"
ROWS = [
    ("t1", "l1", "1", "a", "x", "ZA", True, 10.0, "45", 2000),
    ("t2", "l2", "1", "a", "x", "ZA", False, 5.0, "45", 2001),
    ("t3", "l3", "1", "a", "y", "GB", True, None, "30", 2002),
    ("t4", "l4", "2", None, "x", "ZA", True, 7.0, "45", 2001),
]


def features(spark, rows):
    bids = spark.createDataFrame(rows, BIDS)
    pairs = bids.withColumn("pair_id", F.concat_ws("_", "lot_id", "bidder_masterid"))
    return {r["pair_id"]: r for r in H.supplier_features(bids, pairs).collect()}


def test_features_use_only_earlier_years(spark):
    out = features(spark, ROWS)
    first, third = out["l1_1"], out["l3_1"]
    assert first["pit_total_entries"] == 0 and first["pit_last_win_years_ago"] == 10.0 and first["pit_win_rate_overall"] == 0.0
    assert third["pit_total_entries"] == 2 and third["pit_total_wins"] == 1 and third["pit_last_win_years_ago"] == 2.0
    assert third["pit_is_incumbent"] == 0 and third["category_hhi"] == 1.0


def test_future_rows_change_nothing_earlier(spark):
    later = [("t9", "l9", "1", "a", "x", "ZA", True, 99.0, "45", 2005)]
    before, after = features(spark, ROWS), features(spark, ROWS + later)
    assert all(before[k] == after[k] for k in before)


def test_null_bidder_has_no_history(spark):
    assert features(spark, ROWS)["l4_2"]["pit_total_entries"] == 0


def test_asof_without_match_and_empty(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), (None, 5)], "k string, t int")
    stats = spark.createDataFrame([("a", 3, 7)], "k string, y int, v int")
    got = sorted(((r["k"], r["t"], r["v"]) for r in H.asof_left(left, stats, ["k"], "t", "y", ["v"]).collect()), key=str)
    assert got == sorted([("a", 5, 7), ("a", 1, None), (None, 5, None)], key=str)
    assert H.asof_left(left.limit(0), stats, ["k"], "t", "y", ["v"]).count() == 0


def test_asof_of_a_hot_key_carries_distinct_times_only(spark):
    left = spark.range(60_000).select(F.lit("a").alias("k"), (F.col("id") % 7).cast("int").alias("t"), "id")
    stats = spark.createDataFrame([("a", 2, 20), ("a", 4, 40)], "k string, y int, v int")
    got = H.asof_left(left, stats, ["k"], "t", "y", ["v"])
    assert {(r["t"], r["v"]): r["count"] for r in got.groupBy("t", "v").count().collect()} == {(t, None if t < 3 else 20 if t < 5 else 40): 60_000 // 7 + (t < 60_000 % 7) for t in range(7)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window"):]
    assert "Aggregate" in window and "id#" not in window.split("Union")[0]
