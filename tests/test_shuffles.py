"""How often rows move: joins and groupings of the bids, with nothing broadcast."""

import random
import re

import pytest
from pyspark.sql import functions as F

from bidlake.operators import history as H
from bidlake.operators import prepare as P
from bidlake.operators import reports as A
from bidlake.plans.history_queries import pairs_of
from bidlake.plans.views import raw_contracts, without_part

SF = "/root/testdata/sf0.001"


@pytest.fixture
def unbroadcast(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield spark
    for n, v in old.items():
        spark.conf.set(n, v)


def moves(df, column):
    """Shuffles whose rows hold the column."""
    plan = df._jdf.queryExecution().executedPlan()
    nodes, found = [plan], 0
    while nodes:
        node = nodes.pop()
        found += node.nodeName() == "Exchange" and re.search(rf"\b{column}#", node.output().toString()) is not None
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    return found


def test_lines_move_by_order_once_and_by_part_where_types_are_asked_for(unbroadcast):
    assert moves(raw_contracts(unbroadcast, SF, cpvs=False).drop("bidder_name"), "l_linenumber") == 2  # to the orders, and to the names
    assert moves(raw_contracts(unbroadcast, SF), "l_linenumber") == 3


def test_contracts_without_types_are_the_same_rows(spark):
    full = raw_contracts(spark, SF).drop("tender_cpvs")
    narrow = raw_contracts(spark, SF, cpvs=False)
    assert full.columns == narrow.columns and full.exceptAll(narrow).isEmpty() and narrow.exceptAll(full).isEmpty()


def test_lines_of_unknown_and_null_parts_go(spark):
    part = spark.createDataFrame([(1,), (1,), (2,), (None,)], "p_partkey long")
    line = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d"), (1, "e")], "l_partkey long, n string")
    assert sorted(r["n"] for r in without_part(line, part).collect()) == ["a", "b", "e"]
    assert sorted(r["n"] for r in without_part(line.where("l_partkey < 3"), part).collect()) == ["a", "b", "e"]


def test_incumbents_are_those_of_the_features(spark):
    bids = raw_contracts(spark, SF)
    pairs = P.build_pairs(bids)
    own = {r["pair_id"]: r["pit_is_incumbent"] for r in H.incumbents(bids, pairs).collect()}
    assert own == {r["pair_id"]: r["pit_is_incumbent"] for r in H.supplier_features(bids, pairs).collect()} and set(own.values()) == {0, 1}


def test_incumbents_of_nulls_and_strangers(spark):
    bids = spark.createDataFrame([("a", "x", True, 2000), ("a", "x", True, 2002), ("b", "x", False, 1999), (None, "x", True, 1990), ("c", "x", True, None)], "bidder_name string, buyer_masterid string, bid_iswinning boolean, publish_year int")
    pairs = spark.createDataFrame([("a", "x", 2000), ("a", "x", 2001), ("a", None, 2001), (None, "x", 2001), ("b", "x", 2001), ("a", "x", None), ("c", "x", 2001)], "bidder_name string, buyer_masterid string, publish_year int")
    assert [r["pit_is_incumbent"] for r in H.incumbents(bids, pairs).orderBy(F.desc("pit_is_incumbent"), "publish_year").collect()] == [1, 0, 0, 0, 0, 0, 0]


def test_pairs_move_twice_for_their_features(unbroadcast):
    bids = unbroadcast.read.parquet(f"{SF}/lineitem.parquet").select(
        F.col("l_orderkey").cast("string").alias("lot_id"), F.col("l_suppkey").cast("string").alias("bidder_masterid"), F.col("l_suppkey").cast("string").alias("bidder_name"), F.col("l_partkey").cast("string").alias("buyer_masterid"),
        F.col("l_linestatus").alias("buyer_country"), F.year("l_shipdate").alias("publish_year"), (F.col("l_returnflag") == "R").alias("bid_iswinning"), F.col("l_extendedprice").alias("bid_price"), F.col("l_returnflag").alias("tender_cpvs"),
    )
    out = H.supplier_features(bids, P.build_pairs(bids).withColumnRenamed("pair_id", "pair").withColumn("pair_id", F.col("pair")))
    assert moves(out, "pair_id") == 2


def test_a_country_that_is_not_known_has_the_bidders_own_past(spark):
    columns = "tender_id string, lot_id string, bidder_masterid string, bidder_name string, buyer_masterid string, buyer_country string, bid_iswinning boolean, bid_price double, tender_cpvs string, publish_year int"
    bids = spark.createDataFrame([("t1", "l1", "1", "a", "x", "ZA", True, 10.0, "45", 2000), ("t2", "l2", "1", "a", "x", None, True, 5.0, "45", 2001)], columns)
    row = H.supplier_features(bids, bids.withColumn("pair_id", F.col("lot_id"))).where("pair_id = 'l2'").first()
    assert row["pit_total_wins"] == 1 and row["pit_win_rate_country"] == 0.0 and row["pit_buyer_win_count"] == 1 and row["pit_country_count"] == 1


def test_permuted_names_do_not_move(spark):
    pairs = pairs_of(spark, SF, cpvs=False)
    out = A.market_permutation(pairs, ["buyer_country", "publish_year"], "pair_id", ["bidder_masterid", "bidder_name"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert not moves(out.select("pair_id", "new_bidder_name"), "_of") and not moves(out.select("pair_id", "new_bidder_name"), "new_bidder_name")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_made_pairs_of_lots_with_one_pair_do_not_move_again(spark):
    """Only shared lots are grouped once more by lot."""
    rows = [(f"{lot}_{b}", lot, b, f"n{b}", int(k % 5 > 0), "winner", "ZA", 2000) for k, (lot, b) in enumerate((f"l{i}", str(i % 40)) for i in range(400))]
    pairs = spark.createDataFrame(rows, PAIRS)
    plan = A.narrow_negatives(pairs, ["buyer_country", "publish_year"])
    spark.sparkContext._jvm.System.gc()
    assert plan.count() > 0
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [lot_id" in text.split("Union")[1] and "Aggregate [lot_id" not in text.split("\n:  ")[0]


PAIRS = "pair_id string, lot_id string, bidder_masterid string, bidder_name string, did_win int, pair_type string, buyer_country string, publish_year int"


def test_negatives_are_those_of_the_written_out_permutations(spark):
    """Lots of one and several pairs, in several markets, without lot, ids without name and with several, null markets: against ranks in Python."""
    rng = random.Random(3)
    rows, seen = [], set()
    for k in range(900):
        lot = None if rng.random() < 0.03 else f"l{rng.randrange(400)}"
        b = None if rng.random() < 0.02 else str(rng.randrange(30))
        if (lot, b) not in seen:
            seen.add((lot, b))
            rows.append((f"{lot}_{b}", lot, b, None if b == "3" else f"n{b}-{rng.randrange(2)}" if b == "4" else f"n{b}", int(rng.random() < 0.8), "winner", rng.choice(["ZA", "GB", None]), rng.choice([2000, 2001])))
    for several in (True, False):
        pairs = spark.createDataFrame([r for r in rows if several or r[2] != "4"], PAIRS)
        times = max(1, min(10, int(sum(r["did_win"] for r in pairs.collect()) / 0.15 - pairs.count()) // pairs.count()))
        hashed = pairs.withColumns({"p": F.xxhash64(F.lit("negative-place"), "pair_id"), "q": F.array(*[F.xxhash64(F.lit("negative"), F.lit(k + 1), "pair_id") for k in range(times)])}).collect()
        markets = {}
        for r in hashed:
            markets.setdefault((r["buyer_country"], r["publish_year"]), []).append(r)
        real = {(r["lot_id"], r["bidder_masterid"]) for r in hashed if r["lot_id"] is not None and r["bidder_masterid"] is not None}
        order = lambda h: ((h >> 32) % 1024 if h >= 0 else ((h + (1 << 64)) >> 32) % 1024, h)
        made = {}
        for own in markets.values():
            places = sorted(own, key=lambda r: order(r["p"]))
            for k in range(times):
                for place, new in zip(places, sorted(own, key=lambda r: order(r["q"][k])), strict=True):
                    a, b = place["bidder_masterid"], new["bidder_masterid"]
                    if a is not None and b is not None and a != b and (place["lot_id"], b) not in real:
                        made.setdefault((place["lot_id"], b), []).append((place["p"], a, new["bidder_name"] or "", new["bidder_name"]))
        want = {(*key, min(found)[1], min(found)[3]) for key, found in made.items()}
        got = [(r["lot_id"], r["bidder_masterid"], r["source"], r["bidder_name"]) for r in A.negative_keys(pairs, ["buyer_country", "publish_year"]).collect()]
        assert len(got) == len(set(got)) and set(got) == want and times > 1
