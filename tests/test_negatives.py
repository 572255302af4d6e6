from collections import Counter

from bidlake.operators import prepare as P
from bidlake.operators import reports as A
from bidlake.plans.history_queries import pairs_of

SF = "/root/testdata/sf0.001"


def test_permutation_keeps_bidders_of_a_market(spark):
    rows = A.market_permutation(pairs_of(spark, SF), ["buyer_country", "publish_year"], "pair_id", ["bidder_masterid", "bidder_name"]).collect()
    old = Counter((r["buyer_country"], r["publish_year"], r["bidder_masterid"], r["bidder_name"]) for r in rows)
    assert old == Counter((r["buyer_country"], r["publish_year"], r["new_bidder_masterid"], r["new_bidder_name"]) for r in rows)


def test_negatives_never_meet_true_pairs(spark):
    pairs = pairs_of(spark, SF)
    made = A.synthetic_negatives(pairs, ["buyer_country", "publish_year"]).collect()
    real = {(r["lot_id"], r["bidder_masterid"]) for r in pairs.select("lot_id", "bidder_masterid").collect()}
    keys = [(r["lot_id"], r["bidder_masterid"]) for r in made]
    assert made and len(keys) == len(set(keys)) and not real & set(keys) and {r["did_win"] for r in made} == {0}


def test_negatives_are_the_same_rows_in_every_run(spark):
    pairs, market = pairs_of(spark, SF), ["buyer_country", "publish_year"]
    one, two = ({tuple(r) for r in A.synthetic_negatives(p, market).collect()} for p in (pairs, pairs.repartition(7)))
    assert one == two
    both = Counter(r["pair_type"] for r in pairs.unionByName(A.synthetic_negatives(pairs, market)).select("pair_type").collect())
    assert both["synthetic_negative"] == len(one) and sum(both.values()) == pairs.count() + len(one)


def test_samples_are_nested_repeatable_and_near_their_share(spark):
    df = spark.range(20_000).withColumnRenamed("id", "pair_id")
    ids = lambda share, d=df: {r["pair_id"] for r in P.sample_pairs(d, share, "pair_id").collect()}
    quarter, half = ids(0.25), ids(0.5)
    assert quarter < half and quarter == ids(0.25, df.repartition(5)) and abs(len(quarter) - 5000) < 300 and abs(len(half) - 10_000) < 350
    assert ids(1.0) == set(range(20_000)) and ids(0.0) == set()


def test_time_split_with_null_year(spark):
    df = spark.createDataFrame([(y,) for y in [2000] * 50 + [2001] * 30 + [2002] * 20 + [2003] * 10 + [None] * 3], "publish_year int")
    got = {(r["publish_year"], r["split"]) for r in P.time_split(df).collect()}
    assert (None, None) in got and (2003, "test") in got and (2000, "train") in got


def test_negatives_are_dealt_out_as_keys_alone(spark):
    """The same pairs with and without their other columns, which come from the real pair whose place is taken."""
    pairs, market = pairs_of(spark, SF), ["buyer_country", "publish_year"]
    narrow, full = A.narrow_negatives(pairs, market), A.synthetic_negatives(pairs, market)
    assert {tuple(r) for r in narrow.collect()} == {tuple(r) for r in full.select(*narrow.columns).collect()}
    years = {r["lot_id"]: r["publish_year"] for r in pairs.collect()}
    assert all(r["publish_year"] == years[r["lot_id"]] for r in full.collect())
    assert not {"bid_price", "call_date"} & set(A.negative_keys(pairs, market).columns)
