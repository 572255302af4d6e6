import pytest
from pyspark.sql import functions as F

from bidlake.functions import blanks as B
from bidlake.functions import documents as D
from bidlake.functions import scoring as R


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("price", "expected"), [(100.0, 80.0), (120.0, 64.0), (200.0, 0.0), (None, None)])
def test_price_score(spark, price, expected):
    got = one(spark, R.price_score(F.lit(price).cast("double"), F.lit(100.0), F.lit("80/20")))
    assert got == expected or got == pytest.approx(expected)


@pytest.mark.parametrize(("level", "system", "points"), [(1, "80/20", 20), (1, "90/10", 10), (0, "80/20", 0), (None, "80/20", 0), (1, "other", None)])
def test_points(spark, level, system, points):
    assert one(spark, R.bbbee_points(F.lit(level), F.lit(system))) == points


def test_probability_stays_in_bounds(spark):
    assert one(spark, R.adjust_probability(F.lit(0.0), F.lit(0.0), F.lit(3))) == 0.02
    assert one(spark, R.adjust_probability(F.lit(1.0), F.lit(100.0), F.lit(1))) == 0.95


PLAIN = "Road marking in the north. The estimated value: R 730,500.50. Closing date: 3 March 2027. Bids below R50,000,000.00 are scored 80/20."


def test_plain_notice(spark):
    money = one(spark, D.extract_money(F.lit(PLAIN)))
    assert money["amounts"] == [730_500.5]
    dates = one(spark, D.extract_dates(F.lit(PLAIN), F.lit("2027-02-21").cast("date")))
    assert str(dates["closing"]) == "2027-03-03" and dates["deadline_days"] == 10


@pytest.mark.parametrize("text", [None, "", " " * 50_000, "R 99999999999999999999", "\x00퟿"])
def test_parsers_never_fail(spark, text):
    c = F.lit(text).cast("string")
    one(spark, F.struct(D.extract_money(c), D.extract_dates(c, F.current_date()), D.extract_terms(c), D.extract_company(c), D.document_type(c)))


def test_supplier_block_fill(spark):
    want = {"Signed by": "signature", "Dated": None, "Dated at": "signing_date", "Rate per hour": "pricing", "Describe your methodology": "narrative", "Any conflict of interest": "declaration", "Trading name": None}
    df = spark.createDataFrame([(x,) for x in want], "label string")
    assert {r["label"]: r["b"] for r in df.select("label", B.block_reason(F.col("label"), F.lit("form")).alias("b")).collect()} == want


def test_small_labelled_amounts_are_read(spark):
    text = "Estimated value: R 1001.91. Bid price: R {}.\nR 50,000,000.00 is the limit."
    assert one(spark, D.extract_money(F.lit(text.format("500.00")), small=True))["bid"] == 500.0
    assert one(spark, D.extract_money(F.lit(text.format("500.00"))))["bid"] == 1001.91
    assert one(spark, D.extract_money(F.lit(text.format("12,500.00")), small=True))["bid"] == 12_500.0
    assert one(spark, D.extract_money(F.lit("Pricing 3.10 applies to R 2,000.00"), small=True))["bid"] == 2_000.0
