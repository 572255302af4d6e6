"""What reading a text and pairing classes cost, and that the cheaper ways find the same."""

from pyspark.sql import functions as F

from bidlake.functions import documents as D
from bidlake.operators import document_scores as S
from bidlake.operators import eligibility as E

FIRM = "firm string, company_name string, pit_total_wins int, municipality string, province string, has_csd boolean, has_cidb boolean, has_tax_clearance boolean"
TEXTS = ["CSD Report", "cor14.3 of ABSA", "cor1433", "maaa1234567", "maaa12", "an EME", "", None, "reference letter; b-bbee", "Kelvin cK1", "RANDS £"]


def test_plain_words_are_found_as_by_the_pattern(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string").withColumn("low", F.lower("text"))
    for _, pattern, _ in (*D.DOCUMENT_RULES, ("", D.UK_TEXT, ""), ("", D.ZA_TEXT, "")):
        for text in (F.col("low"), F.col("text")):
            assert docs.where(~D._holds(text, pattern).eqNullSafe(text.rlike(pattern))).isEmpty(), pattern


def test_scoring_reads_only_the_fields_it_uses(spark):
    docs = spark.createDataFrame([(1, "x")], "id long, text string")
    plan = S.extracted(docs, F.lit("1998-01-01").cast("date"))._jdf.queryExecution().optimizedPlan().toString()
    assert "MAAA" in plan and "Segment" not in plan and "award date" not in plan


def test_days_of_all_forms(spark):
    days = {"5 May 2028": "2028-05-05", "05  February 2027": "2027-02-05", "2027-02-16": "2027-02-16", "3/4/2029": "2029-04-03", "31/2/2029": None, "5-May-2028": None, "5 Mai 2028": None, "": None}
    rows = spark.createDataFrame([(d,) for d in days], "d string").select("d", D.parse_day(F.col("d")).cast("string").alias("p")).collect()
    assert {r["d"]: r["p"] for r in rows} == days


def test_a_pair_costs_no_work_on_its_verdict(spark):
    docs = spark.createDataFrame([(k, "Bidders must be registered on the CSD.") for k in range(40)], "id long, text string")
    firms = spark.createDataFrame([(f"f{k}", f"F{k}", 0, "Town", "Gauteng", k % 2 == 0, True, True) for k in range(6)], FIRM)
    pairs = E.eligibility(docs, firms).pairs()
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" not in plan and pairs.count() == 240 and pairs.where("not eligible").count() == 120
    assert pairs.where("eligible").rdd.getNumPartitions() > 1
