"""Queries over models, and the scored pipeline of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidlake.common import materialize, scratch, table
from bidlake.functions import blanks as B
from bidlake.functions import documents as D
from bidlake.functions import scoring as R
from bidlake.operators import document_scores as S
from bidlake.operators import learning as M
from bidlake.operators import prepare as P
from bidlake.operators import profile as Q
from bidlake.operators.evaluation import time_blocks, year_folds
from bidlake.operators.ranks import quantiles
from bidlake.plans.document_queries import notices
from bidlake.plans.history_queries import PAIRS_SQL, pairs_of
from bidlake.plans.registry import query
from bidlake.plans.views import RAW_SQL, raw_contracts
from bidlake.streaming.jobs import append_stream

FEATURES = ["bid_price", "estimate", "publish_month", "deadline_days"]


def model_rows(spark, sf_dir):
    rows = P.temporal_features(pairs_of(spark, sf_dir)).select("pair_id", "publish_year", "did_win", *FEATURES)
    return P.time_split(materialize(rows, "model-rows"))  # read by the split and by every fit


def trained(spark, sf_dir):
    rows = model_rows(spark, sf_dir)
    train = rows.where("split = 'train'")
    fold, held = "publish_year", sorted(r["val_year"] for r in year_folds(train).collect())
    if not held:
        months = train.withColumn("months", F.col("publish_year") * 12 + F.col("publish_month"))
        train, fold = time_blocks(months, "months"), "block"
        held = sorted(r["val_year"] for r in year_folds(train, "block").collect())
    if not held:
        raise ValueError("no fold has both classes on both sides")
    stack = M.train_stack(train, FEATURES, "did_win", fold, held)
    return M.calibrate(stack, rows.where("split = 'val'"), "did_win"), rows


@query("m10_train_stack")
def train_stack(spark, sf_dir):
    stack, rows = trained(spark, sf_dir)
    return M.raw_scores(stack, rows.where("split = 'test'")).select("pair_id", "did_win", "raw")


@query("m12_calibrate")
def calibrate(spark, sf_dir):
    stack, rows = trained(spark, sf_dir)
    return M.score_batch(stack, rows.where("split = 'test'"), 0.5).select("pair_id", "raw", "probability")


@query("m19_score_batch")
def score_batch(spark, sf_dir):
    stack, rows = trained(spark, sf_dir)
    return M.score_batch(stack, rows.where("split = 'test'"), 0.6).select("pair_id", "probability", "recommendation", "confidence")


@query("t4_top_factors")
def top_factors(spark, sf_dir):
    stack, rows = trained(spark, sf_dir)
    medians = {f: 0.0 for f in FEATURES} | rows.where("split = 'train'").agg(*[F.median(f).alias(f) for f in FEATURES]).first().asDict()
    return M.top_factors(stack, rows.where("split = 'test'"), medians, "pair_id", 3)


@query("m11_search_params")
def search_params(spark, sf_dir):
    rows = model_rows(spark, sf_dir)
    return M.search_params(rows.where("split = 'train'"), rows.where("split = 'val'"), FEATURES, "did_win", "pair_id")


LOOKUP_SQL = f"""WITH {RAW_SQL}, q AS (SELECT CAST(o_orderkey AS VARCHAR) AS tender_id, 'Supplier#00000000' || CAST(o_orderkey % 12 AS VARCHAR) AS supplier_name, CAST(o_custkey % 12 AS VARCHAR) AS supplier_id FROM orders),
n AS (SELECT tender_id, bidder_name, max_by(bid_price, (bidder_masterid, bid_price)) AS p FROM raw GROUP BY 1, 2), i AS (SELECT tender_id, bidder_masterid, max(bid_price) AS p FROM (SELECT *, row_number() OVER (PARTITION BY tender_id, bidder_masterid ORDER BY bidder_name DESC, bid_price DESC) AS k FROM raw) WHERE k = 1 GROUP BY 1, 2),
t AS (SELECT tender_id, min_by(bid_price, (bidder_name, bidder_masterid, bid_price)) AS p FROM raw GROUP BY 1), s AS (SELECT bidder_name, max_by(bid_price, (publish_year, tender_id, bidder_masterid, bid_price)) AS p FROM raw GROUP BY 1)
SELECT q.tender_id, supplier_name, supplier_id, CAST(CASE WHEN n.tender_id IS NOT NULL THEN 1 WHEN i.tender_id IS NOT NULL THEN 2 WHEN t.tender_id IS NOT NULL THEN 3 WHEN s.bidder_name IS NOT NULL THEN 4 ELSE 5 END AS INTEGER) AS matched_by,
round(CASE WHEN n.tender_id IS NOT NULL THEN n.p WHEN i.tender_id IS NOT NULL THEN i.p WHEN t.tender_id IS NOT NULL THEN t.p WHEN s.bidder_name IS NOT NULL THEN s.p ELSE 0 END, 2) AS bid_price
FROM q LEFT JOIN n ON n.tender_id = q.tender_id AND n.bidder_name = supplier_name LEFT JOIN i ON i.tender_id = q.tender_id AND i.bidder_masterid = supplier_id LEFT JOIN t ON t.tender_id = q.tender_id LEFT JOIN s ON s.bidder_name = supplier_name"""


@query("j8_tender_supplier_lookup", LOOKUP_SQL)
def tender_supplier_lookup(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("tender_id"), F.concat(F.lit("Supplier#00000000"), (F.col("o_orderkey") % 12).cast("string")).alias("supplier_name"), (F.col("o_custkey") % 12).cast("string").alias("supplier_id"))
    return M.tender_supplier_lookup(asked, raw_contracts(spark, sf_dir), {"bid_price": 0.0}).select("tender_id", "supplier_name", "supplier_id", "matched_by", F.round("bid_price", 2).alias("bid_price"))


@query("f1_select_bid_columns", f"WITH {RAW_SQL} SELECT tender_id, lot_id, bid_iswinning, 'ZA' AS source_country FROM raw WHERE bid_iswinning IS NOT NULL")
def select_bid_columns(spark, sf_dir):
    return P.select_bid_columns(raw_contracts(spark, sf_dir), ["tender_id", "lot_id", "bid_iswinning"], "ZA")


@query("f3_require_columns", "SELECT o_orderkey FROM orders")
def require_columns(spark, sf_dir):
    return P.require_columns(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey"]).select("o_orderkey")


@query("f4_optional_columns", "SELECT o_orderkey, CAST(NULL AS DOUBLE) AS cri FROM orders")
def optional_columns(spark, sf_dir):
    return P.optional_columns(table(spark, sf_dir, "orders").select("o_orderkey"), {"cri": "double", "o_orderkey": "long"})


@query("f12_feature_columns")
def feature_columns(spark, sf_dir):
    names = P.feature_columns(pairs_of(spark, sf_dir), ["pair_id", "did_win", "lot_id", "tender_id"])
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query("p4_sample_rows")
def sample_rows(spark, sf_dir):
    return Q.sample_rows(table(spark, sf_dir, "documents"), 5)


@query("p10_columns_like")
def columns_like(spark, sf_dir):
    groups = Q.columns_like(table(spark, sf_dir, "lineitem"), {"date": ["date"], "value": ["price", "tax"], "bid": ["line"]})
    return spark.createDataFrame([(g, c) for g, cs in groups.items() for c in cs], "kind string, column string")


@query("t8_chronological", f"WITH {PAIRS_SQL} SELECT pair_id, publish_year, CAST(month(call_date) AS INTEGER) AS publish_month FROM pairs")
def chronological(spark, sf_dir):
    return P.temporal_features(pairs_of(spark, sf_dir)).select("pair_id", "publish_year", "publish_month").orderBy("publish_year", "publish_month", "pair_id")


@query("d15_document_context", "SELECT doc_id, CASE WHEN doc_id % 5 < 3 OR regexp_matches(coalesce(text, ''), '(?i)declaration of interest|employed by the state|\\b[sm]bd\\s*4\\b') THEN 'declaration' ELSE 'form' END AS context FROM documents")
def document_context(spark, sf_dir):
    """Every document, three of five with a mark of a declaration form, one with the number of another form."""
    mark = F.get(F.array(*map(F.lit, (" SBD 4", " Declaration of  Interest", " the bidder\u2019s disclosure", " SBD 6.1", ""))), (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", B.document_context(F.concat(F.coalesce("text", F.lit("")), mark)).alias("context"))


@query("x10_score_stream", "SELECT o_orderkey, CASE WHEN o_totalprice > 50000000 THEN '90/10' ELSE '80/20' END AS system, CASE WHEN o_totalprice / 500000 >= 0.5 THEN 'PURSUE' ELSE 'PASS' END AS recommendation FROM orders")
def score_stream(spark, sf_dir):
    """The document-scoring plan in its batch form: extract, infer the system, score, recommend."""
    docs = notices(spark, sf_dir).withColumn("m", D.extract_money(F.col("text")))
    scored = docs.select("o_orderkey", R.evaluation_system(F.col("m.value")).alias("system"), (F.col("m.value") / 500000).alias("p"))
    return scored.select("o_orderkey", "system", R.recommend(F.col("p"), 0.5)["recommendation"].alias("recommendation"))


def documents_to_score(spark, sf_dir):
    """The notices; of each seventh customer unreadable or empty ones."""
    k = F.col("o_custkey") % 7
    return notices(spark, sf_dir).select("o_orderkey", F.when(k == 1, "  ").when(k > 0, F.col("text")).alias("text"))


def scoring_plan(spark, sf_dir):
    """How a frame of documents is scored: the trained stack, a firm without past wins, an offer above the lowest."""
    stack, rows = trained(spark, sf_dir)
    medians = {r["column"]: r["q"][0] for r in quantiles(rows.where("split = 'train'").unpivot(["pair_id"], [F.col(f).cast("double").alias(f) for f in FEATURES], "column", "value"), [0.5]).collect()}
    firm = spark.createDataFrame([("Own firm", 0, "Limpopo", "Mookgophong", True, True, False)], S.PROFILE)
    offer = S.Offer(level=2, price=120_000.0, lowest=100_000.0, competitors=4)
    return lambda docs: S.score_documents(docs, firm, offer, stack, medians, 0.5, F.lit("1998-01-01").cast("date"))


def dealt(docs):
    """Documents in some parts for each core: texts are small in files and long to read, so that splits of files would leave most cores idle."""
    return docs.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, "o_orderkey")


@query("x10_scored_documents")
def scored_documents(spark, sf_dir):
    """Documents scored as a stream of files."""
    path, plan = scratch(spark, "scored"), scoring_plan(spark, sf_dir)
    documents_to_score(spark, sf_dir).write.parquet(f"{path}/in")
    stream = spark.readStream.schema("o_orderkey long, text string").parquet(f"{path}/in")
    append_stream(plan(dealt(stream)), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return S.ranked(spark.read.parquet(f"{path}/out"), "o_orderkey").select("o_orderkey", "type", "region", "completeness", "eligible", "system", "win_probability", "adjusted", "recommendation", "error")
