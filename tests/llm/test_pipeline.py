import hashlib

from pyspark.sql import functions as F

import corpus_pipeline as C
from bidlake.common import materialize
from bidlake.llm import neardup as N
from bidlake.llm.bpe import bpe_decode, bpe_encode
from bidlake.llm.secrets import secret_spans
from tests.llm.test_neardup import components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(C.STAGES):
        before = docs
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        seen.append((before, docs))
        assert k == len(C.STAGES) - 1 or docs.columns == columns
    clean, one, masked, mixed, ids = (after for _, after in seen)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rejected = seen[0][0].join(clean, "doc_id", "left_anti")
    assert rejected.join(labels, "doc_id").where("toxic = 0").count() == 0
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    want = {i for i, (_, c) in components(rows, 5, 80).items() if i == c}
    assert {r["doc_id"] for r in one.collect()} == want
    secret = secret_spans(one).where(F.size("secret_spans") > 0).count()
    assert masked.count() == one.count() and masked.where("text LIKE '%[SECRET]%'").count() == secret
    assert masked.where(F.length("text") != F.col("n_chars")).count() == one.where(F.length("text") != F.col("n_chars")).count()
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    out = ids.collect()
    assert len(out) == mixed.count() and all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in out)
    assert N.NearDup() == N.NearDup(5, 80)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-empty")
    assert docs.count() == 0


def test_nulls_in_every_column_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    odd = [(None, None, None, None, None), (7001, None, None, "s", 0), (7002, "", "en", None, 0), (None, "some words", "en", "s", 10), (7003, "a few other words", None, "s", None), (7003, "a few other words", None, "s", None)]
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")).select(*docs.columns)
    for name, stage in C.STAGES:
        before = rows
        rows = materialize(stage(spark, rows, SF), "test-nulls")
        if name == "toxicity":
            assert rows.where("doc_id IS NULL").count() == 2 and rows.where("doc_id = 7003").count() == 2
        if name == "near_duplicates":
            assert rows.where("doc_id IS NULL").count() == 2 and rows.where("doc_id = 7003").count() == 1 and rows.where("doc_id = 7001").count() == 1
        if name == "secrets":
            assert rows.count() == before.count() and rows.where("text IS NULL").count() == before.where("text IS NULL").count()
    assert rows.count() == before.count()
    repeats = spark.createDataFrame([(1, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert N.keep_one_of_each(repeats).count() == 1


def test_token_ids_take_one_python_step(spark):
    docs = spark.createDataFrame([(1, "a bé c", "s"), (2, None, None), (None, "", "t")], "doc_id long, text string, source string")
    out = C.encode(spark, docs, SF)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    apart = bpe_decode(bpe_encode(docs, offsets=False, keep=["doc_id", "source"])).collect()
    want = {(r["doc_id"], r["source"], tuple(r["ids"]), hashlib.sha256(r["decoded"]).hexdigest()) for r in apart}
    assert {(r["doc_id"], r["source"], tuple(r["ids"]), r["decoded_sha256"]) for r in out.collect()} == want
