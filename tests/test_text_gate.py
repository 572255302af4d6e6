import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from bidlake.operators import text_gate as G

SF = "/root/testdata/sf0.1"


def test_held_out_auc_and_the_same_scores_on_a_stream(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    known = docs.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("doc_id", "text", F.col("quality").alias("label"), F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("part"))
    G.save(G.fit_gate(known.where("part > 0")), str(tmp_path / "model"))
    model = G.load(str(tmp_path / "model"))
    out = G.gate(known.where("part = 0"), model)
    assert out.columns == ["doc_id", "label", "part", "score", "verdict"]
    scored = out.where("verdict <> 'unreadable'").withColumn("label", F.col("label").cast("double"))
    auc = BinaryClassificationEvaluator(rawPredictionCol="score").evaluate(scored)
    assert auc > 0.75, auc
    known.where("part = 0").select("doc_id", "text").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    G.gate(stream, model).writeStream.format("memory").queryName("gate").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert {(r["doc_id"], r["verdict"]) for r in spark.table("gate").collect()} == {(r["doc_id"], r["verdict"]) for r in out.collect()}


def test_verdicts_and_refusals(spark):
    rows = spark.createDataFrame([(1, "a b " * 20, 1), (2, "c d " * 20, 0), (3, None, 1), (4, " short ", 0), (5, "a b " * 20, None)], "id int, text string, label int")
    model = G.fit_gate(rows, rounds=5, least_docs=1)
    got = {r["id"]: r for r in G.gate(rows.withColumn("_counts2", F.lit(1)), model, enough=0.5).collect()}
    assert got[1]["verdict"] == "tender" and got[2]["verdict"] == "not_tender" and got[3]["verdict"] == got[4]["verdict"] == "unreadable" and got[3]["score"] is None
    with pytest.raises(ValueError):
        G.fit_gate(rows.where("label = 1"))
    with pytest.raises(ValueError):
        G.fit_gate(rows.limit(0))
    edge = spark.createDataFrame([("x" * 39,), ("x" * 40,), (" " * 1500 + "x" * 100,)], "text string").select(G.head_gate(F.col("text"), F.lit(0.7))).collect()
    assert [r[0] for r in edge] == ["unreadable", "tender", "unreadable"]
