import re
from fractions import Fraction

from pyspark.sql import functions as F

from bidlake.llm import mixing as M


def test_quotas_respect_caps():
    out = M.quotas({"a": 10, "b": 100, "c": 100}, {"a": 5, "b": 2, "c": 1}, 210)
    assert out["a"] == 30 and out["b"] == 120 and out["c"] == 60


def test_flow_through_shared_patterns():
    patterns = {("a",): 10, ("a", "b"): 20, ("b",): 5}
    quota = {"a": Fraction(18), "b": Fraction(17)}
    flow = M.route(patterns, quota)
    sent = {s: sum(flow[p].get(s, 0) for p in patterns) for s in quota}
    assert sent == quota and all(sum(flow[p].values()) <= patterns[p] for p in patterns)  # 35 words for 35: no repetition


def test_repetition_is_spread_before_deepened():
    flow = M.route({("a", "x"): 10, ("a",): 10}, {"a": Fraction(40), "x": Fraction(0)})
    assert all(sum(f.values()) == 20 for f in flow.values())


def test_report(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text")
    extra = spark.createDataFrame([(-1, None, None), (-2, None, "a b c"), (-3, "src1", ""), (-3, "src1", "")], "doc_id long, source string, text string")
    df = docs.unionByName(extra)
    rows = M.mix_report(df).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    assert len(rows) == len(texts) + 1 and all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])) for r in rows)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, M.mix_report(df).collect()))
    by = {}
    for r in rows:
        by.setdefault((r["source_size"], r["target"]), []).append(r)
    for (size, target), own in by.items():
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own) and target <= 3 * size
    assert abs(sum(t for _, t in by) - sum(r["size"] for r in rows)) < 1e-6 * sum(r["size"] for r in rows)


def test_mixed_rows_and_empty(spark):
    df = spark.createDataFrame([(i, "w " * 10, "s" + str(i % 2), i) for i in range(40)], "doc_id long, text string, source string, size int")
    out = M.mixed_rows(df)
    assert out.columns == df.columns and 0 < out.count() <= 120
    assert M.mixed_rows(df.limit(0)).count() == 0 and M.mix_report(df.limit(0)).count() == 0
    assert M.mix_report(df.where(F.lit(False))).columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_rows_without_id_reach_the_target(spark):
    df = spark.createDataFrame([(None, "w " * (k % 7 + 8) + str(k), "a") for k in range(400)] + [(k, "w " * 10, "b") for k in range(40)], "doc_id long, text string, source string")
    rows = M.mix_report(df).collect()
    own = [r for r in rows if r["doc_id"] is None]
    assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 15
