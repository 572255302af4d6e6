import random

import pytest

from bidlake.llm import topk as K
from tests.oracle import assert_same, connect


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert_same(K.embedding_neighbours(spark.read.parquet(f"{sf}/embeddings.parquet")), connect(sf), K.ORACLE_SQL)


@pytest.mark.parametrize("block", [3, 512])
def test_ties_nulls_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(K, "QUERY_BLOCK", block)
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([0.0, 0.5, 1.0, -0.25]) for _ in range(4)]) for i in range(400)]
    rows += [(1000, None), (1001, [float("nan"), 1.0, 1.0, 1.0]), (1002, [None, 1.0, 1.0, 1.0]), (1003, [1.0, 1.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    good = {i: [int(256 * x // 1) for x in v] for i, v in rows if i is not None and v and all(x is not None and x == x for x in v)}
    got = {}
    for r in K.embedding_neighbours(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in good if i % 50 == 0}
    for q, found in got.items():
        want = sorted(((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q))[:5]  # noqa: B905
        assert sorted(found) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_long_query_is_answered_by_the_components_that_vectors_have(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [])], "vec_id long, vector array<double>")
    queries = spark.createDataFrame([(9, [0.0, 1.0, 5.0])], "vec_id long, vector array<double>")
    assert [(r["rank"], r["vec_id"], r["score"]) for r in K.top_k(vectors, queries, 3).orderBy("rank").collect()] == [(1, 1, 131072), (2, 2, 65536), (3, 3, 0)]


def test_no_query(spark):
    vectors = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, vector array<double>")
    assert K.top_k(vectors, vectors.where("vec_id > 5")).count() == 0


def test_empty_and_small(spark):
    df = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")
    assert K.embedding_neighbours(df).count() == 0 and K.embedding_neighbours(df.limit(0)).count() == 0
