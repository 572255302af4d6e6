import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from bidlake.llm import lexical as L
from tests.oracle import assert_same, connect

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, k):
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_all, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = {}
    for item in {i for i, _ in items if i is not None}:
        terms = {w for i, t in items if i == item for w in words(t)}
        scored = []
        for i, bag in bags:
            m = 50 + 50 * sum(bag.values()) * n_all // length
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in terms if t in bag)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out[item] = [(None if none else i, -s) for s, none, i in sorted(scored)[:k]]
    return {i: x for i, x in out.items() if x}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["item_id"], r["rank"])):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert_same(L.search(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")), connect(sf), L.ORACLE_SQL)


@pytest.mark.parametrize("conf", [L.Search(k=5, item_leaf=2, doc_leaf=4, block=32), L.Search(k=3, lot_terms=20), L.Search()])
def test_against_brute_force(spark, conf, monkeypatch):
    monkeypatch.setattr(L, "SEED_ROWS", 50)
    rnd = random.Random(3)
    vocab = [*("Ab ab éa Éa x9 über 日本 a b c d e".split()), *(f"w{k}" for k in range(60))]
    make = lambda n: rnd.choice([" ", "-", "\n", "_"]).join(rnd.choice(vocab) for _ in range(n))
    docs = [(k, make(rnd.randrange(0, 40))) for k in range(300)]
    docs += [(500 + k, docs[7][1]) for k in range(40)] + [(7, docs[7][1]), (None, docs[7][1]), (900, None), (901, ""), (902, "..."), (903, "ab " * 5000)]
    items = [(k, make(rnd.randrange(1, 12))) for k in range(23)] + [(1, "über w1"), (50, None), (51, ""), (52, "nowhere"), (None, "ab")]
    df = spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, score double").repartition(5)
    queries = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    assert found(L.search(df, queries, conf)) == expected(docs, items, conf.k)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs, items.selectExpr("item_id", "'z' text"))):
        assert L.search(d, i).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    items = [np.unique(rng.integers(100 * (k % 4), 100 * (k % 4) + 100, 12)) for k in range(64)]
    tree = L.item_tree(list(range(64)), items, 400, 4)
    ranker = L.Ranker(L.Search(k=5, doc_leaf=16), tree, rng.integers(1, 9000, 400), 2000, 60_000, np.zeros(64, np.int64))
    terms = [np.unique(rng.integers(100 * (k % 4), 100 * (k % 4) + 100, 20)).astype(np.int32) for k in range(2000)]
    batch = pa.table({"doc_id": pa.array(range(2000), pa.int64()), "n": pa.array(rng.integers(20, 60, 2000)), "terms": pa.array(terms, pa.list_(pa.int32())), "tfs": pa.array([np.ones(len(t), np.int32) for t in terms], pa.list_(pa.int32()))})
    docs = L.DocumentTree(batch, ranker)
    every = np.concatenate([L.product(tree.rows, docs.rows(k), docs.most) for k in range(len(docs.levels[0]))], axis=1)
    floor = np.sort(every, axis=1)[:, -5]
    left = L.open_leaves(docs, tree, floor)
    open_ = np.zeros(every.shape, bool)
    for leaf, nodes in left.items():
        for node in nodes:
            open_[tree.low[node] : tree.high[node], leaf * 16 : leaf * 16 + 16] = True
    assert open_[every >= floor[:, None]].all()
    assert open_.mean() < 0.3  # other languages fall out in whole batches
