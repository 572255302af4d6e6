import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlake.llm import langid as L
from bidlake.llm import toxicity as X

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = L.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "", "en", 1), (3, "123 !?", "de", 1), (None, "abc", "en", 1), (4, "abc", None, 1)], "doc_id long, text string, lang string, score int")
    out = {r["doc_id"]: r for r in L.language_report(docs).collect()}
    assert len(out) == 5 and all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0.0 for i in (1, 2, 3))
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[None]["held_out"] is False
    assert L.language_report(docs.limit(0)).count() == 0


def test_temperature():
    rng = np.random.default_rng(0)
    label = rng.integers(0, 3, 4000)
    logits = rng.normal(0, 1, (4000, 3))
    logits[np.arange(4000), label] += 1.5
    assert L.fit_temperature(logits, label) == pytest.approx(1 / 1.5, rel=0.1)  # log odds of these classes are 1.5 times the logits
    assert L.fit_temperature(logits * 4, label) == pytest.approx(4 * L.fit_temperature(logits, label), rel=0.01)


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdeirst") for _ in range(5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(700):
        w = [rnd.choice(words) for _ in range(80)]
        bad = i % 5 == 0
        if bad:
            for _ in range(rnd.randint(3, 10)):
                w[rnd.randrange(80)] = rnd.choice(["vilexo", "vilexa", "grumble", "grumbly"])
        rows.append((i, " ".join(w)))
        if i < 500:
            labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_unlabelled(spark, corpus):
    docs, labels = corpus
    got = {r["doc_id"]: r for r in X.toxicity_report(docs, labels).where("doc_id >= 500").collect()}
    bad = [i for i in got if i % 5 == 0]
    assert sum(got[i]["toxic"] for i in bad) >= 0.95 * len(bad)
    assert not any(got[i]["toxic"] for i in got if i % 5)
    assert all(0 <= r["expected_severity"] <= 2 and r["grade"] in (0, 1, 2) for r in got.values())


def test_toxicity_edges(spark, corpus):
    docs, labels = corpus
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9002, ""), (None, "x")], "doc_id long, text string")
    both = docs.unionByName(extra)
    assert X.toxicity_report(both, labels).count() == 704
    kept = X.without_toxic(both, labels)
    assert kept.columns == ["doc_id", "text"] and kept.where("doc_id = 9002").count() == 2 and kept.where("doc_id IS NULL").count() == 1
    assert X.toxicity_report(docs, labels.where("toxic = 0")).where("toxic").count() == 0
    assert X.toxicity_report(docs.limit(0), labels).count() == 0


def test_thresholds_in_order(spark, corpus):
    model = X.fit(*corpus)
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]


def test_models_do_not_depend_on_partitions(spark, corpus):
    docs, labels = corpus
    docs = docs.unionByName(docs.limit(40))
    rows = lambda df: sorted(map(str, df.collect()))
    dealt = [docs.repartition(n, F.xxhash64("text", F.lit(n))) for n in (2, 7)]
    assert rows(X.toxicity_report(dealt[0], labels)) == rows(X.toxicity_report(dealt[1], labels.repartition(3)))
    spoken = [d.withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 3)) for d in dealt]
    assert rows(L.language_report(spoken[0])) == rows(L.language_report(spoken[1]))


def test_lookup_finds_the_features_of_a_text():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abé") for _ in range(rnd.randint(1, 9))) + rnd.choice(["", ".", "!", ","]) for _ in range(60)]
    texts = [None, "", " .. "] + [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 400))) for _ in range(40)]
    every = np.unique(np.concatenate([X.features(t) for t in texts]))
    vocabulary = np.sort(np.random.default_rng(1).choice(every, len(every) // 3, replace=False))
    lookup = X.Lookup(vocabulary)
    for t in texts:
        assert lookup(t)[0].tolist() == [k for k, v in enumerate(vocabulary) if v in set(X.features(t))]


def test_toxicity_labels_of_equal_texts_and_null_labels(spark, corpus):
    docs, labels = corpus
    again = docs.where("doc_id < 500").select((F.col("doc_id") + 5000).alias("doc_id"), "text")
    more = labels.select((F.col("doc_id") + 5000).alias("doc_id"), F.lit(1).alias("toxic")).unionByName(spark.createDataFrame([(3, None), (None, 1)], "doc_id long, toxic int"))
    kept = lambda y: sorted((r["doc_id"], r["p_toxic"]) for r in X.toxicity_report(docs, y).collect())
    model = X.fit(docs.unionByName(again), labels.unionByName(more))
    assert sorted((r["doc_id"], r["p_toxic"]) for r in X.score(docs, model).collect()) == kept(labels)


def test_very_long_text(spark, corpus):
    docs, labels = corpus
    long = spark.createDataFrame([(9100, "grumble vilexo " * 200_000)], "doc_id long, text string")
    assert X.score(long, X.fit(docs, labels)).first()["toxic"]
    assert L.language_report(long.withColumn("lang", F.lit("en"))).count() == 1


def test_tokens_share_what_is_kept_of_their_prefixes():
    vocabulary = np.unique(np.concatenate([X.features("abcdefghi abcdefghi"), X.features("xyz")]))
    lookup = X.Lookup(vocabulary)
    at, _, total = lookup("abcdefghi abcdefgXX abcdefgYY")
    kept = [lookup[t][2] for t in (b"abcdefghi", b"abcdefgxx", b"abcdefgyy")]
    assert total == 3 and all(a is b for k in kept[1:] for a, b in zip(kept[0], k, strict=True))
    own = np.searchsorted(vocabulary, [f for f in X.features("abcdefghi abcdefgXX abcdefgYY") if f in set(vocabulary)])
    assert at.tolist() == own.tolist()
