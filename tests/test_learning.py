import random

import pytest
from pyspark.sql import functions as F

from bidlake.operators import learning as M
from bidlake.operators.evaluation import log_loss
from bidlake.plans import learning_queries as L


class Stopped(Exception):
    pass


def test_meta_model_sees_every_year_with_both_classes_on_both_sides(spark, monkeypatch):
    classes = {2010: [1], 2011: [0, 1], 2012: [0, 1], 2013: [1, 1], 2014: [1, 0], 2015: [0, 0]}
    rows = [(k, year, "train", y) for year, ys in classes.items() for k, y in enumerate(ys)] + [(9, 2016, "val", 1), (9, 2016, "val", 0)]
    given = []

    def stop(train, features, label, fold_year, years, weight=1.0):
        given.extend(years)
        raise Stopped

    monkeypatch.setattr(L, "model_rows", lambda spark, sf_dir: spark.createDataFrame(rows, "pair_id long, publish_year int, split string, did_win int"))
    monkeypatch.setattr(L.M, "train_stack", stop)
    with pytest.raises(Stopped):
        L.trained(spark, "")
    assert given == [2012, 2014]


@pytest.mark.parametrize(("labels", "blocks"), [([0, 1, 1, 0] * 6, [1, 2, 3, 4, 5]), ([0] * 24, None)])
def test_one_year_is_cut_into_blocks(spark, monkeypatch, labels, blocks):
    rows = [(k, 2010, k, "train", y) for k, y in enumerate(labels)]
    given = []

    def stop(train, features, label, fold_year, years, weight=1.0):
        given.extend([fold_year, years, train.where("block = 0").count(), train.where("block = 5").count()])
        raise Stopped

    monkeypatch.setattr(L, "model_rows", lambda spark, sf_dir: spark.createDataFrame(rows, "pair_id long, publish_year int, publish_month int, split string, did_win int"))
    monkeypatch.setattr(L.M, "train_stack", stop)
    with pytest.raises(ValueError if blocks is None else Stopped):
        L.trained(spark, "")
    assert given == ([] if blocks is None else ["block", blocks, 4, 4])


def test_scored_stream_equals_the_batch_and_keeps_bad_documents(spark, monkeypatch):
    sf, columns = "/root/testdata/sf0.001", ["o_orderkey", "type", "region", "completeness", "eligible", "system", "recommendation", "error"]
    docs = L.documents_to_score(spark, sf)
    plan = L.scoring_plan(spark, sf)
    monkeypatch.setattr(L, "scoring_plan", lambda spark, sf_dir: plan)
    batch = {r["o_orderkey"]: r for r in plan(docs).collect()}
    stream = {r["o_orderkey"]: r for r in L.scored_documents(spark, sf).collect()}
    texts = {r["o_orderkey"]: r["text"] for r in docs.collect()}
    assert set(batch) == set(stream) == set(texts)
    for k, text in texts.items():
        assert [batch[k][c] for c in columns] == [stream[k][c] for c in columns]
        if text is None or not text.strip():
            want = "unreadable" if text is None else "no text"
            assert (stream[k]["error"], stream[k]["win_probability"], stream[k]["adjusted"], stream[k]["recommendation"]) == (want, None, None, "PASS")
        else:
            assert stream[k]["error"] is None and 0 < stream[k]["win_probability"] < 1
            assert stream[k]["recommendation"] == ("DISQUALIFIED" if not stream[k]["eligible"] else "PURSUE" if stream[k]["adjusted"] >= 0.5 else "PASS")


@pytest.fixture(scope="module")
def trained(spark):
    return L.trained(spark, "/root/testdata/sf0.001")


def test_stack_beats_the_base_rate_and_calibration_keeps_the_order(spark, trained):
    stack, rows = trained
    test = rows.where("split = 'test'")
    scored = M.score_batch(stack, test, 0.6).cache()
    assert scored.count() == test.count() and scored.where("probability < 0.01 or probability > 0.99 or raw < 0 or raw > 1").count() == 0
    loss = lambda p: scored.agg(log_loss(p, F.col("did_win"))).first()[0]
    base = rows.where("split = 'train'").agg(F.avg("did_win")).first()[0]
    assert loss(F.col("probability")) <= loss(F.lit(base)) + 0.02
    points = sorted((r["raw"], r["probability"]) for r in scored.select("raw", "probability").distinct().collect())
    assert all(b[1] >= a[1] - 1e-12 for a, b in zip(points, points[1:], strict=False))
    wrong = "(probability >= 0.6) != (recommendation = 'PURSUE') or (probability < 0.6) != (recommendation = 'PASS')"
    assert scored.where(wrong).count() == 0


def test_top_factors_are_the_features_of_most_gain(spark, trained):
    stack, rows = trained
    out = M.top_factors(stack, rows.where("split = 'test'").limit(20), {f: 0.0 for f in L.FEATURES}, "pair_id", 3).collect()
    want = [f for f, _ in sorted(stack.importances, key=lambda x: (-x[1], x[0]))[:3]]
    assert len(out) == 60 and all(want[r["rank"] - 1] == r["feature"] and r["side"] == ("above" if r["value"] is not None and r["value"] >= 0 else "below") for r in out)


def test_search_halves_and_finds_the_signal(spark):
    rnd = random.Random(1)
    rows = [(k, rnd.random(), rnd.random(), k % 3 == 0) for k in range(1500)]
    df = spark.createDataFrame([(k, a, b, int(a + 0.3 * rnd.random() > 0.6), v) for k, a, b, v in rows], "id int, a double, b double, y int, held boolean")
    run = lambda: M.search_params(df.where("not held"), df.where("held"), ["a", "b"], "y", "id", n=20)
    found = run()
    by_round = {}
    for r in found.collect():
        by_round.setdefault(r["round"], {})[r["learner"], r["setting"]] = r["auc"]
    assert {k: len(v) for k, v in by_round.items()} == {1: 20, 2: 7, 3: 3}
    for earlier, later in ((1, 2), (2, 3)):
        ranked = sorted(by_round[earlier].values(), reverse=True)
        assert all(by_round[earlier][s] >= ranked[len(by_round[later]) - 1] for s in by_round[later])
    assert max(by_round[3].values()) > 0.9
    assert len({n for n, _ in by_round[1]}) == 3 and len(set(map(str, M.random_settings(60)))) == 60


def test_documents_of_one_file_are_the_work_of_all_cores(spark):
    docs = L.documents_to_score(spark, "/root/testdata/sf0.001").coalesce(1)
    parts = L.dealt(docs).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert len(parts) > spark.sparkContext.defaultParallelism and max(r["n"] for r in parts) < 0.2 * docs.count()


def test_boosting_learns_from_grouped_rows_what_it_learns_from_single_ones(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([None, float("nan"), *range(40)]), rnd.random() * 100, rnd.randrange(3)) for _ in range(3000)]
    df = spark.createDataFrame([(None if a is None else float(a), b, c, int(b + 10 * c + 20 * rnd.random() > 70)) for a, b, c in rows], "a double, b double, c int, y int")
    edges = M.bin_edges(df, ["a", "b", "c"])
    assert [len(e) for e in edges[:2]] == [31, 31] and edges[2] == [0.0, 1.0, 2.0]
    single = M.assemble(df, ["a", "b", "c"], "y", 2.0, edges).cache()
    few = M.grouped(single).cache()
    assert few.count() < 3000 and few.agg(F.sum("weight")).first() == single.agg(F.sum("weight")).first()
    learner = M.learners()["gbt"].setFeaturesCol("cells")
    one, other = learner.fit(single), learner.fit(few)
    scores = lambda model: [r[0] for r in model.transform(single).select(F.round(F.element_at(M.vector_to_array("probability"), 2), 9)).collect()]
    assert scores(one) == scores(other)


def test_the_table_of_bids_is_read_once_for_split_and_fits(spark):
    plan = L.model_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "model-rows" in plan and "lineitem" not in plan


def test_logistic_models_of_all_folds_equal_those_of_single_fits(spark):
    """A constant column has no weight."""
    rnd = random.Random(4)
    rows = [(rnd.random() * 1e6, rnd.gauss(5, 2), 7.0, 2010 + k % 4) for k in range(4000)]
    df = spark.createDataFrame([(a, b, c, year, float(a / 1e6 + b / 10 + rnd.random() > 1.6), rnd.choice([1.0, 3.0])) for a, b, c, year in rows], "a double, b double, c double, year int, label double, weight double")
    within = [F.lit(True), F.col("year") < 2012]
    for model, some in zip(M.logits(df, ["a", "b", "c"], within), within, strict=True):
        part = M.assemble(df.where(some), ["a", "b", "c"])
        one = M.LogisticRegression(weightCol="weight", tol=1e-10).fit(part).transform(part).select("a", F.element_at(M.vector_to_array("probability"), 2).alias("p"))
        want = {r["a"]: r["p"] for r in one.collect()}
        got = {r["a"]: r["p"] for r in model.score(part, "p").collect()}
        assert max(abs(want[a] - got[a]) for a in want) < 1e-6


def test_no_fit_of_the_stack_takes_single_rows_into_a_tree_learner(spark, monkeypatch):
    """Copies of the rows change no count of what trees learn from beyond the lots."""
    rnd, seen = random.Random(5), []
    rows = [(float(k % 5), k % 2, 2010 + k % 3, k) for k in range(3000)]
    df = spark.createDataFrame([(a, int(y and rnd.random() > 0.3), year, k) for a, y, year, k in rows], "a double, y int, year int, id int")
    fit = M.RandomForestClassifier._fit
    monkeypatch.setattr(M.RandomForestClassifier, "_fit", lambda self, data: (seen.append(data.count()), fit(self, data))[1])
    stack = M.train_stack(df, ["a"], "y", "year", [2011, 2012])
    assert len(seen) == 3 and max(seen) <= 5 * 2 * M.LOTS
    assert M.raw_scores(stack, df).where("raw > 0 and raw < 1").count() == 3000
