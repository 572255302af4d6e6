import random
import time

import pytest
from pyspark.sql import functions as F

from bidlake.streaming import rules as Q

SCHEMA = "key string, id long, t double, flag boolean"
RULES = {"limit": lambda: Q.sliding_limit(3, 60.0), "lockout": lambda: Q.lockout(3, 100.0), "replay": lambda: Q.replay_window(35.0)}


def brute(name, rows):
    """Decisions by looking back over all earlier rows of the key, straight from each rule's words."""
    out, by = {}, {}
    for key, i, t, flag in sorted(rows, key=lambda r: (r[2], r[1])):
        past = by.setdefault(key, [])
        if name == "limit":
            ok = sum(a and t - s < 60 for s, a, _ in past) < 3
        elif name == "lockout":
            fails = []
            for s, a, f in past:
                fails = [] if a and f else [*fails, s]
            ok = sum(t - s < 100 for s in fails) < 3
        else:
            opened = [s for s, a, _ in past if a]
            ok = not opened or t - opened[-1] >= 35
        past.append((t, ok, flag))
        out[i] = ok
    return out


def events(seed, n=600, gaps=True):
    rnd, rows, t = random.Random(seed), [], 1000.0
    for i in range(n):
        t += rnd.choice([0.0, 1.0, 7.0, 20.0, 35.0, 60.0, 100.0, 500.0] if gaps else [1.0, 5.0])
        rows.append((rnd.choice(["hot", "hot", "hot", "b", None]), i, t, rnd.random() < 0.2))
    return rows


@pytest.mark.parametrize("name", sorted(RULES))
@pytest.mark.parametrize("gaps", [True, False])
def test_batch_form_follows_the_words_of_the_rule(spark, name, gaps):
    rows = events(3, gaps=gaps)
    got = {r["id"]: r["admitted"] for r in Q.decide_batch(spark.createDataFrame(rows, SCHEMA).repartition(3), RULES[name]()).collect()}
    assert got == brute(name, rows)


def test_one_hot_key_is_the_work_of_many_tasks(spark):
    rows = [("hot", k, 500.0 * (k // 5) + k % 5, False) for k in range(4000)]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        done = Q.decide_batch(spark.createDataFrame(rows, SCHEMA), Q.sliding_limit(3, 60.0))
        sizes = [r["n"] for r in done.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == 4 and max(sizes) < 0.4 * len(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    parts = Q.stretches(spark.createDataFrame(rows, SCHEMA), 60.0)
    assert parts.select("stretch").distinct().count() == 800


def test_short_stretches_cost_little_more_than_their_rows(spark):
    """30,000 stretches of one row each take about as long as one stretch of 30,000 rows."""

    def seconds(gap):
        rows = spark.range(30_000).select(F.lit("hot").alias("key"), "id", (F.col("id") * gap).cast("double").alias("t"), F.lit(False).alias("flag"))
        began = time.monotonic()
        admitted = Q.decide_batch(rows, Q.sliding_limit(3, 60.0)).agg(F.count_if("admitted")).first()[0]
        assert admitted == (30_000 if gap > 60 else 1_500)
        return time.monotonic() - began

    seconds(1)
    assert seconds(100) < 2 + 3 * seconds(1)


def test_stretches_part_only_at_gaps(spark):
    rows = events(5)
    found = sorted((r["key"] or "", r["t"], r["stretch"]) for r in Q.stretches(spark.createDataFrame(rows, SCHEMA), 60.0).collect())
    for (k, t, s), (k2, t2, s2) in zip(found, found[1:], strict=False):
        if k == k2:
            assert s2 - s == (t2 - t >= 60.0)


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    Q.use_rocksdb(spark)
    yield
    spark.conf.set(name, before)


def run(stream, rule, path, name, **options):
    query = Q.decide_with_state(stream, rule, **options).writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-c").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    return query


def test_typed_state_equals_batch_across_a_restart(spark, tmp_path, rocksdb):
    rows = [r for r in events(8, 200) if r[0]]
    rows.sort(key=lambda r: r[2])
    for part in (rows[:70], rows[70:140], rows[140:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        run(stream, Q.sliding_limit(3, 60.0), tmp_path, "limit")  # each run starts from the checkpoint of the one before
    got = {r["id"]: r["admitted"] for r in spark.read.parquet(str(tmp_path / "limit")).collect()}
    assert got == brute("limit", rows)
    left = spark.read.format("statestore").option("stateVarName", "times").option("flattenCollectionTypes", True).load(str(tmp_path / "limit-c"))
    assert "list_element" in str(left.schema) and left.count() > 0


def test_stream_starts_from_the_state_of_the_batch_form(spark, tmp_path, rocksdb):
    rows = sorted((r for r in events(9, 160) if r[0]), key=lambda r: (r[2], r[1]))
    old, new = rows[:80], rows[80:]
    rule = Q.lockout(3, 100.0)
    start = Q.states_after(spark.createDataFrame(old, SCHEMA), rule)
    spark.createDataFrame(new, SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    run(stream, rule, tmp_path, "lockout", start=start)
    want = brute("lockout", rows)
    assert {r["id"]: r["admitted"] for r in spark.read.parquet(str(tmp_path / "lockout")).collect()} == {i: want[i] for _, i, _, _ in new}


def test_timers_clear_state_and_ttl_mode_decides_alike(spark, tmp_path, rocksdb):
    for rows in ([("a", 1, 10.0, False), ("b", 2, 20.0, False)], [("c", 3, 1e6, False)], [("d", 4, 2e6, False)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = run(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), Q.replay_window(35.0), tmp_path, "replay")
    left = spark.read.format("statestore").option("stateVarName", "times").load(str(tmp_path / "replay-c"))
    assert query.lastProgress["stateOperators"] and {r["key"]["key"] for r in left.select("key").collect()} <= {"c", "d"}
    rows = [r for r in events(11, 60) if r[0]]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in2"))
    run(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in2")), Q.replay_window(35.0), tmp_path, "ttl", ttl=3600.0)
    assert {r["id"]: r["admitted"] for r in spark.read.parquet(str(tmp_path / "ttl")).collect()} == brute("replay", rows)
