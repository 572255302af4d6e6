from pyspark.sql import functions as F

from bidlake.streaming import jobs as X

EVENTS = [("a", i, float(i * 10), i % 4 == 0) for i in range(40)] + [("b", 100 + i, float(i), False) for i in range(5)] + [(None, 200, 1.0, False)]
SCHEMA = "key string, id long, t double, flag boolean"


def reference(limit, seconds):
    out, kept = {}, {}
    for key, i, t, _ in sorted(EVENTS, key=lambda e: (e[2], e[1])):
        own = [x for x in kept.get(key, []) if x > t - seconds]
        out[i] = len(own) < limit
        kept[key] = [*own, t] if out[i] else own
    return out


def test_sliding_limit_counts_admissions_only(spark):
    got = {r["id"]: r["admitted"] for r in X.decide_batch(spark.createDataFrame(EVENTS, SCHEMA), X.sliding_limit(3, 60.0)).collect()}
    assert got == reference(3, 60.0)


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([e for e in EVENTS if e[0]], SCHEMA)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    for name, step in (("limit", X.sliding_limit(3, 60.0)), ("lockout", X.lockout(3, 100.0)), ("replay", X.replay_window(35.0))):
        run = X.decide_stream(stream, step).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        run.awaitTermination(120)
        have = {(r["id"], r["admitted"]) for r in spark.table(name).collect()}
        assert have == {(r["id"], r["admitted"]) for r in X.decide_batch(df, step).collect()}


def test_window_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run = X.daily_usage(stream).writeStream.format("memory").queryName("usage").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {tuple(r) for r in spark.table("usage").collect()} == {tuple(r) for r in X.daily_usage(events).collect()}


def test_upsert_stream_adds_batches_and_reads_the_newest(spark, tmp_path):
    for i, rows in enumerate(([("k", 1, "old"), ("k", 2, "new"), ("m", 5, "x")], [("k", 3, "newest"), ("m", 4, "late"), ("n", 1, "y")])):
        changes = spark.createDataFrame(rows, "key string, version int, v string")
        changes.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(changes.schema).parquet(str(tmp_path / "in"))
        X.upsert_stream(stream, str(tmp_path / "out"), ["key"], "version", str(tmp_path / "c")).awaitTermination(120)
        assert (tmp_path / f"out/batch={i}").exists()
    want = {("k", "newest"), ("m", "x"), ("n", "y")}
    assert {(r["key"], r["v"]) for r in X.read_upserted(spark, str(tmp_path / "out"), ["key"], "version").collect()} == want
    X.compact_upserts(spark, str(tmp_path / "out"), ["key"], "version", str(tmp_path / "short"))
    short = spark.read.parquet(str(tmp_path / "short"))
    assert short.count() == 3 and {(r["key"], r["v"]) for r in X.read_upserted(spark, str(tmp_path / "short"), ["key"], "version").collect()} == want


def test_state_goes_after_the_window(spark, tmp_path):
    """Keys of long ago leave no state once newer rows have moved the watermark past their windows."""
    for i, rows in enumerate(([("a", 1, 10.0, False), ("b", 2, 20.0, False)], [("c", 3, 1e6, False)], [("d", 4, 2e6, False)])):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        run = X.decide_stream(stream, X.replay_window(35.0)).writeStream.format("noop").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        run.awaitTermination(120)
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_null_key_keeps_its_state_over_slices(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "2")
    try:
        events = spark.createDataFrame([(None, i, float(i), False) for i in range(8)], SCHEMA)
        assert sum(r["admitted"] for r in X.decide_batch(events, X.replay_window(100.0)).collect()) == 1
    finally:
        spark.conf.set(name, before)
