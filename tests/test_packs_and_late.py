import pytest
from pyspark.sql import functions as F

from bidlake.streaming import jobs as X

SCHEMA = "pack string, event_id long, amount double"
BATCHES = [[("a", 5, 1.0), ("a", 2, 2.0), ("b", 9, 4.0), (None, 1, 1.0)], [("a", 1, 10.0), ("c", 3, None)], [(None, 0, 2.0), ("a", 7, 0.5), ("b", 8, 1.0)]]


def start(spark, path, name="out"):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/in")
    return X.pack_event_stream(stream, "pack", "event_id", "amount", f"{path}/{name}", f"{path}/{name}-c")


def numbers(spark, path, name="out"):
    return {(r["pack"], r["event_id"]): (r["seq"], r["total"]) for r in X.read_pack_events(spark, f"{path}/{name}").collect()}


WANT = {("a", 2): (1, 2.0), ("a", 5): (2, 3.0), ("b", 9): (1, 4.0), (None, 1): (1, 1.0), ("a", 1): (3, 13.0), ("a", 7): (4, 13.5), (None, 0): (2, 3.0), ("b", 8): (2, 5.0)}


@pytest.mark.parametrize("fold", [2, 64])
def test_numbers_are_given_once_and_survive_a_batch_that_dies(spark, tmp_path, monkeypatch, fold):
    monkeypatch.setattr(X, "FOLD", fold)
    for k, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 1:  # the batch dies after its rows are written and before its totals are
            with monkeypatch.context() as m:
                m.setattr(X.F, "count", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
                with pytest.raises(Exception, match="lost"):
                    start(spark, tmp_path).awaitTermination(120)
        start(spark, tmp_path).awaitTermination(120)
    got = numbers(spark, tmp_path)
    assert {k: v for k, v in got.items() if k != ("c", 3)} == WANT and got["c", 3][0] == 1


def test_late_rows_are_counted_and_kept(spark, tmp_path):
    schema = "id long, at timestamp"
    times = [[(1, 1000), (2, 1500)], [(3, 5000), (4, 1400)], [(5, 100), (6, 4950), (7, 1500), (8, None)], [(9, 6000)]]
    counter = X.LateCounter()
    spark.streams.addListener(counter)
    try:
        for rows in times:
            df = spark.createDataFrame(rows, "id long, s long").select("id", F.timestamp_seconds("s").alias("at"))
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            X.part_late(stream, "at", 600.0, str(tmp_path / "parted"), str(tmp_path / "parted-c")).awaitTermination(120)
            kept = stream.withWatermark("at", "600 seconds").dropDuplicates(["id", "at"])
            kept.writeStream.format("parquet").queryName("kept").option("path", str(tmp_path / "kept")).option("checkpointLocation", str(tmp_path / "kept-c")).trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.streams.removeListener(counter)
    ids = lambda name: sorted(r["id"] for r in spark.read.parquet(str(tmp_path / name)).select("id").collect())
    assert ids("parted/late") == [5, 7, 8] and ids("parted/ontime") == [1, 2, 3, 4, 6, 9]
    late = [i for i in ids("parted/late") if i != 8]
    assert counter.dropped["kept"] >= len(late) and not set(late) & set(ids("kept"))
