"""Streaming forms: windows with watermarks, and what is written micro-batch by micro-batch. Rules with state are in ``rules``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from bidlake.operators.prepare import latest_per_key
from bidlake.operators.ranks import running
from bidlake.streaming.rules import decide_batch, decide_stream, lockout, replay_window, sliding_limit  # noqa: F401

WATERMARK = "10 minutes"


def daily_usage(events: DataFrame, at: str = "ts") -> DataFrame:
    return events.withWatermark(at, WATERMARK).groupBy(F.window(at, "1 day").alias("w"), "user_id", "event_type").agg(F.count("*").alias("used")).select("user_id", "event_type", F.col("w.start").alias("day"), "used")


def rolling_summary(events: DataFrame, at: str = "ts", length: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    out = events.withWatermark(at, WATERMARK).groupBy(F.window(at, length, slide).alias("w")).agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return out.select(F.col("w.start").alias("start"), "calls", "errors")


def error_alerts(events: DataFrame, at: str = "ts", period: str = "300 seconds") -> DataFrame:
    """At most one notice a period: its first error."""
    bad = events.where(F.col("event_type") == "error").withWatermark(at, WATERMARK)
    return bad.groupBy(F.window(at, period).alias("w")).agg(F.min(at).alias("first"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), "first", "n")


def incidents(events: DataFrame, at: str = "ts", gap: str = "24 hours") -> DataFrame:
    bad = events.where(F.col("event_type") == "error").withWatermark(at, WATERMARK)
    return bad.groupBy(F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("opened"), "n")


def pack_events(events: DataFrame, pack: str, order: str, amount: str) -> DataFrame:
    """Each event with its number in its pack and the pack's total so far. ``order`` is a number, unique in a pack."""
    return running(events.withColumn("_one", F.lit(1)), [pack], order, {"seq": "_one", "total": amount}).drop("_one")


FOLD = 64  # batches after which totals of packs are written anew as one table


def _totals_before(spark: SparkSession, path: str, number: int, pack: str) -> DataFrame | None:
    """(pack, seq, total) of all batches before this one: the newest fold below it and the batches since."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(files):
        return None
    names = [f.getPath().getName() for f in system.listStatus(files)]
    held = {kind: sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")) for kind in ("fold", "batch")}
    fold = max((k for k in held["fold"] if k < number), default=-1)
    parts = ([f"{path}/fold={fold}"] if fold >= 0 else []) + [f"{path}/batch={k}" for k in held["batch"] if fold < k < number]
    return spark.read.parquet(*parts).groupBy(pack).agg(F.sum("seq").alias("seq"), F.sum("total").alias("total")) if parts else None


def pack_event_stream(events: DataFrame, pack: str, order: str, amount: str, path: str, checkpoint: str):
    """Number the events of each pack, and sum their amounts, once and for good, as they come.

    A batch continues from the totals of the batches before it, so a batch that runs again, after a failure in any of its writes, gives
    its events the same numbers: all that it writes bears its number and replaces what it wrote before. Within a batch events go by ``order``.
    Every ``FOLD`` batches the totals are folded, so that a batch reads few tables. A null pack is a pack.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark, kept = batch.sparkSession, batch.persist()
        try:
            ran = pack_events(kept, pack, order, amount)
            earlier = _totals_before(spark, f"{path}/totals", number, pack)
            if earlier is not None:
                base = earlier.select(F.col(pack).alias("_pack"), F.col("seq").alias("_seq"), F.col("total").alias("_total"))
                ran = ran.join(base, F.col(pack).eqNullSafe(F.col("_pack")), "left")
                ran = ran.withColumns({"seq": F.col("seq") + F.coalesce("_seq", F.lit(0)), "total": F.col("total") + F.coalesce("_total", F.lit(0))}).drop("_pack", "_seq", "_total")
            ran.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
            own = kept.groupBy(pack).agg(F.count("*").alias("seq"), F.coalesce(F.sum(amount), F.lit(0)).alias("total"))
            own.write.mode("overwrite").parquet(f"{path}/totals/batch={number}")
            if number % FOLD == FOLD - 1:
                _totals_before(spark, f"{path}/totals", number + 1, pack).write.mode("overwrite").parquet(f"{path}/totals/fold={number}")
        finally:
            kept.unpersist()

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_pack_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


class LateCounter(StreamingQueryListener):
    """Counts the rows that stateful steps of a session's streams dropped behind their watermarks, by query."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(event.name or str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        name = event.progress.name or str(event.progress.id)
        self.dropped[name] = self.dropped.get(name, 0) + sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def part_late(events: DataFrame, at: str, seconds: float, path: str, checkpoint: str):
    """Part a stream into ``path/ontime`` and ``path/late`` by the watermark that a stateful step would have.

    A batch's watermark is the greatest time of the batches before it less ``seconds``; each batch notes its own greatest time under
    its number, so a batch that runs again parts its rows alike. Rows before the watermark are dead letters, as are rows without time.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark, notes = batch.sparkSession, f"{path}/greatest"
        files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(notes)
        system = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        known = [f.getPath().getName() for f in system.listStatus(files)] if system.exists(files) else []
        # Each note holds the greatest time up to its batch, so the newest below this batch tells all.
        last = max((int(n.split("=")[1]) for n in known if n.startswith("batch=") and int(n.split("=")[1]) < number), default=-1)
        before = spark.read.parquet(f"{notes}/batch={last}").first()["greatest"] if last >= 0 else None
        kept = batch.persist()
        try:
            greatest = kept.agg(F.max(at).cast("timestamp").alias("t")).select(F.greatest("t", F.lit(before).cast("timestamp")).alias("greatest"))
            late = F.col(at).isNull() if before is None else F.coalesce(F.col(at).cast("timestamp") < F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {seconds} SECONDS"), F.lit(True))
            kept.where(~late).write.mode("overwrite").parquet(f"{path}/ontime/batch={number}")
            kept.where(late).write.mode("overwrite").parquet(f"{path}/late/batch={number}")
            greatest.write.mode("overwrite").parquet(f"{notes}/batch={number}")
        finally:
            kept.unpersist()

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expire(df: DataFrame, at: str, now, seconds: int) -> DataFrame:
    """Rows still alive ``seconds`` after their time."""
    return df.where(F.col(at).cast("timestamp") > F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds)))


def upsert_stream(changes: DataFrame, path: str, keys: list[str], version: str, checkpoint: str):
    """Upsert a stream into a table of changes: each micro-batch adds the newest row of each of its keys and rewrites nothing.

    A batch that runs again replaces its own part only. ``read_upserted`` gives the table, ``compact_upserts`` a short form of it.
    """

    def add(batch: DataFrame, number: int) -> None:
        latest_per_key(batch, keys, F.desc(version)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserted(spark: SparkSession, path: str, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key; of equal versions the one that came last."""
    return latest_per_key(spark.read.parquet(path), keys, F.desc(version), F.desc("batch")).drop("batch")


def compact_upserts(spark: SparkSession, path: str, keys: list[str], version: str, out: str) -> None:
    """Write the table of changes with one row a key to a new path, each row in the batch that brought it."""
    latest_per_key(spark.read.parquet(path), keys, F.desc(version), F.desc("batch")).write.partitionBy("batch").parquet(out)


def append_stream(rows: DataFrame, path: str, checkpoint: str):
    """Write every new row once, in the batches that are there now."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
