"""Queries over sources, windows and stateful rules, in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidlake.common import scratch, table
from bidlake.plans.history_queries import PAIRS_SQL, pairs_of
from bidlake.plans.registry import query
from bidlake.plans.report_queries import OCDS_SQL, release
from bidlake.plans.scoring_queries import SPLIT_SQL
from bidlake.operators import prepare as P
from bidlake.sources import tables as S
from bidlake.streaming import jobs as X


def keyed_events(spark, sf_dir):
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), ts.alias("t"), (F.col("event_type") == "purchase").alias("flag"))


@query("x1_sliding_limit")
def sliding_limit(spark, sf_dir):
    return X.decide_batch(keyed_events(spark, sf_dir), X.sliding_limit(3, 6 * 3600.0)).select("key", "id", "admitted")


@query("x2_lockout")
def lockout(spark, sf_dir):
    return X.decide_batch(keyed_events(spark, sf_dir), X.lockout(4, 24 * 3600.0)).select("key", "id", "admitted")


REPLAY_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), w AS (
SELECT user_id, event_id, t, n, t AS opened, true AS admitted FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.event_id, e.t, e.n, CASE WHEN e.t - w.opened >= 86400 THEN e.t ELSE w.opened END, e.t - w.opened >= 86400 FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, admitted FROM w"""


@query("x3_suppress_replays", REPLAY_SQL)
def suppress_replays(spark, sf_dir):
    return X.decide_batch(keyed_events(spark, sf_dir), X.replay_window(86400.0)).select("key", "id", "admitted")


@query("x5_daily_usage", "SELECT user_id, event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS used FROM events GROUP BY 1, 2, 3")
def daily_usage(spark, sf_dir):
    return X.daily_usage(table(spark, sf_dir, "events")).withColumn("day", F.to_date("day"))


@query("x6_rolling_api_summary", """WITH s AS (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 HOUR * k AS start, event_type FROM events, (SELECT unnest(range(24)) AS k))
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors FROM s GROUP BY 1""")
def rolling_api_summary(spark, sf_dir):
    return X.rolling_summary(table(spark, sf_dir, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("x7_error_alerts", "SELECT strftime(time_bucket(INTERVAL 300 SECONDS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, min(event_id) AS event_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def error_alerts(spark, sf_dir):
    bad = X.error_alerts(table(spark, sf_dir, "events"))
    first = bad.join(table(spark, sf_dir, "events").where("event_type = 'error'"), F.col("first") == F.col("ts"))
    return first.groupBy(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start")).agg(F.min("event_id").alias("event_id"), F.max("n").alias("n"))


@query("x7_incidents", """WITH e AS (SELECT ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS first FROM events WHERE event_type = 'error'), g AS (SELECT ts, sum(first) OVER (ORDER BY ts, first DESC ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS opened, count(*) AS n FROM g GROUP BY k""")
def incidents(spark, sf_dir):
    return X.incidents(table(spark, sf_dir, "events"), gap="2 hours").select(F.date_format("opened", "yyyy-MM-dd HH:mm:ss").alias("opened"), "n")


@query("x8_expire", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 86400 SECONDS")
def expire(spark, sf_dir):
    return X.expire(table(spark, sf_dir, "events"), "ts", "2024-01-10 00:00:00", 86400).select("event_id")


@query("x9_track_outcomes", "SELECT user_id, event_type, max_by(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def track_outcomes(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    target, changes = events.where("event_id % 2 = 0"), events
    newest = P.latest_per_key(changes, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id"))
    return P.upsert(P.latest_per_key(target, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")), newest, ["user_id", "event_type"], "ts").select("user_id", "event_type", "value")


@query("x9_outcomes_stream", "SELECT user_id, event_type, max_by(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def outcomes_stream(spark, sf_dir):
    """The same outcomes from a stream of files, several micro-batches, in any order."""
    path, keys = scratch(spark, "outcomes"), ["user_id", "event_type"]
    table(spark, sf_dir, "events").select(*keys, "value", F.struct("ts", "event_id").alias("version")).repartition(6).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    X.upsert_stream(stream, f"{path}/out", keys, "version", f"{path}/checkpoint").awaitTermination()
    return X.read_upserted(spark, f"{path}/out", keys, "version").select(*keys, "value")


@query("x11_pack_events", "SELECT user_id, event_id, count(*) OVER w AS seq, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def pack_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return X.pack_events(events, "user_id", "event_id", "value").select("user_id", "event_id", "seq", F.round("total", 4).alias("total"))


@query("s1_bids_csv", "SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem")
def bids_csv(spark, sf_dir):
    """Written as gzip CSV and read back with a declared schema."""
    path = scratch(spark, "bids-csv")
    table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").write.option("compression", "gzip").option("header", True).csv(path)
    return S.read_bids_csv(spark, path, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double")


@query("s2_read_ocds", OCDS_SQL)
def read_ocds(spark, sf_dir):
    """The three tables of a release, written as CSV with line breaks inside a field, read back and joined into bids."""
    main, awards, suppliers = release(spark, sf_dir)
    parts = {"main": main, "awards": awards.withColumn("description", F.concat("description", F.lit(' "a"\nb'))), "suppliers": suppliers}
    paths = {name: scratch(spark, name) for name in parts}
    for name, df in parts.items():
        df.write.option("escape", '"').csv(paths[name], header=True)
    main, awards, suppliers = S.read_ocds(spark, *paths.values(), {name: df.schema for name, df in parts.items()})
    return P.ocds_to_bids(main, awards.withColumn("description", F.regexp_replace("description", ' "a"\nb$', "")), suppliers, {"country": "ZA", "currency": "ZAR"})


@query("s3_write_table", "SELECT o_orderkey, o_orderstatus FROM orders")
def write_table(spark, sf_dir):
    path = scratch(spark, "table")
    S.write_table(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path, ["o_orderstatus"])
    return S.read_table(spark, path).select("o_orderkey", F.col("o_orderstatus").cast("string").alias("o_orderstatus"))


@query("x11_pack_event_stream", "SELECT user_id, max(n) AS events, CAST(sum(n) AS BIGINT) AS seqs, round(max_by(total, n), 4) AS total FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, sum(value) OVER (PARTITION BY user_id) AS total FROM events) GROUP BY 1")
def pack_event_stream(spark, sf_dir):
    """The events of each user numbered in several batches of a stream: each number once, and the total at the last."""
    path = scratch(spark, "packs")
    table(spark, sf_dir, "events").select("user_id", "event_id", "value").repartition(4).write.parquet(f"{path}/in")
    stream = spark.readStream.schema("user_id long, event_id long, value double").option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    X.pack_event_stream(stream, "user_id", "event_id", "value", path, f"{path}/checkpoint").awaitTermination()
    rows = X.read_pack_events(spark, path)
    return rows.groupBy("user_id").agg(F.countDistinct("seq").alias("events"), F.sum("seq").alias("seqs"), F.round(F.max_by("total", "seq"), 4).alias("total"))


@query("s4_capped_export", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def capped_export(spark, sf_dir):
    return S.capped_export(table(spark, sf_dir, "orders"), ["o_orderdate", "o_orderkey"], 100).select("o_orderkey", "o_custkey")


@query("s5_write_splits", f"WITH {SPLIT_SQL} SELECT pair_id, did_win, split FROM splits")
def write_splits(spark, sf_dir):
    path = scratch(spark, "splits")
    S.write_splits(P.time_split(pairs_of(spark, sf_dir)).select("pair_id", "did_win", "split"), path)
    return S.read_table(spark, path).select("pair_id", "did_win", F.col("split").cast("string").alias("split"))


@query("s6_json_log", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Unknown' ELSE event_type END AS endpoint FROM events WHERE event_id % 9 > 0")
def json_log(spark, sf_dir):
    path = scratch(spark, "log")
    events = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 9 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id", F.when(F.col("event_id") % 4 > 0, F.col("event_type")).alias("endpoint"))))
    events.select(line.alias("value")).write.text(path)
    return S.read_json_log(spark, path, "event_id long, endpoint string").where("event_id IS NOT NULL")


@query("s7_dataset_metadata", f"""WITH {PAIRS_SQL} SELECT '{{"total":' || count(*) || ',"positives":' || sum(did_win) || ',"negatives":' || (count(*) - sum(did_win)) || ',"first_year":' || min(publish_year) || ',"last_year":' || max(publish_year) || ',"countries":["' || array_to_string(list_sort(list_distinct(list(buyer_country))), '","') || '"],"features":["bid_price","estimate"]}}' AS metadata FROM pairs""")
def dataset_metadata(spark, sf_dir):
    return S.dataset_metadata(pairs_of(spark, sf_dir), ["bid_price", "estimate"], "buyer_country")


@query("s8_documents", "SELECT CAST(doc_id // 100 AS INTEGER) AS folder, CAST(sum(length(coalesce(text, '')) + 1) AS BIGINT) AS n_chars FROM documents GROUP BY 1")
def documents(spark, sf_dir):
    """The documents as text files in folders of a hundred, read back whole."""
    path = scratch(spark, "texts")
    docs = table(spark, sf_dir, "documents").select(F.expr("doc_id div 100").cast("int").alias("folder"), F.coalesce("text", F.lit("")).alias("value"))
    docs.write.partitionBy("folder").text(path)
    return S.read_documents(spark, path).where("type = 'txt'").groupBy("folder").agg(F.sum(F.length("text")).cast("long").alias("n_chars"))


@query("s9_tail_events", "SELECT event_id, event_type FROM events WHERE event_id > 100")
def tail_events(spark, sf_dir):
    return S.tail_events(table(spark, sf_dir, "events"), 100, "event_id").select("event_id", "event_type")


@query("s11_replace_partition", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'old' END AS version, o_orderstatus FROM orders")
def replace_partition(spark, sf_dir):
    path = scratch(spark, "tenants")
    old = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("old").alias("version"), "o_orderstatus")
    S.write_table(old, path, ["o_orderstatus"])
    S.replace_partition(old.where("o_orderstatus = 'F'").withColumn("version", F.lit("new")), path, "o_orderstatus")
    return S.read_table(spark, path).select("o_orderkey", "version", F.col("o_orderstatus").cast("string").alias("o_orderstatus"))


@query("s12_changed_since", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'removed' ELSE 'upserted' END AS change FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00' AND event_type <> 'signup'")
def changed_since(spark, sf_dir):
    files = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("modified"), (F.col("event_type") == "signup").alias("is_folder"), (F.col("event_type") == "error").alias("trashed"))
    return S.changed_since(files.withColumn("modified", F.col("modified").cast("timestamp")), "2024-01-05 00:00:00").select("event_id", "change")
