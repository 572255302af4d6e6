"""A paged feed of changes as a data source: batch reads, and a stream that knows how far into which page it is.

The feed is anything that answers ``page(cursor)`` with the items of a page and the cursor of the next (None after the last);
it is named by ``module:function`` and a string that it gets. A stream's offset is the cursor and the number of items
of its page that are done, so a run that stops in mid-page goes on with the next item. Items are at-least-once by nature of such feeds:
``append_feed`` drops what came before by digest.

Defined results: folders are left out and trashed items come as removals, as in ``changed_since``; a feed without items gives none; an
item without time has a null ``modified``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "file_id string, modified timestamp, change string, item string, digest string"
START = ""
MOST = 500  # items of one micro-batch
Page = tuple[list[dict], str | None]


def feed_of(options: dict[str, str]) -> Callable[[str], Page]:
    module, name = options["feed"].split(":")
    make = getattr(import_module(module), name)
    return make(options.get("where", ""))


def as_row(item: dict) -> tuple | None:
    """A change, or None for a folder."""
    import datetime
    import hashlib

    if item.get("is_folder"):
        return None
    text = json.dumps(item, sort_keys=True)
    at = item.get("modified")
    when = None if at is None else datetime.datetime.fromisoformat(at)
    return (item.get("id"), when, "removed" if item.get("trashed") else "upserted", text, hashlib.sha256(text.encode()).hexdigest())


class PagePartition(InputPartition):
    def __init__(self, cursor: str) -> None:
        self.cursor = cursor


class FeedReader(DataSourceReader):
    """Pages are found one after the other, as a feed must be; each is fetched again and read by a task of its own."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[PagePartition]:
        page, cursor, out = feed_of(self.options), START, []
        while cursor is not None:
            out.append(PagePartition(cursor))
            cursor = page(cursor)[1]
        return out

    def read(self, partition: PagePartition) -> Iterator[tuple]:
        for item in feed_of(self.options)(partition.cursor)[0]:
            row = as_row(item)
            if row is not None:
                yield row


class FeedStreamReader(SimpleDataSourceStreamReader):
    """Offsets: {"cursor": page, "done": items of it that are read}."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.most = int(options.get("most", MOST))

    def initialOffset(self) -> dict:
        return {"cursor": START, "done": 0}

    def _walk(self, start: dict, most: int | None, end: dict | None) -> tuple[list[tuple], dict]:
        page, at, rows, seen = feed_of(self.options), dict(start), [], 0
        while at != end and (most is None or seen < most):
            items, later = page(at["cursor"])
            stop = len(items) if most is None else min(len(items), at["done"] + most - seen)
            if end is not None and end["cursor"] == at["cursor"]:
                stop = min(stop, end["done"])
            rows += [r for r in map(as_row, items[at["done"] : stop]) if r is not None]
            seen += max(stop - at["done"], 0)
            moved = {"cursor": at["cursor"], "done": max(stop, at["done"])}
            # A page counts as read only when all its items are; the last page stays open for what is added to it.
            if moved["done"] >= len(items) and later is not None and moved != end:
                moved = {"cursor": later, "done": 0}
            if moved == at:
                break
            at = moved
        return rows, at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._walk(start, self.most, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._walk(start, None, end)[0])

    def commit(self, end: dict) -> None:
        pass


class PagedFeed(DataSource):
    """Options: ``feed`` (module:function), ``where`` (given to it), ``most`` (items of a micro-batch)."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FeedReader:
        return FeedReader(self.options)

    def simpleStreamReader(self, schema: StructType) -> FeedStreamReader:
        return FeedStreamReader(self.options)


def read_feed(spark: SparkSession, feed: str, where: str) -> DataFrame:
    spark.dataSource.register(PagedFeed)
    return spark.read.format("paged_feed").option("feed", feed).option("where", where).load()


def stream_feed(spark: SparkSession, feed: str, where: str, most: int = MOST) -> DataFrame:
    spark.dataSource.register(PagedFeed)
    return spark.readStream.format("paged_feed").option("feed", feed).option("where", where).option("most", str(most)).load()


def append_feed(rows: DataFrame, path: str, checkpoint: str, every: str = "10 seconds"):
    """Write the changes of a stream, each digest once: a batch leaves out what earlier batches hold, and replaces only its own part."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in system.listStatus(files)] if system.exists(files) else []
        older = [f"{path}/{n}" for n in names if n.startswith("batch=") and int(n.split("=")[1]) < number]
        fresh = batch.dropDuplicates(["digest"])
        if older:
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(*older).select("digest"), "digest", "left_anti")
        fresh.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def changed(rows: DataFrame, since) -> DataFrame:
    """Changes after the cursor; an item without time counts as changed."""
    return rows.where(F.coalesce(F.col("modified") > F.lit(since).cast("timestamp"), F.lit(True)))
