"""Readers and writers of bids, releases, logs, documents and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlake.common import discard, materialize
from bidlake.operators.ranks import running_over


def read_bids_csv(spark: SparkSession, paths: str | list[str], schema: str | T.StructType, partitions: int | None = None) -> DataFrame:
    """Gzip or plain CSV with header; lines that do not fit the schema are skipped. Gzip cannot be split: deal it out once."""
    df = spark.read.csv(paths, header=True, schema=schema, mode="DROPMALFORMED")
    return df.repartition(partitions) if partitions else df


def read_ocds(spark: SparkSession, main: str, awards: str, suppliers: str, schemas: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three CSV tables of an open-contracting release; quoted fields may span lines."""
    read = lambda path, name: spark.read.csv(path, header=True, schema=schemas[name], multiLine=True, escape='"')
    return read(main, "main"), read(awards, "awards"), read(suppliers, "suppliers")


def write_table(df: DataFrame, path: str, partition_by: list[str] = (), mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def capped_export(df: DataFrame, order: list[str], n: int = 1_000_000) -> DataFrame:
    """The first n rows in a fixed order, for a serving table. ``order`` tells all rows apart.

    Rows are numbered over slices, so no task holds more than a slice of them, and the export keeps the slices.
    """
    numbered = running_over(df.withColumn("_one", F.lit(1)), [], order, {"_place": ("sum", "_one")})
    return numbered.where(F.col("_place") <= n).drop("_one", "_place")


def _execute(spark: SparkSession, url: str, properties: dict[str, str], *statements: str) -> None:
    jvm = spark.sparkContext._jvm
    own = jvm.java.util.Properties()
    for name, value in properties.items():
        own.setProperty(name, value)
    link = jvm.java.sql.DriverManager.getConnection(url, own)
    try:
        for statement in statements:
            link.createStatement().execute(statement)
    finally:
        link.close()


def _tables(spark: SparkSession, url: str, properties: dict[str, str]) -> set[str]:
    jvm = spark.sparkContext._jvm
    own = jvm.java.util.Properties()
    for name, value in properties.items():
        own.setProperty(name, value)
    link = jvm.java.sql.DriverManager.getConnection(url, own)
    try:
        found, out = link.getMetaData().getTables(None, None, None, None), set()
        while found.next():
            out.add(found.getString("TABLE_NAME").upper())
        return out
    finally:
        link.close()


def write_jdbc(df: DataFrame, url: str, name: str, properties: dict[str, str], batch: int = 100_000, writers: int = 8) -> int:
    """Replace a serving table: ``writers`` tasks write a staging table in chunks, which takes the name once all rows are there.

    Readers see the old rows or the new, never a part. A run that fails leaves the old table; the next drops what it left.
    Returns the rows written.
    """
    spark = df.sparkSession
    new, old = f"{name}_NEW", f"{name}_OLD"
    held = _tables(spark, url, properties)
    _execute(spark, url, properties, *[f"DROP TABLE {t}" for t in (new, old) if t.upper() in held and not (t == old and name.upper() not in held)])
    rows = materialize(df, "export")
    rows.repartition(writers).write.mode("append").option("batchsize", batch).jdbc(url, new, properties=properties)
    count, there = rows.count(), spark.read.jdbc(url, new, properties=properties).count()
    if count != there:
        raise RuntimeError(f"{there} of {count} rows are in {new}")
    swap = ([f"RENAME TABLE {name} TO {old}"] if name.upper() in held else []) + [f"RENAME TABLE {new} TO {name}"]
    _execute(spark, url, properties, *swap, *([f"DROP TABLE {old}"] if name.upper() in held else []))
    discard(rows)
    return count


def write_splits(df: DataFrame, path: str) -> None:
    """One write, a folder a split, with the row keys."""
    write_table(df.where(F.col("split").isNotNull()), path, ["split"])


def read_json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and broken lines are skipped, a missing endpoint or company is 'Unknown'."""
    log = spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    return log.withColumns({c: F.coalesce(c, F.lit("Unknown")) for c in ("endpoint", "company_id") if c in log.columns})


def dataset_metadata(df: DataFrame, features: list[str], country: str, year: str = "publish_year", label: str = "did_win") -> DataFrame:
    """One row: totals, classes, year range, countries and features as JSON."""
    one = df.agg(
        F.count("*").alias("total"), F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.array_sort(F.collect_set(country)).alias("countries")
    )
    return one.select(F.to_json(F.struct("*", F.array(*[F.lit(f) for f in features]).alias("features"))).alias("metadata"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row a text file: name, type and whole text, and the columns of partition folders."""
    raw = spark.read.text(path, wholetext=True).select("*", F.col("_metadata.file_name").alias("name"))
    kept = [c for c in raw.columns if c not in ("value", "name")]
    return raw.select("name", F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1)).alias("type"), F.coalesce("value", F.lit("")).alias("text"), *kept)


def stream_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.coalesce("value", F.lit("")).alias("text"))


def tail_events(events: DataFrame, after: int, seq: str = "seq") -> DataFrame:
    return events.where(F.col(seq) > after).orderBy(seq)


def replace_partition(df: DataFrame, path: str, owner: str) -> None:
    """Delete and insert the owners that ``df`` holds; others stay. The option belongs to this write only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(owner).parquet(path)


def changed_since(files: DataFrame, since) -> DataFrame:
    """Changes after the cursor, folders left out, trashed files as removals; the next cursor is the greatest ``modified``."""
    fresh = files.where((F.col("modified") > F.lit(since)) & ~F.coalesce("is_folder", F.lit(False)))
    return fresh.withColumn("change", F.when(F.coalesce("trashed", F.lit(False)), "removed").otherwise("upserted"))
