"""Session helpers shared by every module: tables, shared scratch, materialisation."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the given Parquet tables (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PARTITIONS, ADVISORY, SPLIT = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"
PARTITION_BYTES = 8 << 20  # of Parquet; decoded, hashed or sorted some twenty times as much


def small_partitions(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Let shuffles of this session have a partition for each ``PARTITION_BYTES`` of the tables' files, and no task read more than
    that of a file or twice that of a shuffle, so that what a task sorts or aggregates before a shuffle does not grow with the tables.
    Stricter settings of the session's own stay."""
    context, conf = spark.sparkContext, spark.conf
    size = 0
    for name in names:
        path = context._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        size += path.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    wanted = -(-size // PARTITION_BYTES)
    if wanted > int(conf.get(PARTITIONS)):
        conf.set(PARTITIONS, str(wanted))
    for name, most in ((ADVISORY, 2 * PARTITION_BYTES), (SPLIT, PARTITION_BYTES)):
        if context._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(name)) > most:
            conf.set(name, f"{most}b")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (a local test)
    a folder of our own is created and set.
    """
    path = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set(CHECKPOINT_DIR, path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    The written table outlives the executors that made it, so a lost executor costs only the tasks
    that were running on it.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps whose results are written: it does so once the driver has collected its garbage.

    A plan is only let go of some time after its last job, so a first collection often comes too early.
    """
    for _ in range(3):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame, most: int = 2 << 20) -> DataFrame:
    """Let Arrow batches hold at most about so many bytes in this session: rows with whole texts are wide, and a
    Python worker's memory follows the batch. A stricter setting of the session's own stays."""
    conf = df.sparkSession.conf
    now = conf.get(BATCH_BYTES, None)
    if now is None or not now.isdigit() or int(now) > most:
        conf.set(BATCH_BYTES, str(most))
    return df
