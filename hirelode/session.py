"""Session helpers: checkpoint folder, cutting lineage, ranking without one big task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Most rows of a side that is broadcast by hint; the caller counts it first, and joins by a shuffle above this.
BROADCAST_ROWS = 100_000
# Bytes of rows after which a batch goes to a Python worker.
BATCH_BYTES = 2 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session
    without that setting (tests) gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if named:
        if current is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages survive the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def set_aside(df: DataFrame, name: str = "rows") -> DataFrame:
    """Like cut_lineage, for tables of many rows: packed by columns, and later steps read only the columns they need.

    A checkpoint holds whole rows as they are in memory.  Kinds of values that the files
    do not know are left to it.
    """
    if any(word in df.schema.json() for word in ('"void"', '"interval"', '"variant"')):
        return cut_lineage(df)
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """From here on the session hands rows to Python in small batches, by bytes.

    Batches are counted in rows otherwise: 10,000 whole texts are tens of megabytes, held on
    both sides, and the workers that stay for later tasks keep that memory.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shuffles_go_early(spark: SparkSession) -> None:
    """From here on the shuffle files of an action go when it ends.

    Otherwise they stay until the driver happens to collect its garbage, and the steps of a
    long job, each with a checkpoint behind it, add up on the executors' disks.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)


def as_of(ts) -> Column:
    """The caller's 'now' as a timestamp column; never the wall clock."""
    return ts if isinstance(ts, Column) else F.lit(ts).cast("timestamp")


def with_global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """1..n over the whole frame in the given (unique) order.

    A window without PARTITION BY would pull every row into one task.  Here
    rows are range-partitioned by the order, numbered inside their partition,
    and shifted by the sizes of the partitions before them (one small row per
    partition).
    """
    placed = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("__row_pos", F.monotonically_increasing_id()))
    part = F.shiftright("__row_pos", 33)
    sizes = placed.groupBy(part.alias("__row_part")).agg(F.count(F.lit(1)).alias("__n"))
    # one row for each partition: its running sum needs no shuffle of the data
    order = Window.orderBy("__row_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__row_part", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__before"))
    # one row per partition of the frame: bounded by the partition count
    return (
        placed.withColumn("__row_part", part)
        .join(F.broadcast(before), "__row_part")
        .withColumn(name, F.col("__before") + F.col("__row_pos").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        .drop("__row_pos", "__row_part", "__before"))
