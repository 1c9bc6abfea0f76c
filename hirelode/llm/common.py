"""Column rules and small helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelode.session import BROADCAST_ROWS, cut_lineage, scratch_path

# A word is a run of anything but space and the five ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"

SIFT = 1 << 26        # bits of a filter for keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for null and empty texts."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 when divided by 4.

    A null id counts as held out, so nothing is learned from it.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def unit_hash(*columns: Column) -> Column:
    """A reproducible number in (0, 1) from the 64-bit hash of the columns."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") + 0.5) / float(1 << 53)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored side of at most ``rows`` rows; a longer one is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def store_summary(df: DataFrame, parts: int = 8) -> DataFrame:
    """Checkpoint of a table with a row for each source or the like: a few files, whatever the shuffle partitions."""
    return cut_lineage(df.coalesce(parts))


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, removed when the driver ends; more compact than a checkpoint."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.parquet(path)


def sampled(df: DataFrame, limit: int, total: int, *keys: str) -> DataFrame:
    """At most ``limit`` of ``total`` rows, first by the hash of ``keys``.

    A hash range with about twice the rows is cut out first, so that what all tasks
    together hand on does not grow with their number.
    """
    if total > 2 * limit:
        df = df.where(unit_hash(*[F.col(k) for k in keys], F.lit("sample")) < 2.0 * limit / total)
    return df.orderBy(F.xxhash64(*keys), *keys).limit(limit)


def sift(keys: DataFrame) -> np.ndarray:
    """A fixed-size bit table of the column ``key``; false hits cost time only."""
    word = F.expr(f"shiftright(pmod(key, {SIFT}), 5)")
    # at most SIFT / 32 rows, whatever the input
    got = keys.groupBy(word.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(key, 32) AS int))")).alias("x")).toArrow()
    table = np.zeros(SIFT // 32, dtype=np.int64)
    table[got.column("w").to_numpy()] = got.column("x").to_numpy()
    return table.astype(np.uint32)


def hits(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    spot = key % SIFT
    return ((table[spot // 32] >> (spot % 32).astype(np.uint32)) & 1).astype(bool)
