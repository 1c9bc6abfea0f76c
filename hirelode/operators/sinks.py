"""Writers and merges that publish new versions of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules
from ..session import as_of
from ..streaming.ledger import Ledger
from .texts import MARK, TEXT, TEXTS, all_texts, bring_texts, leave_texts


FILE_BYTES = 256 << 20      # of values, before encoding, that one file of the store takes


def _row_bytes(df: DataFrame) -> Column:
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) if kind in ("string", "binary") else F.lit(8) for c, kind in df.dtypes]
    return sum(sizes[1:], sizes[0]).cast("long")


def write_store(df: DataFrame, path: str, day: str | None = "posted_date", file_bytes: int = FILE_BYTES) -> None:
    """K1: replace the partitions present in the frame; the input must not read the same path.

    The bytes of each month are measured first (one row a month), and a month gets as many
    files as they ask for.  Descriptions go to a table of their own beside it, each once
    (``read_written`` brings them back).
    """
    if TEXT in df.columns:
        rows, texts = leave_texts(df)
        beside = _texts_beside(path)
        known = _stored_texts(df.sparkSession, path)
        # before the rows, so that no row is ever without its text
        (texts if known is None else texts.join(known.select("__mark"), "__mark", "left_anti")).write.mode("append").parquet(beside)
        write_store(rows, path, day, file_bytes)
        return
    if not (day and day in df.columns):
        df.write.mode("overwrite").parquet(path)
        return
    dated = df.withColumn("posted_month", F.coalesce(F.date_format(F.col(day).cast("timestamp"), "yyyy-MM"), F.lit("unknown")))
    months = dated.groupBy("posted_month").agg(F.sum(_row_bytes(df)).alias("b")).orderBy("posted_month").collect()
    plan, files = [], 0
    for r in months:
        own = max(1, -(-r["b"] // file_bytes))
        plan += [F.lit(r["posted_month"]), F.struct(F.lit(files).alias("first"), F.lit(own).alias("own"))]
        files += own
    if files:
        # one task for each planned file
        spread = [c for c in ("id", "native_id") if c in df.columns] or [day]
        place = F.element_at(F.create_map(*plan), F.col("posted_month"))
        dated = dated.repartitionById(files, (place["first"] + F.pmod(F.xxhash64(*spread), place["own"])).cast("int"))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("posted_month").parquet(path)


def _texts_beside(path: str) -> str:
    return f"{path.rstrip('/')}-texts"


def _stored_texts(spark: SparkSession, path: str) -> DataFrame | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(_texts_beside(path))
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(TEXTS).parquet(_texts_beside(path)) if there else None


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """K1: a written store with its descriptions."""
    rows, texts = spark.read.parquet(path), _stored_texts(spark, path)
    return bring_texts(rows, all_texts(texts)) if MARK in rows.columns and texts is not None else rows


# --- logs --------------------------------------------------------------------

def _generation(ledger: Ledger) -> str:
    return f"{ledger.root}/log/version={ledger.version() or 0}"


def append_log(df: DataFrame, path: str) -> None:
    """K2: append to the log's present generation. A log has one writer at a time."""
    df.write.mode("append").parquet(_generation(Ledger(df.sparkSession, path)))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(_generation(Ledger(spark, path)))


def compact_log(spark: SparkSession, path: str, retain: Callable[[DataFrame], DataFrame]) -> None:
    """K2: write what ``retain`` keeps of the log as its next generation, then swap.

    Readers see the old generation until the new one is whole; a compaction that fails
    leaves the log as it was.  The old generation stays for readers that are still at it.
    """
    ledger = Ledger(spark, path)
    after = (ledger.version() or 0) + 1
    ledger.write("log", after, retain(read_log(spark, path)))
    ledger.commit(after, ["log"])


def retain_newest(df: DataFrame, n: int, ts: str, tie: str) -> DataFrame:
    """K2: newest n entries (a top-k: each task keeps n)."""
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def retain_days(df: DataFrame, days: int, ts: str, now) -> DataFrame:
    return df.where(F.col(ts) >= as_of(now) - F.make_dt_interval(F.lit(days)))


def _paid(tier: Column) -> Column:
    return F.coalesce(tier.isin(rules.VERIFIED_TIERS), F.lit(False))


MATCH = ["score", "tier", "profile_version"]


def merge_store(store: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """K3: incoming rows win, but a stored match is never lost to a missing or a lesser one."""
    columns = store.columns
    # plain columns and not whole rows meet, so what nobody reads stays out of the join
    i = incoming.select(F.col(key), F.lit(True).alias("__i"), *[F.col(c).alias(f"__i_{c}") for c in columns])
    s = store.select(F.col(key), F.lit(True).alias("__s"), *[F.col(c).alias(f"__s_{c}") for c in columns])
    both = s.join(i, key, "full")
    stored, new = F.col("__s_score").isNotNull(), F.col("__i_score").isNotNull()
    keep = F.col("__i").isNull() | (F.col("__s").isNotNull() & stored & (~new | (_paid(F.col("__s_tier")) & ~_paid(F.col("__i_tier")))))
    return both.withColumn("__keep", keep).select(*[
        F.when(F.col("__keep") if c in MATCH else F.col("__i").isNull(), F.col(f"__s_{c}")).otherwise(F.col(f"__i_{c}")).alias(c)
        for c in columns])


def merge_companies(base: DataFrame, updates: DataFrame, key: str = "company_id") -> DataFrame:
    """K4: updates plus every base row they do not touch."""
    return updates.unionByName(base.join(updates.select(key), key, "left_anti"), allowMissingColumns=True)


def merge_enrichment(store: DataFrame, enriched: DataFrame, key: str = "id") -> DataFrame:
    """K5: new descriptions; a match made on the old text goes unless it was verified."""
    new = enriched.select(key, F.col("description").alias("__d"))
    joined = store.join(new, key, "left")
    drop = F.col("__d").isNotNull() & ~_paid(F.col("tier"))
    out = {c: F.when(~drop, F.col(c)) for c in MATCH if c in store.columns}
    return joined.withColumns({**out, "description": F.coalesce("__d", "description")}).drop("__d")


def merge_scores(store: DataFrame, scored: DataFrame, key: str = "id") -> DataFrame:
    """K5: our scores where the store has none, or where ours is verified and its is not."""
    ours = scored.select(key, *[F.col(c).alias(f"__{c}") for c in MATCH])
    joined = store.join(ours, key, "left")
    take = F.col("__score").isNotNull() & (F.col("score").isNull() | (_paid(F.col("__tier")) & ~_paid(F.col("tier"))))
    return joined.withColumn("__take", take).withColumns({
        c: F.when(F.col("__take"), F.col(f"__{c}")).otherwise(F.col(c)) for c in MATCH}).drop("__take", *[f"__{c}" for c in MATCH])


def export_bundle(tables: dict[str, DataFrame], path: str) -> None:
    """K6: one folder of gzipped JSON lines per table.

    Rows that share a description repeat it in full, and Spark's JSON reader unpacks by the files' names.
    """
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}", compression="gzip")


def snapshot(df: DataFrame, path: str, name: str) -> None:
    """K7: a dated copy next to the earlier ones; the same name again replaces its copy."""
    df.withColumn("snapshot", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot").parquet(path)


def write_curated(df: DataFrame, meta: DataFrame, path: str) -> None:
    """K8: the curated postings and one row on how they were made."""
    df.write.mode("overwrite").parquet(f"{path}/postings")
    meta.write.mode("overwrite").parquet(f"{path}/meta")
