"""De-duplication: exact clusters, near-duplicate clusters, and their merge."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, set_aside, shuffles_go_early
from .filters import valid_only, validity
from .identity import normalize_postings
from .near_dup import first_fit, fold, key_pairs
from .texts import TEXT, bring_texts, leave_texts


def text_length(df: DataFrame) -> Column:
    """Letters of the description; rows that left it behind carry the number."""
    return F.col("description_length") if "description_length" in df.columns else F.length(F.coalesce("description", F.lit("")))


def without_text(df: DataFrame) -> DataFrame:
    """Rows that carry the length of their description instead of it: enough to merge them."""
    return df.withColumn("description_length", text_length(df)).drop("description")


_MERGED = ("first_seen", "last_seen", "sources", "source_ids", "cluster_size")


def merge_cluster(df: DataFrame, cluster: str = "id", aside: bool = False) -> DataFrame:
    """D3: one row per cluster.

    Base row by parse confidence, description length, earliest first_seen, id.
    Dates widen; sources keep first-appearance order and source ids the last
    value.  Rows first fold per (cluster, sources): only one row per kind of
    provenance reaches the second step, so a cluster of any size stays small.
    Descriptions stay out of it and join back to the rows that remain.  With ``aside``
    the folded rows are written in between, so that one shuffle is gone before the next.
    """
    if TEXT in df.columns:
        rows, texts = leave_texts(df)
        return bring_texts(merge_cluster(rows, cluster, aside), texts, [cluster, *[c for c in df.columns if c not in _MERGED and c != cluster]])
    landed = F.col("native_id") if "native_id" in df.columns else F.col("id")
    first, posted = F.col("first_seen").cast("timestamp"), F.col("posted_date").cast("timestamp")
    last = F.coalesce(F.col("last_seen").cast("timestamp"), first) if "last_seen" in df.columns else first
    weight = F.col("cluster_size") if "cluster_size" in df.columns else F.lit(1)
    kept = [c for c in df.columns if c not in _MERGED and c != cluster]
    order = F.struct(F.coalesce(F.unix_micros(F.coalesce(first, posted)), F.lit(1 << 62)), F.col("id"), landed)
    small_first = -landed if "native_id" in df.columns else F.translate(F.col("id"), "0123456789abcdef", "fedcba9876543210")
    rank = F.struct(
        F.coalesce("parse_confidence", F.lit(0.5)), text_length(df),
        F.coalesce(-F.unix_micros(first), F.lit(-(1 << 62))), small_first)
    folded = df.withColumns({
        "__order": order, "__rank": rank, "__keys": F.array_sort(F.map_keys("source_ids"))}).groupBy(
        F.col(cluster).alias("__cluster"), "sources", "__keys").agg(
        F.max_by(F.struct(*kept), "__rank").alias("__row"), F.max("__rank").alias("__rank"),
        F.min("__order").alias("__from"), F.max("__order").alias("__to"), F.max_by("source_ids", "__order").alias("__ids"),
        F.min(F.coalesce(first, posted)).alias("__first"), F.max(last).alias("__last"), F.sum(weight).alias("__n"))
    kinds = (set_aside(folded, "folded") if aside else folded).groupBy("__cluster").agg(
        F.max_by("__row", "__rank").alias("__row"), F.min("__first").alias("first_seen"), F.max("__last").alias("last_seen"),
        F.array_sort(F.collect_list(F.struct("__from", "sources"))).alias("__sources"),
        F.array_sort(F.collect_list(F.struct("__to", F.map_entries("__ids").alias("ids")))).alias("__maps"),
        F.sum("__n").alias("cluster_size"))
    # later maps override earlier ones: of the entries of a key, the last one stays
    entries = F.flatten(F.transform("__maps", lambda m: m["ids"]))
    names = F.array_sort(F.array_distinct(F.transform(entries, lambda e: e["key"])))
    ids = F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]))
    merged = kinds.select(
        F.col("__cluster").alias(cluster), "__row.*", "first_seen", "last_seen",
        F.array_distinct(F.flatten(F.transform("__sources", lambda x: x["sources"]))).alias("sources"), ids.alias("source_ids"), "cluster_size")
    if "canonical_url" in merged.columns:
        merged = merged.withColumn("url", F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("canonical_url")))
    return merged


def dedup_exact(normalized: DataFrame, aside: bool = False) -> DataFrame:
    """One row per canonical id."""
    return merge_cluster(normalized, aside=aside)


def near_clusters(df: DataFrame, by_letters: bool = True) -> DataFrame:
    """Adds cluster_id: the first posting of the near-duplicate cluster a row falls in."""
    keys = set_aside(fold(df))
    members = first_fit(key_pairs(keys, by_letters))
    heads = keys.select(F.col("key").alias("head"), F.col("ord.id").alias("head_id"))
    resolved = keys.select("key", F.col("ord.id").alias("own")).join(
        members.withColumnRenamed("member", "key"), "key", "left").join(heads, "head", "left") \
        .select("key", F.coalesce("head_id", "own").alias("cluster_id"))
    key = F.sha2(F.concat_ws(
        "\u0001", "normalized_company", "normalized_title", "normalized_location", F.coalesce("req_id", F.lit(""))), 256)
    return df.withColumn("key", key).join(resolved, "key").drop("key")


def dedup_near(df: DataFrame) -> DataFrame:
    """Greedy first-fit clusters of near-duplicates, merged. Ids are unique.

    Rows are clustered and merged without their descriptions, which join back by their marks.
    """
    rows, texts = leave_texts(df)
    merged = merge_cluster(near_clusters(set_aside(rows)), "cluster_id").drop("cluster_id")
    return bring_texts(merged, texts, df.columns)


def deduplicate(landed: DataFrame, near: bool = True) -> tuple[DataFrame, DataFrame]:
    """(unique postings, one row of counts).

    The unique postings are materialised without their descriptions: everything after
    them reads them more than once.
    """
    unique, texts, columns, metrics = deduplicate_apart(landed, near)
    return bring_texts(unique, texts, columns), metrics


def deduplicate_apart(landed: DataFrame, near: bool = True) -> tuple[DataFrame, DataFrame | None, list[str], DataFrame]:
    """D4 as (unique postings that left their descriptions, all descriptions landed, columns with them, counts)."""
    shuffles_go_early(landed.sparkSession)
    # texts leave before the rules: those look at every row, and none of them at the text
    rows, texts = leave_texts(landed)
    exact = dedup_exact(valid_only(normalize_postings(rows)), aside=True)
    unique = set_aside(dedup_near(exact) if near else exact, "unique")
    # rows that passed are the members of the clusters; only the landed total needs another look
    passed = unique.agg(F.coalesce(F.sum("cluster_size"), F.lit(0))).scalar()
    metrics = landed.agg(F.count(F.lit(1)).alias("total_raw")).withColumns({
        "total_normalized": passed, "unique_jobs": unique.agg(F.count(F.lit(1))).scalar()}) \
        .withColumn("duplicates_removed", F.col("total_raw") - F.col("unique_jobs"))
    return unique, texts, normalize_postings(landed).columns, metrics


# --- chains of kept times ----------------------------------------------------

BUCKET_TOLERANCES = 32      # width of a time bucket
FAN = 64                    # buckets folded into one on the next level
NEVER = -(1 << 62)          # nothing kept yet
LINKS = "k string, bucket long, times array<long>, ends array<long>"


def _last(times: np.ndarray, ends: np.ndarray, kept: np.ndarray, tolerance: int) -> np.ndarray:
    """The last kept time after a bucket for each last kept time before it."""
    at = np.searchsorted(times, kept + tolerance)
    return np.where(at < len(times), np.append(ends, NEVER)[at], kept)


def _openings(times: np.ndarray, ends: np.ndarray, start: int, tolerance: int) -> tuple[np.ndarray, np.ndarray]:
    """What is enough of a bucket for all that may come before: a time kept before ``start``
    lets a chain begin anywhere in the first tolerance, or else at the first time after it."""
    n = int(np.searchsorted(times, start + tolerance)) + 1
    return times[:n], ends[:n]


def _row(k: pa.Scalar, bucket: int, times: np.ndarray, ends: np.ndarray) -> pa.Table:
    longs = pa.list_(pa.int64())
    return pa.table({"k": pa.array([k.as_py()], pa.string()), "bucket": pa.array([bucket], pa.int64()), "times": pa.array([times], longs), "ends": pa.array([ends], longs)})


def _in_order(children: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    children = children.sort_by("bucket")
    return [(np.array(t, np.int64), np.array(e, np.int64)) for t, e in zip(children["times"].to_pylist(), children["ends"].to_pylist(), strict=True)]


def _bucket_links(width: int, tolerance: int):
    def links(key: tuple, group: pa.Table) -> pa.Table:
        times = np.sort(group["us"].to_numpy())
        following, ends = np.searchsorted(times, times + tolerance), times.copy()
        for i in range(len(times) - 1, -1, -1):
            if following[i] < len(times):
                ends[i] = ends[following[i]]
        bucket = key[1].as_py()
        return _row(key[0], bucket, *_openings(times, ends, bucket * width, tolerance))

    return links


def _compose(width: int, tolerance: int):
    def composed(key: tuple, group: pa.Table) -> pa.Table:
        """The buckets of a group as one."""
        number = key[1].as_py()
        start = number * FAN * width
        times, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for t, e in _in_order(group):
            ends = _last(t, e, ends, tolerance)
            if not len(times) or times[-1] < start + tolerance:
                times, ends = np.append(times, t), np.append(ends, e)
        return _row(key[0], number, *_openings(times, ends, start, tolerance))

    return composed


def _hand_down(tolerance: int):
    def handed(key: tuple, group: pa.Table) -> pa.Table:
        """The last kept time before each bucket of a group, from the one before the group."""
        group = group.sort_by("bucket")
        kept, before = np.array([group["before"][0].as_py()]), []
        for t, e in _in_order(group):
            before.append(int(kept[0]))
            kept = _last(t, e, kept, tolerance)
        return pa.table({"k": group["k"], "bucket": group["bucket"], "before": pa.array(before, pa.int64())})

    return handed


def _kept(tolerance: int):
    def keep(key: tuple, group: pa.Table) -> pa.Table:
        times, out = np.sort(group["us"].to_numpy()), []
        at = int(np.searchsorted(times, group["before"][0].as_py() + tolerance))
        while at < len(times):
            out.append(int(times[at]))
            at = int(np.searchsorted(times, times[at] + tolerance))
        return pa.table({"k": pa.array([key[0].as_py()] * len(out), pa.string()), "us": pa.array(out, pa.int64())})

    return keep


def dedup_within(df: DataFrame, keys: list[str], ts: str, seconds: float) -> DataFrame:
    """Drop entries within ``seconds`` of the last kept entry of their key.

    Whether a time is kept hangs on all times before it.  A bucket of time is a function
    from the last kept time before it to the last kept one in it, known from the chains
    that begin in its first tolerance.  Buckets of a key compose in groups of ``FAN``, level by
    level; what was kept before each group is handed down again, and every bucket then
    keeps its own times.  So a key with all the rows runs in as many tasks as it has
    buckets, and a task holds the different times of one bucket.  Rows without a time go.
    """
    tolerance = max(1, int(seconds * 1_000_000))
    width = BUCKET_TOLERANCES * tolerance
    keyed = df.withColumns({"__k": F.to_json(F.struct(*keys)), "__us": F.unix_micros(F.col(ts).cast("timestamp"))}).where("__us IS NOT NULL")
    times = cut_lineage(keyed.select(F.col("__k").alias("k"), F.col("__us").alias("us")).distinct().withColumn("bucket", F.floor(F.col("us") / width)))
    first, last = times.agg(F.min("bucket"), F.max("bucket")).first()
    if first is None:
        return df.limit(0)
    times = times.withColumn("bucket", F.col("bucket") - first)
    offset = first * width
    levels = [cut_lineage(times.withColumn("us", F.col("us") - offset).groupBy("k", "bucket").applyInArrow(_bucket_links(width, tolerance), LINKS))]

    span, wide = last - first + 1, width
    while span > 1:
        group = F.floor(F.col("bucket") / FAN)
        levels.append(cut_lineage(levels[-1].groupBy("k", group.alias("__g")).applyInArrow(_compose(wide, tolerance), LINKS)))
        span, wide = -(-span // FAN), wide * FAN
    before = levels[-1].select("k", F.col("bucket").alias("__g"), F.lit(NEVER).alias("before"))
    for level in reversed(levels[:-1]):
        children = level.withColumn("__g", F.floor(F.col("bucket") / FAN)).join(before, ["k", "__g"])
        before = cut_lineage(children.groupBy("k", "__g").applyInArrow(_hand_down(tolerance), "k string, bucket long, before long")) \
            .withColumnRenamed("bucket", "__g")
    placed = times.withColumn("us", F.col("us") - offset).join(before.withColumnRenamed("__g", "bucket"), ["k", "bucket"])
    kept = placed.groupBy("k", "bucket").applyInArrow(_kept(tolerance), "k string, us long")
    kept = kept.select(F.col("k").alias("__k"), (F.col("us") + offset).alias("__us"))
    return keyed.join(kept, ["__k", "__us"], "left_semi").select(*df.columns)
