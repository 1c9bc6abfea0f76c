"""Ranking quality of scored postings against human labels A (best) to E (reject)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RELEVANT = ["A", "B"]
GAINS = {"A": 3.0, "B": 2.0, "C": 1.0}     # fixed values


def _gain():
    out = F.lit(0.0)
    for label, gain in GAINS.items():
        out = F.when(F.col("label") == label, F.lit(gain)).otherwise(out)
    return out


def top_ranked(df: DataFrame, k: int, query: str) -> DataFrame:
    """First k postings of every query by score; each task keeps only its own k."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), "id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def precision_at_k(df: DataFrame, k: int, query: str = "query") -> DataFrame:
    """E1"""
    return top_ranked(df, k, query).groupBy(query).agg(
        F.avg(F.col("label").isin(RELEVANT).cast("double")).alias("precision"))


def reciprocal_rank(df: DataFrame, query: str = "query") -> DataFrame:
    """E2 per query: 1 / rank of the first relevant posting, as a count of those ranked above it."""
    place = F.struct(-F.col("score"), F.col("id"))
    best = df.where(F.col("label").isin(RELEVANT)).groupBy(query).agg(F.min(place).alias("__best"))
    above = df.join(best, query, "left").groupBy(query).agg(
        F.count_if(place < F.col("__best")).alias("above"), F.max(F.col("__best").isNotNull()).alias("found"))
    return above.select(query, F.when(F.col("found"), 1.0 / (F.col("above") + 1)).otherwise(F.lit(0.0)).alias("reciprocal_rank"))


def mrr(df: DataFrame, query: str = "query") -> DataFrame:
    """E2"""
    return reciprocal_rank(df, query).agg(F.avg("reciprocal_rank").alias("mrr"))


def ndcg_at_k(df: DataFrame, k: int, query: str = "query", ideal: str = "returned") -> DataFrame:
    """Gain at k over the best order of the returned k ('returned') or of everything ('all')."""
    graded = df.withColumn("gain", _gain())
    first = top_ranked(graded, k, query)
    pool = first if ideal == "returned" else graded
    w = Window.partitionBy(query).orderBy(F.desc("gain"), "id")
    best = pool.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    got = first.groupBy(query).agg(F.sum(F.col("gain") / F.log2(F.col("rank") + F.lit(1.0))).alias("dcg"))
    most = best.groupBy(query).agg(F.sum(F.col("gain") / F.log2(F.col("__r") + F.lit(1.0))).alias("idcg"))
    return got.join(most, query).select(query, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(F.lit(0.0)).alias("ndcg"))


def label_rates(df: DataFrame) -> DataFrame:
    """Rejects that score 50 or more, and best ones that score 70 or more."""
    def share(label: str, bar: int):
        n = F.count_if(F.col("label") == label)
        return F.when(n > 0, F.count_if((F.col("label") == label) & (F.col("score") >= bar)) / n).otherwise(F.lit(0.0))

    return df.agg(share("E", 50).alias("false_positive_rate"), share("A", 70).alias("retention"))


def feed_quality(feed: DataFrame, top: int = 50) -> DataFrame:
    """E5: senior titles in the feed and in its head. ``feed``: rank, title, score."""
    from ..functions.skills import seniority
    senior = seniority("title", F.lit(""))["senior"]
    marked = feed.withColumn("senior", senior)
    # ordered when no score exceeds the lowest one of an earlier rank: compared per block of ranks
    block = F.floor((F.col("rank") - 1) / 1000)
    inside = Window.partitionBy("__b").orderBy("rank")
    steps = marked.withColumn("__b", block).withColumn("__prev", F.lag("score").over(inside))
    edges = steps.groupBy("__b").agg(
        F.count_if(F.col("__prev") < F.col("score")).alias("broken"), F.min_by("score", "rank").alias("first"),
        F.max_by("score", "rank").alias("last"))
    joints = edges.alias("a").join(edges.alias("b"), F.col("b.__b") == F.col("a.__b") + 1, "left").agg(
        (F.sum("a.broken") + F.count_if(F.col("a.last") < F.col("b.first"))).alias("n"))
    return marked.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("senior").alias("senior"),
        F.count_if(F.col("senior") & (F.col("rank") <= top)).alias("senior_in_top"),
    ).withColumn("out_of_order", F.coalesce(joints.scalar(), F.lit(0)))
