"""Set operators over keyed rows: unions, first/last wins, splits, learned terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import strip
from ..session import as_of
from .texts import TEXT, bring_texts, leave_texts


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Bag union of sources whose columns may differ."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def pick_by(df: DataFrame, keys: list[str], order: Column, largest: bool) -> DataFrame:
    """One whole row per key by the smallest or largest (unique) order value.

    An aggregate, so each task first reduces its own rows: a key that holds
    much of the data never gathers in one place, as it would under a window.
    Descriptions stay out of it and join back to the rows that were picked.
    """
    pick = F.max_by if largest else F.min_by
    ordered = df.withColumn("__order", order)
    rows, texts = leave_texts(ordered) if TEXT not in keys else (ordered, None)
    row = F.struct(*[c for c in rows.columns if c != "__order"])
    picked = rows.groupBy(*keys).agg(pick(row, "__order").alias("__row")).select("__row.*")
    return bring_texts(picked, texts, df.columns)


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key."""
    return pick_by(df, keys, F.struct(*order), largest=False)


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return pick_by(df, keys, F.struct(*order), largest=True)


def union_last_wins(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both by id; the second frame wins."""
    return a.join(b.select(key), key, "left_anti").unionByName(b, allowMissingColumns=True)


def dedup_log(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First log entry per content; nulls count as equal."""
    return first_by(df, keys, order)


def tombstones(everything: DataFrame, kept: DataFrame, old: DataFrame, now,
               ttl_days: int = rules.TOMBSTONE_DAYS, key: str = "id") -> DataFrame:
    """Marks for rows dropped now, joined with unexpired older marks."""
    now = as_of(now)
    dropped = everything.select(key).distinct().join(kept.select(key).distinct(), key, "left_anti") \
        .withColumn("pruned_at", now)
    alive = old.select(key, "pruned_at").where(
        F.col("pruned_at") >= now - F.make_dt_interval(F.lit(ttl_days)))
    return alive.unionByName(dropped).groupBy(key).agg(F.max("pruned_at").alias("pruned_at"))


# fixed values: exclusion terms a rejection reason can teach
TEACHABLE_EXCLUSIONS = ["Senior", "Lead", "Manager", "Principal"]


def learn_keywords(feedback: DataFrame, roles: list[str], exclusions: list[str], longest: int | None = None) -> DataFrame:
    """New role terms from liked titles and new exclusion terms from reasons.

    ``feedback`` needs action, job_title, reason; ``longest`` leaves out longer terms when given.
    """
    phrase = strip(F.get(F.split(strip(F.regexp_replace("job_title", r"[(){}\[\]\d+]+", "")), ","), F.lit(0)))
    liked = (
        feedback.where(F.col("action") == "yes")
        .select(F.lit("target_role").alias("filter"), phrase.alias("term"))
        .where((F.col("term") != "") & (F.lit(True) if longest is None else F.length("term") <= longest) & ~F.col("term").isin(roles or [""])))
    words = [w for w in TEACHABLE_EXCLUSIONS if w not in exclusions]
    reason = F.upper(F.coalesce("reason", F.lit("")))
    named = F.array_compact(F.array(
        *[F.when(reason.contains(w.upper()), F.lit(w)) for w in words], F.lit(None).cast("string")))
    disliked = feedback.where(F.col("action") == "no").select(
        F.lit("exclude_keywords").alias("filter"), F.explode(named).alias("term"))
    return liked.unionByName(disliked).groupBy("filter", "term").agg(F.count(F.lit(1)).alias("mentions"))
