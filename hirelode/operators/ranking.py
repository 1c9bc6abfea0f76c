"""Orders, top-k reports and samples of a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import fields as V
from ..functions import text as T
from ..session import cut_lineage, with_global_rank
from .filters import global_filter_flag
from .shared_words import heavy_words, meeting_masks, split_words


def feed_order(by: str) -> list[Column]:
    lead = {
        "match": F.coalesce("score", F.lit(0)),
        "recent": F.coalesce(F.col("first_seen").cast("timestamp"), F.col("posted_date").cast("timestamp")),
        "salary": V.parse_salary("salary_text")["low"],
    }[by]
    return [lead.desc_nulls_last(), F.col("id").asc()]


def sort_feed(df: DataFrame, by: str = "match") -> DataFrame:
    """O1"""
    return df.orderBy(*feed_order(by))


def location_tier(tiers: list[list[str]]) -> Column:
    """Index of the first tier naming the posting's place; unplaced postings are searched as a whole."""
    e = F.lit("")
    loc = F.lower(F.coalesce("location", e))
    placed = ~loc.isin(rules.MISSING_MARKERS)
    near = F.trim(F.concat_ws(" ", loc, F.lower(F.coalesce("title", e))))
    wide = F.concat_ws(" ", near, F.lower(F.coalesce("company", e)), F.lower(F.coalesce("description", e)))
    out = F.lit(len(tiers))
    for i, names in reversed(list(enumerate(tiers))):
        words = [n.lower().strip() for n in names if n and n.strip()]
        hit = T.has_any(near, words) | (~placed & T.has_any(wide, words))
        out = F.when(hit, F.lit(i)).otherwise(out)
    return out


def priority_sort(df: DataFrame, tiers: list[list[str]], filters: dict[str, list[str]] | None = None) -> DataFrame:
    """O2: by score band of five, place tier, score, then first seen."""
    score = F.coalesce("score", F.lit(0))
    kept = df.where(global_filter_flag(filters or {})).withColumn("location_priority", location_tier(tiers))
    return kept.orderBy(F.floor(score / 5).desc(), "location_priority", score.desc(), "first_seen", "id")


def affinity_boost(stats: DataFrame) -> DataFrame:
    """Boost per company from its application history."""
    total, success = F.col("total_applications"), F.col("success_rate")
    return stats.withColumn("boost", (
        F.when(total == 0, 0.0).when(success >= 0.5, 35.0).when(success > 0.0, 20.0)
        .when(F.col("rejected") == total, -5.0).otherwise(10.0)))


def affinity_sort(df: DataFrame, stats: DataFrame) -> DataFrame:
    """O3: score plus company boost."""
    boosts = affinity_boost(stats).select("company", "boost")
    joined = df.join(boosts, "company", "left").withColumn(
        "affinity", F.coalesce("score", F.lit(rules.DEFAULT_SCORE)) + F.coalesce("boost", F.lit(0.0))).drop("boost")
    return joined.orderBy(F.desc("affinity"), F.coalesce("score", F.lit(rules.DEFAULT_SCORE)).desc(), "company", "id")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """Best n rows of a unique order (each task keeps n)."""
    return df.orderBy(*order).limit(n)


def top_feed(df: DataFrame, n: int = 20) -> DataFrame:
    return top(df, n, *feed_order("match"))


def refine_candidates(df: DataFrame, cap: int = 150, bar: int = 50) -> DataFrame:
    """Best unverified scores."""
    unverified = F.col("score").isNotNull() & ~F.coalesce(F.col("tier").isin(rules.VERIFIED_TIERS), F.lit(False))
    return top(df.where(unverified & (F.col("score") >= bar)), cap, F.desc("score"), F.col("id"))


def select_examples(postings: DataFrame, feedback: DataFrame, per_action: int = 2, minimum: int = 5) -> DataFrame:
    """The best liked and disliked examples per posting title, with rendered lines.

    Postings fold to their distinct titles.  Score = shared words + 0.1 per
    log position, so besides the items sharing a word only the latest few of
    each action can win.  ``feedback``: feedback_id, action, job_title,
    company, reason, job_match_score.
    """
    logged = with_global_rank(feedback, F.col("feedback_id"), name="__pos")
    enough = feedback.agg(F.count(F.lit(1)) >= minimum).scalar()
    # equal texts share their words: only the latest two of each wording can win
    latest = Window.partitionBy("action", "job_title", "reason").orderBy(F.desc("__pos"))
    logged = cut_lineage(logged.where(F.col("action").isin("yes", "no")).withColumn("__n", F.row_number().over(latest)).where(F.col("__n") <= per_action).drop("__n"))
    items = logged.select("feedback_id", "action", "__pos", T.tokens(F.concat_ws(" ", "job_title", "reason")).alias("words"))
    titles = postings.select("title").distinct().withColumn("words", T.tokens("title"))
    heavy = heavy_words(items)
    # a title or item without any word still has a row, with an empty mask
    title_masks, title_light = split_words(titles, heavy, "title")
    item_masks, item_light = split_words(items, heavy, "feedback_id")
    no_words = F.array().cast("array<string>")
    title_masks = cut_lineage(titles.select("title").join(title_masks, "title", "left").withColumn("mask", F.coalesce("mask", no_words)))
    item_masks = cut_lineage(items.select("feedback_id", "action", "__pos").join(item_masks, "feedback_id", "left").withColumn("mask", F.coalesce("mask", no_words)))
    light = cut_lineage(title_light.join(item_light, "word").groupBy("title", "feedback_id").agg(F.count(F.lit(1)).alias("light")))
    # of items with the same frequent words only the latest can win, and of them the best for each set of frequent words of a title
    newest_of_mask = Window.partitionBy("action", "mask").orderBy(F.desc("__pos"))
    leaders = item_masks.withColumn("__n", F.row_number().over(newest_of_mask)).where(F.col("__n") <= per_action).select(
        "action", F.col("mask").alias("other"), "__pos", "feedback_id")
    best_of_mask = Window.partitionBy("mask", "action").orderBy(F.desc(F.round(F.col("shared") + F.col("__pos") * 0.1, 6)), "feedback_id")
    by_mask = meeting_masks(title_masks, item_masks).join(leaders, "other").withColumn("__n", F.row_number().over(best_of_mask)).where(F.col("__n") <= per_action)
    newest = Window.partitionBy("action").orderBy(F.desc("__pos"))
    last = item_masks.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= per_action).agg(F.collect_list("feedback_id").alias("ids")).scalar()
    pairs = light.select("title", "feedback_id").unionByName(
        title_masks.join(by_mask.select("mask", "feedback_id"), "mask").select("title", "feedback_id")).unionByName(
        title_masks.select("title", F.explode(last).alias("feedback_id"))).distinct()
    frequent = F.size(F.array_intersect("mask", "other"))
    scored = pairs.join(title_masks, "title").join(item_masks.select("feedback_id", F.col("mask").alias("other")), "feedback_id") \
        .join(light, ["title", "feedback_id"], "left").join(logged, "feedback_id").withColumn(
        "example_score", frequent + F.coalesce("light", F.lit(0)) + (F.col("__pos") - 1) * 0.1)
    w = Window.partitionBy("title", "action").orderBy(F.desc(F.round("example_score", 6)), "feedback_id")
    label = F.when(F.col("action") == "yes", F.lit("approved")).otherwise(F.lit("rejected"))
    best = scored.withColumn("example_rank", F.row_number().over(w)).where((F.col("example_rank") <= per_action) & enough)
    return best.select(
        "title", "action", "example_rank", "feedback_id", "example_score",
        F.concat(F.lit("- User "), label, F.lit(' "'), "job_title", F.lit('" at '), F.col("company"), F.lit(': "'), "reason",
                 F.lit('" (Match score was '), F.col("job_match_score").cast("string"), F.lit("%)")).alias("line"))


def near_misses(watch: DataFrame, n: int = 15) -> DataFrame:
    """Hiring in India, never for freshers."""
    return top(watch.where("coalesce(best_fresher_seen, 0) = 0 AND last_india_jobs > 0"), n, F.desc("last_india_jobs"), F.col("name"))


def long_parked(watch: DataFrame, n: int = 10) -> DataFrame:
    """O10"""
    return top(watch, n, F.desc("checks"), F.col("name"))


def recheck_batch(watch: DataFrame, n: int = 40) -> DataFrame:
    """The longest unchecked."""
    return top(watch, n, F.col("last_checked").asc_nulls_first(), F.col("name"))


def admit(verified: DataFrame, existing: DataFrame, cap: int, order: str) -> DataFrame:
    """Of the verified companies new by name and by id the first ``cap``; the first of each id wins."""
    named = verified.withColumns({"company_id": T.dash_slug("name"), "__n": F.lower(F.trim("name"))})
    new = named.where("company_id <> ''") \
        .join(existing.select(F.lower(F.trim("name")).alias("__n")).distinct(), "__n", "left_anti") \
        .join(existing.select(F.col("id").alias("company_id")).distinct(), "company_id", "left_anti")
    from .sets import first_by
    # equal names give equal ids, so one pass by id settles both
    return first_by(top(new, cap, F.col(order)), ["company_id"], [order]).drop("__n")


def sort_verified_first(df: DataFrame) -> DataFrame:
    """O13"""
    paid = F.coalesce(F.col("tier").isin(rules.VERIFIED_TIERS), F.lit(False)) & F.col("score").isNotNull()
    return df.orderBy(paid.desc(), F.coalesce("score", F.lit(0)).desc(), "id")
