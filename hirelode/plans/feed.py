"""The ranked feed: one plan from landed postings to feed, pending rows and funnel."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import fields as V
from ..operators import filters as P
from ..operators import stats as R
from ..operators.dedup import deduplicate_apart
from ..operators.ranking import feed_order
from ..operators.scoring import evidence_cap
from ..operators.texts import bring_texts


@dataclass(frozen=True)
class FeedConfig:
    """What a candidate asks for."""

    now: str
    roles: list[str] = field(default_factory=list)
    locations: list[str] = field(default_factory=list)
    experience: list[str] = field(default_factory=list)
    exclusions: list[str] | None = None
    hours: float = rules.RETENTION_HOURS
    min_score: int = 0
    sort_by: str = "match"
    profile_version: str | None = None
    near_duplicates: bool = True


@dataclass
class Feed:
    """``flagged`` holds every unique posting with the first stage that removed it."""

    flagged: DataFrame
    metrics: DataFrame
    sort_by: str

    def feed(self) -> DataFrame:
        return self.flagged.where("first_failed IS NULL").drop("first_failed").orderBy(*feed_order(self.sort_by))

    def pending(self) -> DataFrame:
        return self.flagged.where("first_failed = 'awaiting_scoring'").drop("first_failed")

    def breakdown(self) -> DataFrame:
        """A1: what each stage removed; the parts add up to everything landed."""
        m = self.metrics
        return R.funnel(self.flagged).withColumns({
            "total_in_store": m.select("total_raw").scalar(),
            "dropped_invalid_at_dedup": m.select(F.col("total_raw") - F.col("total_normalized")).scalar(),
            "duplicates_merged": m.select("duplicates_removed").scalar()})


def build_feed(landed: DataFrame, config: FeedConfig, applied: DataFrame | None = None, closed: DataFrame | None = None) -> Feed:
    """Q1: flags in stage order instead of chained filters, so the funnel is one aggregate.

    ``applied``: id, status of applications; ``closed``: id of dead postings.
    """
    unique, texts, columns, metrics = deduplicate_apart(landed, near=config.near_duplicates)
    max_years = landed.sparkSession.range(1).select(V.max_user_years(
        F.array(*[F.lit(x) for x in config.experience]))).first()[0] if config.experience else None

    def flag(df: DataFrame, ids: DataFrame | None, name: str) -> DataFrame:
        if ids is None:
            return df.withColumn(name, F.lit(False))
        marks = ids.select("id").distinct().withColumn(name, F.lit(True))
        return df.join(marks, "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))

    hidden = applied.where("status <> 'archived'") if applied is not None else None
    joined = P.validity(flag(flag(unique, closed, "__closed"), hidden, "__applied"))
    # the marks by id are set on rows without descriptions, which come last
    if applied is not None or closed is not None:
        columns = ["id", *[c for c in columns if c != "id"]]
    capped = evidence_cap(bring_texts(joined, texts, columns)).withColumn("match_state", P.match_state(config.profile_version))
    capped = P.stated_years(capped, "__years") if max_years is not None else capped
    recent = P.is_recent(capped, config.hours, config.now)
    gone = F.col("__closed") | ~F.col("is_valid")
    anything_recent = joined.where(~gone).agg(F.max(P.is_recent(joined, config.hours, config.now))).scalar()
    stale = ~recent & F.coalesce(anything_recent, F.lit(False))
    first_failed = (
        F.when(gone, F.lit("closed"))
        .when(stale, F.lit("stale"))
        .when(~P.role_flag(config.roles), F.lit("role_mismatch"))
        .when(~P.location_flag(config.locations), F.lit("location"))
        .when(~P.experience_flag(max_years, "__years"), F.lit("experience"))
        .when(~P.exclusion_flag(config.exclusions), F.lit("seniority_keywords"))
        .when(F.col("match_state") != "ready", F.when(F.col("__applied"), F.lit("already_applied")).otherwise(F.lit("awaiting_scoring")))
        .when(~P.score_bar_flag(config.min_score), F.lit("below_min_score"))
        .when(F.col("__applied"), F.lit("already_applied")))
    flagged = capped.withColumn("first_failed", first_failed).drop("__closed", "__applied", "__years", "is_valid", "reasons")
    return Feed(flagged, metrics, config.sort_by)
