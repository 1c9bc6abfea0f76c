"""Scores of postings against a candidate profile, and decisions built on them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import fields as V
from ..functions import skills as S
from ..session import as_of
from .filters import is_verified
from .texts import once_each
from .vectors import distance_to_score


@dataclass(frozen=True)
class Profile:
    """What a posting is scored against."""

    skills: list[str] = field(default_factory=list)
    years: int | None = None
    version: str = "v1"


def _clamp(col: Column, low: int, high: int) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), col))


def category_cap(score: Column, category: Column) -> Column:
    """Ceilings of roles outside software."""
    return F.when(category.isin("non_technical", "non_software_engineering"), F.least(F.lit(25), score)) \
        .when(category.isin("support", "testing_qa"), F.least(F.lit(45), score)).otherwise(score)


def _seniority_cap(score: Column, years: int) -> Column:
    if years > 2:
        return score
    return F.when(F.col("is_executive"), F.least(F.lit(35), score)) \
        .when(F.col("is_senior"), F.least(F.lit(60), score)).otherwise(score)


def components(df: DataFrame, profile: Profile, texts: DataFrame | None = None) -> DataFrame:
    """Skill, role and experience parts; the costly text work is done once for all rows with
    the same title and description.  ``texts``: descriptions that the rows have left (see texts.py)."""
    return once_each(df, ["title", "description"], lambda values: _components(values, profile), texts)


def _components(df: DataFrame, profile: Profile) -> DataFrame:
    years = profile.years or 0
    mine = F.array(*[F.lit(s) for s in profile.skills]) if profile.skills else F.array().cast("array<string>")
    read = df.withColumns({
        "__skills": S.extract_skills(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))),
        "__role": S.classify_role("title", "description"),
        "__senior": S.seniority("title", "description"),
        "__thin": F.length(F.trim(F.coalesce("description", F.lit("")))) <= 300,
    })
    met = read.withColumn("__met", S.matched_missing("__skills", mine)).withColumns({
        "matched_skills": F.col("__met.matched"), "missing_skills": F.col("__met.missing"),
        "role_score": F.col("__role.score"), "role_category": F.col("__role.category"),
        "is_executive": F.col("__senior.executive"), "is_senior": F.col("__senior.senior"),
        "__n": F.size("__skills"), "__hits": F.size("__met.matched"),
    })
    explicit = (F.col("__n") >= 2) | ((F.col("__n") == 1) & F.col("__thin"))
    ratio = F.col("__hits") / F.col("__n").cast("double")
    experience = F.when(F.col("is_executive"), F.lit(15 if years <= 2 else 85)) \
        .when(F.col("is_senior"), F.lit(30 if years <= 2 else 85)) \
        .when(F.col("__senior.entry"), F.lit(95 if years <= 2 else 70)) \
        .otherwise(F.lit(75 if years <= 3 else 90))
    return met.withColumns({
        "skill_confidence": F.when(explicit, F.lit("explicit")).when(F.col("__n") == 1, F.lit("inferred")).otherwise(F.lit("unknown")),
        "skill_score": F.when(explicit, _clamp(F.rint(ratio * 100).cast("int"), 10, 98))
        .when(F.col("__n") == 1, F.when(F.col("__hits") == 1, F.lit(65)).otherwise(F.lit(10))),
        "experience_score": experience,
    }).drop("__skills", "__role", "__senior", "__thin", "__met", "__n", "__hits")


def _local_score(years: int) -> Column:
    skill, role, exp = (F.col(c).cast("double") for c in ("skill_score", "role_score", "experience_score"))
    full = F.rint(F.lit(0.45) * skill + F.lit(0.35) * role + F.lit(0.20) * exp)
    rest = F.rint((F.lit(0.35) * role + F.lit(0.20) * exp) / F.lit(0.55))
    score = _clamp(F.when(F.col("skill_score").isNotNull(), full).otherwise(rest).cast("int"), 10, 98)
    score = F.when(F.col("skill_confidence") == "unknown", F.least(F.lit(65), score)).otherwise(score)
    return category_cap(_seniority_cap(score, years), F.col("role_category"))


def score_local(df: DataFrame, profile: Profile, texts: DataFrame | None = None) -> DataFrame:
    """C4: rule-based score; adds local_score and its parts. ``texts`` as in components."""
    return components(df, profile, texts).withColumn("local_score", _local_score(profile.years or 0))


def score_hybrid(df: DataFrame, profile: Profile, nearest: str = "nearest") -> DataFrame:
    """Local parts plus similarity to the closest profile chunk; local score without one."""
    scored = score_local(df, profile).withColumn("semantic_score", distance_to_score(nearest))
    skill, role, exp, sem = (F.col(c).cast("double") for c in (
        "skill_score", "role_score", "experience_score", "semantic_score"))
    full = F.rint(F.lit(0.35) * skill + F.lit(0.30) * sem + F.lit(0.20) * role + F.lit(0.15) * exp)
    rest = F.rint((F.lit(0.30) * sem + F.lit(0.20) * role + F.lit(0.15) * exp) / F.lit(0.65))
    score = _clamp(F.when(F.col("skill_score").isNotNull(), full).otherwise(rest).cast("int"), 10, 98)
    score = F.when(F.col("skill_confidence") == "unknown", F.least(F.lit(65), score)).otherwise(score)
    score = _seniority_cap(score, profile.years or 0)
    has = F.col("semantic_score").isNotNull()
    return scored.withColumns({
        "hybrid_score": F.when(has, score).otherwise(F.col("local_score")),
        "score_method": F.when(has, F.lit("hybrid_semantic")).otherwise(F.lit("keyword_fallback")),
    })


def evidence_cap(df: DataFrame) -> DataFrame:
    """An unverified score without a real description stops at 60."""
    capped = ~is_verified() & (F.coalesce("score", F.lit(rules.DEFAULT_SCORE)) > rules.STUB_CAP) & V.is_stub("description")
    return df.withColumn("evidence_capped", capped).withColumn(
        "score", F.when(F.col("evidence_capped"), F.lit(rules.STUB_CAP)).otherwise(F.col("score")))


def score_simple(df: DataFrame, skills: list[str]) -> DataFrame:
    """C11: 50 + 12 per matched skill, 45 to 98."""
    found = S.extract_skills(F.concat_ws(" ", "title", "description"))
    matched = F.size(F.array_intersect(found, F.array(*[F.lit(s) for s in skills])))
    return df.withColumn("simple_score", _clamp(F.lit(50) + matched * 12, 45, 98))


def route(df: DataFrame) -> DataFrame:
    """Which scorer a posting deserves. Needs relevance, first_pass, yield_multiplier, quota_low."""
    rel, mult = F.col("relevance"), F.col("yield_multiplier")
    ambiguous, high = F.col("first_pass").between(40, 75), F.col("relevance") >= 0.60
    tier = (
        F.when(high & ambiguous & (mult < 0.8) & F.col("quota_low"), F.lit("ollama"))
        .when(high & ambiguous & F.col("quota_low") & (rel < 0.75), F.lit("ollama"))
        .when(high & ambiguous, F.lit("paid_llm"))
        .when(high | ambiguous, F.lit("ollama")).otherwise(F.lit("hybrid_semantic")))
    reason = (
        F.when(high & ambiguous & (mult < 0.8) & F.col("quota_low"), F.lit("low-yield cycle and tight quota headroom"))
        .when(high & ambiguous & F.col("quota_low") & (rel < 0.75), F.lit("tight quota headroom"))
        .when(high & ambiguous, F.lit("high relevance, ambiguous match"))
        .when(high, F.lit("high relevance, clear match from first pass"))
        .when(ambiguous, F.lit("low relevance, ambiguous match"))
        .otherwise(F.lit("low relevance, clear match from first pass")))
    return df.withColumns({
        "ambiguity_band": F.when(ambiguous, F.lit("ambiguous")).otherwise(F.lit("clear")),
        "target_tier": tier, "routing_reason": reason})


def needs_scoring(version: str, force: bool = False) -> Column:
    """No match yet, one of another profile version, or a cheap one under force."""
    fresh = F.col("score").isNotNull() & F.coalesce(F.col("profile_version") == version, F.lit(False))
    if force:
        fresh = fresh & F.coalesce(F.col("tier").isin(rules.VERIFIED_TIERS), F.lit(False))
    return ~fresh


def consensus(primary: DataFrame, second: DataFrame) -> DataFrame:
    """Two scores of the ambiguous band compared. Both: id, score."""
    a = primary.select("id", V.numeric_score("score").alias("primary_score")).where(
        F.col("primary_score").between(40, 60))
    b = second.select("id", F.col("score").alias("__second"))
    joined = a.join(b, "id").withColumn(
        "secondary_score", F.coalesce(V.numeric_score("__second"), "primary_score")).drop("__second")
    diff = F.abs(F.col("primary_score") - F.col("secondary_score"))
    return joined.withColumn("score_diff", diff).withColumns({
        "consensus": F.col("score_diff") <= 20,
        "flag": F.when(F.col("score_diff") > 20, F.lit("scores_disagree"))})


# fixed values: trust in each extraction method
METHOD_CONFIDENCE = {"workday_api": 0.95, "stored_pattern": 0.90, "heuristic": 0.75, "apify": 0.90}


def parse_confidence(scan_log: DataFrame) -> DataFrame:
    """Trust in a scan by method, less after a sudden drop. Needs prior_avg."""
    base = F.lit(0.60)
    for method, value in METHOD_CONFIDENCE.items():
        base = F.when(F.col("method") == method, F.lit(value)).otherwise(base)
    dropped = (F.col("prior_avg") > 0) & (F.col("jobs_found") < 0.30 * F.col("prior_avg"))
    score = F.round(F.when(dropped, base - 0.30).otherwise(base), 2)
    return scan_log.withColumn("parse_confidence", F.when(F.col("jobs_found") <= 0, F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))))


def difficulty(metrics: DataFrame) -> DataFrame:
    """C13"""
    easy = (F.col("successful_scans") > 0) & (F.col("jobs_extracted") >= 5)
    return metrics.withColumn("difficulty", F.when(easy, F.lit(0.3)).otherwise(F.lit(0.8)))


def crosscheck_gate(df: DataFrame) -> DataFrame:
    """C14: whether a doubtful scan is worth a second look. Needs parse_confidence, threshold,
    relevance, yield_multiplier, quota_low."""
    doubtful = F.col("parse_confidence") < F.col("threshold")
    return df.withColumn("crosscheck", (
        F.when(~doubtful, F.lit("not needed"))
        .when(F.col("quota_low") & (F.col("relevance") < 0.85), F.lit("skipped: quota headroom low"))
        .when((F.col("yield_multiplier") < 0.8) & (F.col("relevance") < 0.70), F.lit("skipped: low-yield cycle"))
        .when(F.col("relevance") < 0.50, F.lit("skipped: low relevance"))
        .otherwise(F.lit("triggered"))))


def partition_companies(companies: DataFrame, streaks: DataFrame, cycle: int, now, failures: int = 3, days: int = 7,
                        dormant_every: int = 4, fresher_streak: int = 12, fresher_every: int = 2) -> DataFrame:
    """Adds scan_tier and scan_now. ``streaks``: company_id, zero_yield_streak, last_success_at,
    fresher_zero_streak, jobs_extracted."""
    joined = companies.join(streaks, "company_id", "left")
    recent = F.coalesce(F.col("last_success_at") > as_of(now) - F.make_dt_interval(F.lit(days)), F.lit(False))
    dormant = (F.coalesce("zero_yield_streak", F.lit(0)) >= failures) & ~recent
    slow = (F.coalesce("fresher_zero_streak", F.lit(0)) >= fresher_streak) & (F.coalesce("jobs_extracted", F.lit(0)) > 0)
    return joined.withColumn("scan_tier", F.when(dormant, F.lit("dormant")).otherwise(F.lit("active"))).withColumn(
        "scan_now", F.when(F.col("scan_tier") == "dormant", F.lit(cycle % dormant_every == 0))
        .otherwise(~slow | F.lit(cycle % fresher_every == 0)))


def severity_multiplier(misses: Column) -> Column:
    return F.when(misses <= 0, 1.0).when(misses == 1, 1.25).when(misses == 2, 1.5).otherwise(2.0)


def _hundredths(col: Column) -> Column:
    return F.round(col, 2)


def optimize_thresholds(metrics: DataFrame, feedback: DataFrame) -> DataFrame:
    """Threshold steps by precision and recall. ``metrics``: filter, threshold, precision, recall."""
    misses = feedback.agg(F.count_if((F.col("action") == "no") & (F.col("job_match_score") >= 75))).scalar()
    stepped = metrics.where("filter <> 'scan_confidence_threshold'").withColumn("confident_misses", misses) \
        .withColumn("delta", F.least(F.lit(0.15), _hundredths(F.lit(0.08) * severity_multiplier(F.col("confident_misses")))))
    p, r, old = F.col("precision"), F.col("recall"), F.col("threshold")
    new = F.when((p < 0.80) & (r > 0.85) & (old < 0.95), F.least(F.lit(0.95), _hundredths(old + F.col("delta")))) \
        .when((r < 0.80) & (p > 0.85) & (old > 0.50), F.greatest(F.lit(0.50), _hundredths(old - F.col("delta")))).otherwise(old)
    return stepped.withColumn("new_threshold", new).withColumn("adjusted", _hundredths(new) != _hundredths(old))


def evaluate_trials(due: DataFrame, metrics: DataFrame, feedback: DataFrame) -> DataFrame:
    """C17: verdict on finished trials. ``metrics``: filter, precision."""
    misses = feedback.agg(F.count_if((F.col("action") == "no") & (F.col("job_match_score") >= 75))).scalar()
    joined = due.join(metrics.select(F.col("filter").alias("threshold_name"), "precision"), "threshold_name", "left") \
        .withColumn("miss_rate", F.round(misses / 20.0, 4))
    worse = (F.col("miss_rate") > F.coalesce("pre_miss_rate", F.lit(0.05))) | (
        F.coalesce("precision", F.lit(0.90)) < F.coalesce("pre_precision", F.lit(0.90)) - 0.05)
    return joined.withColumn("verdict", F.when(worse, F.lit("reverted")).otherwise(F.lit("confirmed"))) \
        .withColumn("final_value", F.when(worse, F.col("old_value")).otherwise(F.col("new_value")))


def pacing_adjustment(pacing: DataFrame, threshold: float) -> DataFrame:
    """Scan threshold moved by the pacing modifier, 0.60 to 0.95."""
    moved = F.greatest(F.lit(0.60), F.least(F.lit(0.95), _hundredths(F.lit(threshold) + F.col("modifier"))))
    return pacing.withColumns({"old_threshold": F.lit(threshold), "new_threshold": moved})


def pattern_status(events: DataFrame, limit: int = 3) -> DataFrame:
    """A pattern is stale after ``limit`` failures since it was last saved or validated.
    ``events``: company_id, at, event_id, kind ('saved', 'validated', 'failed')."""
    place = F.struct("at", "event_id")
    reset = events.groupBy("company_id").agg(F.max(F.when(F.col("kind") != "failed", place)).alias("__reset"))
    joined = events.join(reset, "company_id").groupBy("company_id").agg(
        F.count_if((F.col("kind") == "failed") & (F.col("__reset").isNull() | (place > F.col("__reset")))).alias("failure_count"),
        F.max(F.when(F.col("kind") != "failed", F.col("at"))).alias("last_validated"))
    return joined.withColumn("status", F.when(F.col("failure_count") >= limit, F.lit("stale")).otherwise(F.lit("active")))


def match_struct(scored: DataFrame, profile: Profile, tier: int = 6) -> DataFrame:
    """C20: the match to store, with its reasoning text."""
    reasoning = F.concat(
        F.lit("Local score: skill="), F.coalesce(F.col("skill_score").cast("string"), F.lit("None")), F.lit(" ("),
        "skill_confidence", F.lit("), role="), F.col("role_score").cast("string"), F.lit(" ("), "role_category",
        F.lit("), exp="), F.col("experience_score").cast("string"), F.lit("%."))
    return scored.withColumn("match", F.struct(
        F.col("local_score").alias("score"), F.lit(tier).alias("tier"), F.lit(profile.version).alias("profile_version"),
        "matched_skills", "missing_skills", reasoning.alias("reasoning")))
