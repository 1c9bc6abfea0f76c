"""Reports: aggregates over postings, applications, scans, usage and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import fields as V
from ..functions import text as T
from ..session import as_of
from .joins import company_applications, feedback_overlap
from .windows import last_status, status_latency, zero_yield_streak, fresher_streak




def _rate(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(0.0))


def _percent(rate: Column) -> Column:
    return F.floor(rate * 100).cast("string")


def _score(default: int = 0) -> Column:
    return F.coalesce("score", F.lit(default))


# --- funnel ------------------------------------------------------------------

FUNNEL = ["closed", "stale", "role_mismatch", "location", "experience", "seniority_keywords",
          "awaiting_scoring", "below_min_score", "already_applied"]


def funnel(flagged: DataFrame) -> DataFrame:
    """A1: rows removed at each stage, from the column first_failed (null = shown)."""
    counts = [F.count_if(F.col("first_failed") == s).alias(
        s if s in ("awaiting_scoring", "already_applied") else f"dropped_{s}") for s in FUNNEL]
    return flagged.agg(*counts, F.count_if(F.col("first_failed").isNull()).alias("shown"))


# --- cycles ------------------------------------------------------------------

def source_counts(df: DataFrame) -> DataFrame:
    """A2"""
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("postings"))


def cycle_summary(raw: DataFrame, unique: DataFrame, filtered: DataFrame) -> DataFrame:
    """A3: sizes of one cycle and the mean score of what passed."""
    return filtered.agg(F.count(F.lit(1)).alias("filtered"), F.coalesce(F.round(F.avg(_score()), 1), F.lit(0.0)).alias("avg_score")).select(
        raw.agg(F.count(F.lit(1))).scalar().alias("raw"), unique.agg(F.count(F.lit(1))).scalar().alias("deduplicated"), "filtered", "avg_score")


def yield_by_bucket(cycles: DataFrame) -> DataFrame:
    """Yield of each 3-hour bucket relative to all; neutral below five samples."""
    value = F.col("jobs_found") + F.lit(1.5) * F.col("relevant_found")
    overall = cycles.agg(F.avg(value)).scalar()
    sampled = cycles.groupBy(V.hour_bucket("started_at").alias("bucket")).agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.avg("jobs_found"), 1).alias("avg_jobs_found"),
        F.round(F.avg("relevant_found"), 1).alias("avg_high_relevance"), F.avg(value).alias("__mean"))
    session = cycles.sparkSession
    buckets = session.range(8).select(V.bucket_label(F.col("id") * 3).alias("bucket"), (F.col("id") * 3).alias("start_hour"))
    ratio = F.least(F.lit(2.5), F.greatest(F.lit(0.3), F.round(F.col("__mean") / F.col("__all"), 2)))
    return buckets.join(sampled, "bucket", "left").withColumn("__all", overall).select(
        "bucket", "start_hour", F.coalesce("samples", F.lit(0)).alias("samples"),
        F.coalesce("avg_jobs_found", F.lit(0.0)).alias("avg_jobs_found"),
        F.coalesce("avg_high_relevance", F.lit(0.0)).alias("avg_high_relevance"),
        F.when((F.col("samples") >= 5) & (F.col("__all") > 0), ratio).otherwise(F.lit(1.0)).alias("yield_multiplier"))


def quota_forecast(keys: DataFrame, cycles: DataFrame, hour: int, interval: int = 3) -> DataFrame:
    """Calls left against the calls the rest of the day needs. ``keys``: quota_remaining."""
    remaining = max(1, (max(1, 24 - hour) + interval - 1) // interval)
    ahead = cycles.sparkSession.range(remaining).select(
        (F.floor(F.pmod(F.lit(hour) + F.col("id") * interval, F.lit(24)) / 3) * 3).alias("start_hour"))
    mean = cycles.agg(F.coalesce(F.avg("jobs_found"), F.lit(15.0))).scalar()
    needed = ahead.join(yield_by_bucket(cycles), "start_hour").agg(F.sum("yield_multiplier").alias("m")).select(
        F.round(F.col("m") * mean, 1)).scalar()
    out = keys.agg(F.coalesce(F.sum("quota_remaining"), F.lit(0)).alias("total_quota_remaining")).withColumns({
        "estimated_needed_today": needed, "remaining_cycles_today": F.lit(remaining)})
    return out.withColumn("status", F.when(F.col("total_quota_remaining") < F.col("estimated_needed_today"), F.lit("low"))
                          .otherwise(F.lit("healthy")))


# --- applications ------------------------------------------------------------

def _mode(df: DataFrame, by: str, value: str, name: str, only: Column | None = None) -> DataFrame:
    """Most frequent value per group, ties by name."""
    src = df if only is None else df.where(only)
    return src.groupBy(by, value).agg(F.count(F.lit(1)).alias("__n")).groupBy(by).agg(
        F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(name))


def company_stats(names: DataFrame, apps: DataFrame, history: DataFrame, name: str = "company") -> DataFrame:
    """A4: application record per asked company name (containment, as in the tracker's lookup)."""
    found = company_applications(names, apps, name).join(status_latency(history), "application_id", "left")
    status = F.lower("status")
    referral = F.col("referral_source").isNotNull() | (status == "referral")
    counts = found.groupBy("asked").agg(
        F.count(F.lit(1)).alias("total_applications"), *[F.count_if(status == k).alias(k) for k in rules.STATUS_KINDS],
        F.count_if(referral).alias("referral_count"), F.coalesce(F.rint(F.avg("salary_offered")), F.lit(0.0)).alias("avg_salary"),
        F.round(F.avg("days_to_interview"), 1).alias("avg_days_to_interview"))
    full = names.select(F.col(name).alias("asked")).distinct().join(counts, "asked", "left") \
        .join(_mode(found, "asked", "job_title", "most_common_role"), "asked", "left")
    zero = ["total_applications", *rules.STATUS_KINDS, "referral_count"]
    full = full.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})
    total = F.col("total_applications")
    rated = full.withColumns({
        "success_rate": _rate(F.col("offer") + F.col("accepted") + F.col("referral_count"), total),
        "interview_rate": _rate(F.col("interviewed") + F.col("offer") + F.col("accepted"), total),
        "avg_salary": F.coalesce("avg_salary", F.lit(0.0)), "most_common_role": F.coalesce("most_common_role", F.lit("N/A"))})
    # what the record suggests, as a code; the rates it rests on stand beside it
    advice = F.when(total == 0, F.lit("no_record")).when(F.col("success_rate") >= 0.25, F.lit("apply_more")) \
        .when(F.col("interview_rate") >= 0.40, F.lit("keep_applying")).otherwise(F.lit("improve_match"))
    return rated.withColumn("advice", advice).withColumnRenamed("asked", "company")


def _asked_stats(apps: DataFrame, column: str, asked: list[str]) -> DataFrame:
    """Each application once per asked term its column contains (terms are a short list)."""
    terms = F.array_compact(F.array(*[F.when(F.lower(column).contains(a.lower()), F.lit(a)) for a in asked]))
    return apps.withColumn("asked", F.explode(terms))


OFFERED = ["offer", "accepted"]


def role_stats(apps: DataFrame, roles: list[str]) -> DataFrame:
    """A5"""
    found = _asked_stats(apps, "job_title", roles)
    out = found.groupBy("asked").agg(
        F.count(F.lit(1)).alias("total_applications"), F.count_if(F.col("status").isin(OFFERED)).alias("offers"),
        F.count_if(F.col("status").isin("interviewed", *OFFERED)).alias("interviews"),
        F.rint(F.avg("salary_offered")).alias("avg_salary"))
    best = _mode(found, "asked", "company", "most_successful_company", F.col("status").isin(OFFERED))
    rated = out.join(best, "asked", "left").withColumns({
        "success_rate": _rate(F.col("offers"), F.col("total_applications")),
        "interview_rate": _rate(F.col("interviews"), F.col("total_applications"))})
    return rated.withColumn("recommendation", F.concat(
        F.lit("You have "), _percent(F.col("success_rate")), F.lit("% success rate for '"), "asked",
        F.lit("'. Focus on top companies like "), "most_successful_company", F.lit("."))).withColumnRenamed("asked", "role")


def location_stats(apps: DataFrame, locations: list[str]) -> DataFrame:
    """A6"""
    found = _asked_stats(apps, "location", locations)
    out = found.groupBy("asked").agg(
        F.count(F.lit(1)).alias("total_applications"), F.count_if(F.col("status").isin(OFFERED)).alias("offers"),
        F.coalesce(F.rint(F.avg("salary_offered")), F.lit(1000000.0)).alias("avg_salary"))
    return out.join(_mode(found, "asked", "company", "top_company"), "asked", "left").withColumn(
        "success_rate", _rate(F.col("offers"), F.col("total_applications"))).withColumnRenamed("asked", "location")


def timeline(apps: DataFrame, history: DataFrame, now) -> DataFrame:
    """A7"""
    now = as_of(now)
    offer = status_latency(history).agg(F.coalesce(F.rint(F.avg("days_to_offer")), F.lit(7.0))).scalar()
    return apps.agg(
        F.count(F.lit(1)).alias("total_applications"),
        F.count_if(F.col("applied_at") >= now - F.make_dt_interval(F.lit(7))).alias("applications_this_week"),
        F.count_if(F.col("applied_at") >= now - F.make_dt_interval(F.lit(30))).alias("applications_this_month"),
    ).withColumn("avg_days_to_offer", offer)


def dashboard(apps: DataFrame) -> DataFrame:
    """Totals; the top fields are computed from offers, ties by name."""
    status = F.lower("status")
    referral = F.col("referral_source").isNotNull() | (status == "referral")

    def leader(column: str):
        return apps.where(F.col("status").isin(OFFERED)).groupBy(column).agg(F.count(F.lit(1)).alias("n")).agg(
            F.min_by(column, F.struct(-F.col("n"), F.col(column)))).scalar()

    out = apps.agg(
        F.count(F.lit(1)).alias("total_applications"), F.count_if(status.isin(OFFERED)).alias("total_offers"),
        F.count_if(status == "rejected").alias("total_rejections"), F.count_if(referral).alias("total_referrals"),
        *[F.count_if(status == k).alias(k) for k in rules.STATUS_KINDS])
    return out.withColumns({
        "overall_success_rate": _rate(F.col("total_offers") + F.col("total_referrals"), F.col("total_applications")),
        "top_company": leader("company"), "top_role": leader("job_title"), "top_location": leader("location")})


def wow(apps: DataFrame, now) -> DataFrame:
    """This week against last week."""
    age = V.whole_days_between("applied_at", as_of(now))
    counts = apps.agg(F.count_if(age.between(0, 7)).alias("this_week"), F.count_if((age > 7) & (age <= 14)).alias("last_week"))
    change = F.when(F.col("last_week") > 0, F.round((F.col("this_week") - F.col("last_week")) / F.col("last_week") * 100.0, 1)) \
        .when(F.col("this_week") > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    return counts.withColumn("percent_change", change)


def insights(apps: DataFrame, company: str, role: str, location: str) -> DataFrame:
    """Typed statements on company, role, place, salary and progress."""
    def success(flag: Column, with_referrals: bool) -> Column:
        good = F.count_if(flag & F.col("status").isin(OFFERED))
        if with_referrals:
            good = good + F.count_if(flag & F.col("referral_source").isNotNull())
        return F.when(F.count_if(flag) > 0, F.round(good / F.count_if(flag), 2))

    at = F.lower("company").contains(company.lower())
    as_role, there = F.lower("job_title").contains(role.lower()), F.lower("location").contains(location.lower())
    one = apps.agg(
        success(at, True).alias("c"), success(as_role, False).alias("r"), success(there, False).alias("l"),
        F.avg("salary_offered").alias("s"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin(OFFERED)).alias("o"),
        F.count_if(F.col("status") == "interviewed").alias("i"), F.count_if(F.col("status") == "rejected").alias("x"))

    def row(kind: str, priority: str, subject: str, measure: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(priority).alias("priority"), F.lit(subject).alias("subject"),
                        F.lit(measure).alias("measure"), value.cast("double").alias("value"))

    rows = F.array(
        row("company", "high", company, "success_rate", F.col("c")), row("role", "high", role, "success_rate", F.col("r")),
        row("location", "medium", location, "success_rate", F.col("l")), row("salary", "medium", "all", "avg_salary_offered", F.round("s", 2)),
        *[row("general", "high", "all", name, F.col(c)) for name, c in (("applications", "n"), ("offers", "o"), ("interviews", "i"), ("rejections", "x"))])
    return one.select(F.inline(rows)).where("value IS NOT NULL")


# --- accuracy and feedback ---------------------------------------------------

def _miss() -> Column:
    return (F.col("action") == "no") & (F.coalesce("job_match_score", F.lit(0)) >= 75)


def worst_case(feedback: DataFrame, postings: DataFrame) -> DataFrame:
    """Share of confident scores the user contradicted. The misses themselves: worst_case_examples."""
    store = postings.agg(F.count_if(_score() >= 75)).scalar()
    out = feedback.agg(F.count_if(F.coalesce("job_match_score", F.lit(0)) >= 75).alias("high"), F.count_if(_miss()).alias("confident_misses"))
    total = F.greatest(F.col("high"), F.col("store"))
    return out.withColumn("store", store).withColumn("high_confidence_total", total) \
        .withColumns({
            "accuracy": F.round(1.0 - F.col("confident_misses") / F.greatest(F.lit(1), F.col("high_confidence_total")), 2),
            "trend": F.when(F.col("confident_misses") == 0, F.lit("improving")).when(F.col("confident_misses") > 2, F.lit("declining"))
            .otherwise(F.lit("stable"))}).drop("high", "store")


def worst_case_examples(feedback: DataFrame) -> DataFrame:
    """Confident misses, newest first."""
    return feedback.where(_miss()).orderBy(F.desc("feedback_id"))


def efficiency(companies: DataFrame, postings: DataFrame, filters: DataFrame, patterns: DataFrame) -> DataFrame:
    """A10: weighted health of parsing, matching, filtering and patterns. Empty inputs count as their usual value."""
    acc = F.avg("parsing_accuracy")
    parts = {
        "parsing_accuracy_avg": companies.agg(F.when(F.count(F.lit(1)) == 0, F.lit(88.0)).otherwise(
            F.coalesce(F.when(acc <= 1.0, acc * 100.0).otherwise(acc), F.lit(85.0)))),
        "high_confidence_ratio": postings.agg(F.when(F.count(F.lit(1)) == 0, F.lit(82.0)).otherwise(
            F.count_if(_score() >= 70) / F.count(F.lit(1)) * 100.0)),
        "filter_precision_avg": filters.agg(F.coalesce(F.avg(F.coalesce("precision", F.lit(0.85)) * 100.0), F.lit(85.0))),
        "pattern_health_ratio": patterns.agg(F.when(F.count(F.lit(1)) == 0, F.lit(90.0)).otherwise(
            F.count_if(F.coalesce("status", F.lit("")) != "stale") / F.count(F.lit(1)) * 100.0)),
    }
    one = companies.sparkSession.range(1).select(*[df.scalar().alias(name) for name, df in parts.items()])
    score = (F.col("parsing_accuracy_avg") * 0.25 + F.col("high_confidence_ratio") * 0.30
             + F.col("filter_precision_avg") * 0.25 + F.col("pattern_health_ratio") * 0.20)
    return one.withColumn("efficiency_score", F.round(score, 1)).withColumns({n: F.round(n, 1) for n in parts})


def trending_keywords(log: DataFrame) -> DataFrame:
    """A12"""
    word = F.coalesce("new_keyword", "filter")
    return log.where(F.col("type").contains("keyword") & word.isNotNull()).groupBy(word.alias("skill")).agg(F.count(F.lit(1)).alias("count")) \
        .withColumn("percent_growth", F.least(F.lit(45.0), F.round(F.col("count") * 8.5, 1))).orderBy(F.desc("count"), "skill")


def feedback_summary(feedback: DataFrame) -> DataFrame:
    """A13"""
    out = feedback.agg(F.count(F.lit(1)).alias("total_feedback"), F.count_if(F.col("action") == "yes").alias("positive"),
                       F.count_if(F.col("action") == "no").alias("negative"))
    return out.withColumn("precision", F.round(F.col("positive") / F.greatest(F.lit(1), F.col("positive") + F.col("negative")), 2))


# fixed values: feedback habits, their word lists, thresholds and advice
HABITS = [
    ("data", "yes", "job_title", ["data", "analytics"], 2, "You applied to multiple Data/Analytics roles — should we add 'Data Engineer' to your target roles?"),
    ("backend", "yes", "job_title", ["backend", "python", "java"], 3, "High application rate for Backend Engineering positions — priority boosted for Python/Java backend roles."),
    ("experience", "no", "reason", ["year", "exp", "senior"], 2, "You consistently reject roles requiring 3+ years experience — filter automatically adjusted to max 2 years experience."),
    ("location", "no", "reason", ["mumbai", "pune", "relocate"], 2, "You frequently reject non-NCR/Bangalore locations — consideration to restrict location filter to Delhi/NCR & Bangalore."),
]


def feedback_patterns(feedback: DataFrame) -> DataFrame:
    """Habits seen often enough, with advice."""
    counts = feedback.agg(*[
        F.count_if((F.col("action") == act) & T.has_any(F.lower(F.coalesce(col, F.lit(""))), words)).alias(name)
        for name, act, col, words, _, _ in HABITS])
    rows = F.array(*[F.struct(F.lit(name).alias("pattern"), F.col(name).alias("hits"), F.lit(least).alias("needed"),
                              F.lit(advice).alias("recommendation")) for name, _, _, _, least, advice in HABITS])
    return counts.select(F.inline(rows)).where("hits >= needed").drop("needed")


def predict_relevance(keys: DataFrame, stats: DataFrame, postings: DataFrame, feedback: DataFrame, digits: int = 2) -> DataFrame:
    """Relevance of (company, title) from success, past scores and feedback; each half by default.
    ``stats``: company, total_applications, success_rate."""
    asked = keys.select("company", "title").distinct()
    past = postings.groupBy(F.lower(F.trim("company")).alias("__c")).agg(F.avg("score").alias("__mean"))
    general = feedback.agg(F.coalesce(F.count_if(F.col("action") == "yes") / F.count(F.lit(1)), F.lit(0.5))).scalar()
    joined = (
        asked.join(stats.select("company", "total_applications", "success_rate"), "company", "left")
        .withColumn("__c", F.lower(F.trim("company"))).join(past, "__c", "left")
        .join(feedback_overlap(keys, feedback), ["company", "title"], "left").withColumn("__general", general))

    def unit(col: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))

    success = F.when(F.coalesce("total_applications", F.lit(0)) > 0, unit(F.col("success_rate"))).otherwise(F.lit(0.5))
    history = F.coalesce(unit(F.col("__mean") / 100.0), F.lit(0.5))
    liked = F.coalesce(F.col("positive") / F.col("total"), F.col("__general"))
    return joined.select("company", "title", unit(F.round(
        F.lit(0.40) * success + F.lit(0.30) * history + F.lit(0.30) * liked, digits)).alias("relevance"))


def personalization_stats(feedback: DataFrame, log: DataFrame) -> DataFrame:
    """``log``: examples_used."""
    used = log.agg(F.count_if(F.coalesce("examples_used", F.lit(0)) > 0)).scalar()
    return feedback.agg(F.count(F.lit(1)).alias("total_feedback_count")).withColumns({
        "personalization_active": F.col("total_feedback_count") >= 5, "jobs_scored_with_personalization": used,
        "recent_examples_injected": F.least(F.col("total_feedback_count"), F.lit(5))})


# --- usage -------------------------------------------------------------------

def usage_pacing(usage: DataFrame, now, monthly_limit: float) -> DataFrame:
    """Spend of the month against the prorated budget."""
    now = as_of(now)
    month = F.date_format(now, "yyyy-MM")
    spent = F.coalesce(F.sum(F.when(V.month_key("called_at") == month, F.col("credits"))), F.lit(0.0))
    expected = F.dayofmonth(now) / F.dayofmonth(F.last_day(now)) * F.lit(float(monthly_limit))
    out = usage.agg(spent.alias("spent")).withColumn("pace_ratio", F.when(expected <= 0, F.lit(1.0)).otherwise(F.round(F.col("spent") / expected, 2)))
    return out.withColumn("modifier", F.when(F.col("pace_ratio") < 0.7, F.lit(0.03)).when(F.col("pace_ratio") > 1.2, F.lit(-0.03)).otherwise(F.lit(0.0)))


def spend_status(usage: DataFrame, now, daily_cap: float, monthly_cap: float) -> DataFrame:
    """A18"""
    now = as_of(now)

    def spent(when: Column) -> Column:
        return F.round(F.coalesce(F.sum(F.when(when, F.col("credits"))), F.lit(0.0)), 4)

    out = usage.agg(
        spent(V.day_key("called_at") == F.date_format(now, "yyyy-MM-dd")).alias("spent_today"),
        spent(V.month_key("called_at") == F.date_format(now, "yyyy-MM")).alias("spent_month"))
    return out.withColumns({"daily_cap_reached": F.col("spent_today") >= daily_cap, "monthly_cap_reached": F.col("spent_month") >= monthly_cap})


def tier_stats(log: DataFrame, day) -> DataFrame:
    """Scored postings and mean latency of a day by tier and model, with subtotals."""
    of_day = log.where(V.day_key("scored_at") == F.date_format(as_of(day), "yyyy-MM-dd"))
    return of_day.rollup("tier", "model").agg(F.count(F.lit(1)).alias("scored"), F.round(F.avg("seconds"), 2).alias("avg_seconds"))


def consensus_stats(log: DataFrame, day) -> DataFrame:
    """A20"""
    out = log.agg(F.count(F.lit(1)).alias("total_verified"), F.count_if(V.day_key("at") == F.date_format(as_of(day), "yyyy-MM-dd")).alias("verified_today"),
                  F.count_if(F.col("flag") == "scores_disagree").alias("disputed_count"), F.count_if("consensus").alias("agreed"))
    return out.withColumn("agreement_rate_percent", F.when(F.col("total_verified") > 0, F.round(
        F.col("agreed") / F.col("total_verified") * 100, 1)).otherwise(F.lit(100.0))).drop("agreed")


def pattern_health(patterns: DataFrame, revalidations: DataFrame) -> DataFrame:
    """A21"""
    stale = F.coalesce(F.col("status") == "stale", F.lit(False))
    return patterns.agg(F.count(F.lit(1)).alias("total_patterns"), F.count_if(~stale).alias("active_patterns"),
                        F.count_if(stale).alias("stale_patterns")).withColumn("last_revalidation", revalidations.agg(F.max("at")).scalar())


# --- companies and discovery -------------------------------------------------

def scan_metrics(scan_log: DataFrame) -> DataFrame:
    """Counters of every company from its scans."""
    ok = (F.col("jobs_found") > 0) & F.col("error").isNull()
    last = F.struct("scanned_at", "scan_id")
    return scan_log.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("total_scans"), F.count_if(ok).alias("successful_scans"),
        F.coalesce(F.sum(F.when(ok, F.col("jobs_found").cast("long"))), F.lit(0)).alias("jobs_extracted"),
        F.max("scanned_at").alias("last_scan"), F.max_by("method", last).alias("extraction_method"),
        F.max_by("error", F.when(F.col("error").isNotNull(), last)).alias("last_error"),
        F.sum(F.col("fresher_found").cast("long")).alias("fresher_jobs_total"),
        F.max_by("fresher_found", last).alias("fresher_jobs_last_scan"),
    ).withColumn("parsing_accuracy", F.round(F.col("successful_scans") / F.col("total_scans"), 2))


def scan_streaks(scan_log: DataFrame) -> DataFrame:
    """W3 and W4 next to the counters."""
    return scan_metrics(scan_log).join(zero_yield_streak(scan_log), "company_id").join(fresher_streak(scan_log), "company_id")


def company_target(companies: DataFrame, streaks: DataFrame, additions: DataFrame, now, target: float = 0.75) -> DataFrame:
    """How far the list is from its share of fresher-hiring companies, and when it gets there.
    ``additions``: finished_at, added (array)."""
    active = (F.coalesce("fresher_jobs_total", F.lit(0)) > 0) & (F.coalesce("fresher_zero_streak", F.lit(99)) <= 3)
    recent = additions.where(F.col("finished_at") >= as_of(now) - F.make_dt_interval(F.lit(14))).agg(
        F.coalesce(F.sum(F.size("added")), F.lit(0))).scalar()
    out = companies.join(streaks, "company_id", "left").agg(
        F.count(F.lit(1)).alias("total_companies"), F.count_if(F.coalesce("total_scans", F.lit(0)) > 0).alias("scanned_at_least_once"),
        F.count_if(F.coalesce("jobs_extracted", F.lit(0)) > 0).alias("producing_jobs"), F.count_if(active).alias("fresher_active"))
    total, fa = F.col("total_companies"), F.col("fresher_active")
    need = F.when((total > 0) & (fa / total < target), F.floor((F.lit(target) * total - fa) / (1 - target)) + 1).otherwise(F.lit(0))
    return out.withColumns({"companies_needed": need, "recent_adds_14d": recent,
                            "fresher_active_pct": F.when(total > 0, F.round(fa / total * 100.0, 1)).otherwise(F.lit(0.0))}) \
        .withColumn("eta_days", F.when((F.col("recent_adds_14d") > 0) & (F.col("companies_needed") > 0),
                                       F.floor(F.col("companies_needed") / (F.col("recent_adds_14d") / 14.0))))


def discovery_summary(results: DataFrame) -> DataFrame:
    """Verdicts of one discovery cycle with rejections by reason."""
    reasons = results.where("status = 'rejected'").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n"))))).scalar()   # a handful of reasons
    return results.agg(F.count(F.lit(1)).alias("candidates_probed"), F.count_if(F.col("status") == "verified").alias("verified"),
                       F.count_if(F.col("status") == "watchlisted").alias("watchlisted")).withColumn("rejections", reasons)


def weekly_review(cycles: DataFrame, now) -> DataFrame:
    """Seven-day totals per rejection reason. ``cycles``: finished_at, candidates_probed, rejections (map)."""
    recent = cycles.where(F.col("finished_at") >= as_of(now) - F.make_dt_interval(F.lit(7)))
    reasons = recent.select(F.explode("rejections").alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("rejected"))
    return reasons.withColumn("probed", recent.agg(F.coalesce(F.sum("candidates_probed"), F.lit(0))).scalar())


def scan_report(companies: DataFrame, metrics: DataFrame, pool: str = "ats") -> DataFrame:
    """Scan outcome per pool of companies."""
    joined = companies.join(metrics, "company_id", "left")
    ok = (F.coalesce("successful_scans", F.lit(0)) > 0) & (F.coalesce("jobs_extracted", F.lit(0)) > 0)
    return joined.groupBy(pool).agg(
        F.count(F.lit(1)).alias("companies"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum("jobs_extracted"), F.lit(0)).alias("jobs_extracted"), F.round(F.avg("parsing_accuracy"), 4).alias("mean_accuracy"))


def flip_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Companies that went from nothing to something. Both: company_id, jobs_extracted."""
    joined = before.select("company_id", F.col("jobs_extracted").alias("jobs_before")).join(
        after.select("company_id", F.col("jobs_extracted").alias("jobs_after")), "company_id", "full") \
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("jobs_before", "jobs_after")})
    return joined.withColumn("flipped", (F.col("jobs_before") == 0) & (F.col("jobs_after") > 0))


def failure_categories(companies: DataFrame, metrics: DataFrame) -> DataFrame:
    """Why a company yields nothing."""
    from .filters import zero_yield
    err = F.coalesce("last_error", F.lit(""))
    broken = err.contains("Timeout") | err.contains("Error opening page") | (
        F.lower(err).contains("failed") & ~F.lower(err).contains("no jobs found"))
    return zero_yield(companies, metrics).withColumns({
        "category": F.when(broken, F.lit("broken_url")).otherwise(F.lit("no_current_openings")),
        "reason": F.coalesce("last_error", F.lit("0 jobs found on page using heuristic extraction"))})


def threshold_impact(scores: DataFrame, old: float, new: float, avg_seconds: float = 30.0, concurrency: int = 5) -> DataFrame:
    """Companies a threshold change touches and the minutes it adds. ``scores``: parse_confidence."""
    out = scores.agg(F.count_if(F.col("parse_confidence").between(min(old, new), max(old, new))).alias("affected"))
    minutes = F.round(F.col("affected") * avg_seconds / (concurrency * 60.0), 1)
    return out.withColumn("added_minutes", F.when((F.col("affected") > 0) & (minutes < 1.0), F.lit(1.0)).otherwise(minutes))


# fixed values: words of names that are not companies
JUNK_NAMES = ["industry", "solutions provider", "specialist", "leading", "consultanc", "recruit", "staffing", "hiring", "placement", "manpower", "hr services"]


def mine_companies(postings: DataFrame, known: DataFrame, limit: int | None, shortest: int = 3, longest: int = 45) -> DataFrame:
    """Frequent new company names among the postings; what is shorter or longer is no name."""
    name = T.strip(F.coalesce("company", F.lit("")))
    counted = postings.select(name.alias("name")).where(
        F.length("name").between(shortest, longest) & ~F.col("name").rlike(T.bounded(T.any_of(JUNK_NAMES), "iU"))).groupBy("name").agg(F.count(F.lit(1)).alias("postings"))
    fresh = counted.withColumn("__n", F.lower("name")).join(
        known.select(F.lower(F.trim("name")).alias("__n")).distinct(), "__n", "left_anti").drop("__n")
    return fresh if limit is None else fresh.orderBy(F.desc("postings"), "name").limit(limit)


# --- store -------------------------------------------------------------------

def diagnostics(postings: DataFrame, apps: DataFrame, version: str) -> DataFrame:
    """State of the store in one row. ``postings``: id, ...; ``apps``: id."""
    incomplete = F.coalesce(T.blank_to_null("title"), F.lit("")).eqNullSafe("") | T.blank_to_null("company").isNull() | T.blank_to_null("url").isNull()
    orphans = apps.join(postings.select("id"), "id", "left_anti").agg(F.count(F.lit(1))).scalar()
    leaks = postings.join(apps.select("id"), "id", "left_semi").agg(F.count(F.lit(1))).scalar()
    current = F.col("score").isNotNull() & (F.col("profile_version") == version)
    total = postings.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(incomplete.cast("int")).alias("bad"), F.sum(current.cast("int")).alias("cur"),
                                       F.sum(F.col("score").isNotNull().cast("int")).alias("sc")).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique_ids"), F.sum("bad").alias("incomplete"),
        F.sum("cur").alias("current_scores"), (F.sum("sc") - F.sum("cur")).alias("stale_scores"))
    return total.withColumns({"duplicates": F.col("total") - F.col("unique_ids"), "orphan_applications": orphans, "applied_in_store": leaks})


def digest(postings: DataFrame, apps: DataFrame, history: DataFrame, last_viewed, now, bar: int = 50) -> DataFrame:
    """What is new since the last look."""
    from .filters import followups_due
    due = followups_due(apps.drop("status").join(last_status(history), "application_id"), now).agg(F.count(F.lit(1))).scalar()
    new = F.col("first_seen").cast("timestamp") > as_of(last_viewed)
    return postings.agg(F.count_if(new).alias("new_jobs_count"), F.count_if(new & (_score() >= bar)).alias("high_matches_count"),
                        F.count(F.lit(1)).alias("total_jobs")).withColumn("followup_applications_count", due)


def scoring_progress(postings: DataFrame, version: str) -> DataFrame:
    """A33"""
    scored = F.col("score").isNotNull()
    return postings.agg(F.count(F.lit(1)).alias("total_jobs"), F.count_if(scored).alias("scored_jobs"), F.count_if(~scored).alias("unscored_jobs"),
                        F.count_if(scored & (F.col("profile_version") == version)).alias("current_version"))


def migration_report(landed: DataFrame, valid: DataFrame, unique: DataFrame, remapped: DataFrame, version: str) -> DataFrame:
    """``remapped``: result of remap_ids."""
    stale = valid.agg(F.count_if(F.col("score").isNotNull() & (F.col("profile_version") != version))).scalar()
    count = unique.agg(F.count(F.lit(1))).scalar()
    apps = remapped.agg(F.count(F.lit(1))).scalar()
    orphans = remapped.agg(F.count_if("orphan")).scalar()
    return landed.agg(
        F.count(F.lit(1)).alias("total_raw"), F.count_if(T.blank_to_null("company").isNull()).alias("missing_company"),
        F.count_if(T.blank_to_null("title").isNull()).alias("missing_title"),
        F.count_if(F.length(F.trim(F.coalesce("url", F.lit("")))) < 5).alias("invalid_url"),
    ).withColumns({"stale_scores": stale, "unique_canonical": count, "migrated_applications": apps, "orphan_applications": orphans})


def location_facets(postings: DataFrame) -> DataFrame:
    """Postings per place after alias folding."""
    return postings.groupBy(T.clean_location("location").alias("place")).agg(F.count(F.lit(1)).alias("postings"))


def keyword_history(log: DataFrame, terms: DataFrame) -> DataFrame:
    """Learned keywords next to the terms in use. ``terms``: term, kind."""
    learned = log.where(F.col("type").contains("keyword"))
    return learned.join(terms.select(F.col("term").alias("new_keyword"), F.lit(True).alias("in_use")).distinct(), "new_keyword", "left") \
        .withColumn("in_use", F.coalesce("in_use", F.lit(False)))


# fixed values: wording of trial and log states
TRIAL_STATES = {"pending": "Pending trial", "confirmed": "Confirmed effective", "reverted": "Reverted - did not help"}
LOG_STATES = {"threshold_reversion": "Reverted - did not help", "threshold_confirmation": "Confirmed effective",
              "threshold_adjustment": "Pending trial"}


def display_status(log: DataFrame) -> DataFrame:
    """State of an improvement by its trial, else by its kind. Needs trial_status, type."""
    out = F.lit("Active")
    for kind, text in LOG_STATES.items():
        out = F.when(F.col("type") == kind, F.lit(text)).otherwise(out)
    for state, text in TRIAL_STATES.items():
        out = F.when(F.col("trial_status") == state, F.lit(text)).otherwise(out)
    return log.withColumn("display_status", out)
