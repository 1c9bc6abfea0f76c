"""Running values, streaks and per-key order, split so that no key fills one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import fields as V
from ..session import with_global_rank


def running(df: DataFrame, keys: list[str], ts: str, tie: str, sums: dict[str, Column], inclusive: bool = True,
            span: str = "hour") -> DataFrame:
    """Running sums per key in (ts, tie) order, for keys of any size.

    Rows are summed inside (key, time span); the spans of a key, few rows
    each, carry the totals before them.  ``span`` bounds what one task sorts.
    """
    spanned = df.withColumns({"__span": F.date_trunc(span, ts), **{f"__v_{n}": c for n, c in sums.items()}})
    w = Window.partitionBy(*keys, "__span").orderBy(ts, tie)
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inside = spanned.withColumns({f"__in_{n}": F.coalesce(F.sum(f"__v_{n}").over(frame), F.lit(0)) for n in sums})
    totals = spanned.groupBy(*keys, "__span").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, "__span", *[
        F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    joined = inside.join(carried, [*keys, "__span"])
    return joined.withColumns({n: F.col(f"__in_{n}") + F.col(f"__b_{n}") for n in sums}).drop(
        "__span", *[f"__{p}_{n}" for n in sums for p in ("v", "in", "b")])


def last_before(df: DataFrame, keys: list[str], order: list[str], ts: str, value: Column, name: str, span: str = "day") -> DataFrame:
    """Adds ``name``: the largest ``value`` of the rows of a key up to and including each one, for keys of any size.

    As in ``running``, rows are ordered inside (key, time span) only, and the spans of a
    key carry the largest value of those before them.
    """
    spanned = df.withColumns({"__span": F.date_trunc(span, ts), "__value": value})
    inside = Window.partitionBy(*keys, "__span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spanned.groupBy(*keys, "__span").agg(F.max("__value").alias("__most")).select(*keys, "__span", F.max("__most").over(before).alias("__before"))
    joined = spanned.withColumn("__in", F.max("__value").over(inside)).join(carried, [*keys, "__span"])
    return joined.withColumn(name, F.greatest("__in", "__before")).drop("__span", "__value", "__in", "__before")


def rank_companies(companies: DataFrame) -> DataFrame:
    """Scan order 1..n with the reason."""
    pref = F.coalesce("preference", F.lit(0.5))
    success = F.coalesce("success_rate", F.lit(0.0))
    salary = F.coalesce("avg_salary", F.lit(0.0))
    difficulty = F.coalesce("difficulty", F.lit(0.8))
    ranked = with_global_rank(
        companies.withColumns({"__p": -pref, "__s": -success, "__m": -salary, "__d": difficulty}),
        F.col("__p"), F.col("__s"), F.col("__m"), F.col("__d"), F.col("company_id"))
    return ranked.withColumn("reason", F.format_string(
        "preference %.2f + success %.0f%% + salary %.0f + difficulty %.1f",
        -F.col("__p"), -F.col("__s") * 100, -F.col("__m"), F.col("__d"))).drop("__p", "__s", "__m", "__d")


def running_spend(usage: DataFrame) -> DataFrame:
    """Credits spent so far in the month of each call."""
    return running(usage.withColumn("month", V.month_key("called_at")), ["month"], "called_at", "call_id",
                   {"running_monthly_total": F.col("credits")})


def _streak(scan_log: DataFrame, good: Column, streak: str, last: str) -> DataFrame:
    """Scans since the last good one, per company: two aggregates instead of a window."""
    flagged = scan_log.withColumn("__good", good)
    latest = flagged.groupBy("company_id").agg(
        F.max(F.when(F.col("__good"), F.struct("scanned_at", "scan_id"))).alias("__last"))
    return flagged.join(latest, "company_id").groupBy("company_id").agg(
        F.count_if(F.col("__last").isNull() | (F.struct("scanned_at", "scan_id") > F.col("__last"))).alias(streak),
        F.max("__last.scanned_at").alias(last))


def zero_yield_streak(scan_log: DataFrame) -> DataFrame:
    """W3"""
    return _streak(scan_log, F.col("jobs_found") > 0, "zero_yield_streak", "last_success_at")


def fresher_streak(scan_log: DataFrame) -> DataFrame:
    """W4"""
    return _streak(scan_log, F.col("fresher_found") > 0, "fresher_zero_streak", "last_fresher_at")


def prior_avg_yield(scan_log: DataFrame) -> DataFrame:
    """Mean postings per scan before each scan; 0 before the first."""
    counted = running(scan_log, ["company_id"], "scanned_at", "scan_id",
                      {"__jobs": F.col("jobs_found"), "__scans": F.lit(1)}, inclusive=False)
    return counted.withColumn("prior_avg", F.when(F.col("__scans") > 0, F.col("__jobs") / F.col("__scans")).otherwise(0.0)) \
        .drop("__jobs", "__scans")


def rpm_window(calls: DataFrame, limit: int) -> DataFrame:
    """Calls of the key in the minute up to each call, and whether the limit is reached.

    The minute before a call lies in its own clock minute and the one
    before, so each (key, minute) is counted apart, with the previous
    minute's rows copied in as history.
    """
    minute = F.floor(F.unix_micros("called_at") / 60_000_000)
    copies = calls.withColumn("__minute", minute).withColumn("__home", F.explode(F.array(F.lit(True), F.lit(False)))) \
        .withColumn("__part", F.col("__minute") + F.when(F.col("__home"), 0).otherwise(1))
    w = Window.partitionBy("key_id", "__part").orderBy(F.unix_micros("called_at")).rangeBetween(-59_999_999, 0)
    return copies.withColumn("calls_last_60s", F.count(F.lit(1)).over(w)).where("__home") \
        .withColumn("limited", F.col("calls_last_60s") >= limit).drop("__minute", "__home", "__part")


def failure_backoff(calls: DataFrame, cooldown: int = 120, cap: int = 3600) -> DataFrame:
    """Consecutive failures of a key at each failure, and its rest in seconds.

    The streak is the number of failures minus the number at the last success,
    both running counts, so a key's history never gathers in one task.
    """
    counted = running(calls, ["key_id"], "called_at", "call_id", {
        "__fails": F.when(F.col("failed"), 1).otherwise(0)})
    at_success = F.when(~F.col("failed"), F.col("__fails"))
    hour = F.date_trunc("hour", "called_at")
    marked = counted.withColumns({"__ok_fails": at_success, "__hour": hour})
    inside = Window.partitionBy("key_id", "__hour").orderBy("called_at", "call_id").rowsBetween(Window.unboundedPreceding, 0)
    hourly = marked.groupBy("key_id", "__hour").agg(F.max("__ok_fails").alias("__hour_max"))
    before = Window.partitionBy("key_id").orderBy("__hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = hourly.select("key_id", "__hour", F.coalesce(F.max("__hour_max").over(before), F.lit(0)).alias("__before"))
    streaks = marked.withColumn("__in", F.max("__ok_fails").over(inside)).join(carried, ["key_id", "__hour"]) \
        .withColumn("consecutive_failures", F.col("__fails") - F.coalesce("__in", "__before"))
    exponent = F.least(F.col("consecutive_failures") - 1, F.lit(20))
    return streaks.where("failed").withColumn(
        "backoff_seconds", F.least(F.lit(float(cap)), F.lit(float(cooldown)) * F.pow(F.lit(2.0), exponent))) \
        .drop("__fails", "__ok_fails", "__hour", "__in", "__before")


def last_status(history: DataFrame) -> DataFrame:
    """Latest entry of each application: status and last_history_at."""
    return history.groupBy("application_id").agg(F.max(F.struct("step", "at", "status")).alias("last")).select(
        "application_id", "last.status", F.col("last.at").alias("last_history_at"))


def status_latency(history: DataFrame) -> DataFrame:
    """Days from the last 'applied' to the last interview and offer; negative spans are ignored."""
    def last_at(*kinds: str) -> Column:
        return F.max(F.when(F.col("status").isin(*kinds), F.struct("step", "at")))["at"]

    times = history.groupBy("application_id").agg(
        last_at("applied").alias("__a"), last_at("interviewed").alias("__i"), last_at("offer", "accepted").alias("__o"))

    def span(end: str) -> Column:
        d = V.days_between("__a", end)
        return F.when(d >= 0, d)

    return times.select("application_id", span("__i").alias("days_to_interview"), span("__o").alias("days_to_offer"))


def best_match(versions: DataFrame) -> DataFrame:
    """Best match per id over writers: verified beats others, present beats missing, later writer wins."""
    paid = F.coalesce(F.col("tier").isin(rules.VERIFIED_TIERS), F.lit(False)) & F.col("score").isNotNull()
    order = F.struct(paid, F.col("score").isNotNull(), F.col("writer"))
    return versions.groupBy("id").agg(F.max_by(F.struct(*[c for c in versions.columns if c != "id"]), order).alias("r")) \
        .select("id", "r.*")


def recency_bonus(feedback: DataFrame, order: str) -> DataFrame:
    """0.1 per position in the log."""
    ranked = with_global_rank(feedback, F.col(order), name="__pos")
    return ranked.withColumn("recency_bonus", (F.col("__pos") - 1) * 0.1).drop("__pos")


def daily_cap(df: DataFrame, n: int, day: str, *order: Column) -> DataFrame:
    """First n rows of each day; tasks pass on only their own best n."""
    w = Window.partitionBy(day).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def watch_history(probes: DataFrame) -> DataFrame:
    """Probe history per company."""
    last = F.struct("checked_at", "probe_id")
    return probes.groupBy("name").agg(
        F.count(F.lit(1)).alias("checks"), F.max("fresher_jobs").alias("best_fresher_seen"),
        F.min("checked_at").alias("first_seen"), F.max("checked_at").alias("last_checked"),
        F.max_by("india_jobs", last).alias("last_india_jobs"), F.max_by("fresher_jobs", last).alias("last_fresher_jobs"))


# fixed values: which status may follow which
TRANSITIONS = {
    "applied": ["interviewed", "pending", "rejected", "offer", "referral", "archived"],
    "pending": ["interviewed", "rejected", "offer", "referral", "archived"],
    "interviewed": ["offer", "rejected", "accepted", "referral", "archived"],
    "offer": ["accepted", "rejected", "archived"],
    "referral": ["applied", "interviewed", "offer", "rejected", "pending", "archived"],
    "accepted": ["archived"],
    "rejected": ["archived"],
    "archived": [],
}


def transition_legal(before: Column, after: Column) -> Column:
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (
        F.lit(k), F.array(*[F.lit(s) for s in v]) if v else F.array().cast("array<string>"))])
    known = after.isin(list(TRANSITIONS))
    listed = F.coalesce(F.array_contains(F.element_at(table, before), after), F.lit(False))
    return known & ((before == after) | after.isin("referral", "archived") | listed)


def transition_audit(history: DataFrame) -> DataFrame:
    """Each status with the one before it and whether the step is allowed."""
    w = Window.partitionBy("application_id").orderBy("step", "at", "status")
    return history.withColumn("previous", F.lag("status").over(w)).where("previous IS NOT NULL") \
        .withColumn("legal", transition_legal(F.lower("previous"), F.lower("status")))
