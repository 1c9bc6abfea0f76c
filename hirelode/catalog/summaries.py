"""Queries over the reports A* and the feed Q1."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import dedup as D
from ..operators import joins as J
from ..operators import ranking as O
from ..operators import scoring as C
from ..operators import stats as R
from ..operators import windows as W
from ..plans.feed import FeedConfig, build_feed
from .base import query
from .filtering import ENOW, METRICS_SQL, NOW, PROBES_SQL, last_scans, patterns, probes
from .joining import APPS_SQL, FB_SQL, UNIQUE_SQL, apps_by_posting, legacy_apps, titled_feedback
from .reports import (FM_SQL, LATENCY_SQL, PACE_SQL, PRIOR_SQL, STATS_SQL, STREAK_SQL, confident_scans,
                      filter_metrics, stats)
from .text_fields import ts

FMT = "'%Y-%m-%d %H:%M:%S'"

# --- feed --------------------------------------------------------------------

CONFIG = FeedConfig(
    now=A.NOW, roles=A.TARGET_ROLES, locations=A.TARGET_LOCATIONS, experience=A.TARGET_EXPERIENCE, exclusions=A.EXCLUSIONS,
    hours=24 * 1200, min_score=40, profile_version=A.PROFILE_VERSION)

FEED_SQL = rf"""
u AS (SELECT *, min_yrs IS NULL OR min_yrs <= 2 AS exp_ok FROM (SELECT *, list_min(list_transform(list_concat(list_concat(list_concat(
    regexp_extract_all(title || '  ' || description, '(?i)(\d{{1,2}})\s*(?:-|–|to)\s*\d{{1,2}}\s*\+?\s*(?:years?|yrs?)', 1),
    regexp_extract_all(title || '  ' || description, '(?i)(\d{{1,2}})\s*\+\s*(?:years?|yrs?)', 1)),
    regexp_extract_all(title || '  ' || description, '(?i)(\d{{1,2}})\s*\+?\s*(?:years?|yrs?)\s*(?:of\s+)?experience', 1)),
    regexp_extract_all(title || '  ' || description, '(?i)(?:minimum|at\s+least|requires?)\s+(?:of\s+)?(\d{{1,2}})\s*(?:years?|yrs?)', 1)), lambda v: CAST(v AS INTEGER))) AS min_yrs FROM uq)),
c AS (SELECT u.*, id IN (SELECT id FROM pid WHERE native_id % 50 = 0) AS closed, id IN (SELECT id FROM apps) AS applied,
  CASE WHEN NOT (score IS NOT NULL AND tier <= 2) AND coalesce(score, 50) > 60 AND (length(description) < 140 OR contains(description, 'See posting for details')) THEN 60 ELSE score END AS fscore FROM u),
fl AS (SELECT *, CASE WHEN closed THEN 'closed' WHEN date_diff('second', posted_date, {NOW}) > 24 * 1200 * 3600 THEN 'stale'
  WHEN title NOT IN ('Software Engineer', 'Senior Software Engineer', 'Software Engineer Intern', 'C++ Developer', 'Data Scientist', 'Full Stack Developer - Fresher', 'Backend Developer (Python)') THEN 'role_mismatch'
  WHEN NOT (location IN ('Gurgaon, India', 'Bengaluru, Karnataka', 'Noida Sector 62', 'Remote') OR (location = '' AND regexp_matches(lower(description), '(^|[^\pL\pN_])remote($|[^\pL\pN_])'))) THEN 'location'
  WHEN NOT exp_ok THEN 'experience' WHEN title LIKE 'Senior%' THEN 'seniority_keywords'
  WHEN score IS NULL OR profile_version <> 'v2' THEN CASE WHEN applied THEN 'already_applied' ELSE 'awaiting_scoring' END
  WHEN coalesce(fscore, 50) < CASE WHEN tier <= 2 AND score IS NOT NULL THEN 30 ELSE 40 END THEN 'below_min_score' WHEN applied THEN 'already_applied' END AS failed FROM c)"""


def feed_of(t):
    return build_feed(t.postings, CONFIG, applied=apps_by_posting(t), closed=t.normalized.where("native_id % 50 = 0").select("id"))


@query("q1_build_feed", f"""WITH RECURSIVE {APPS_SQL}, {UNIQUE_SQL}, {FEED_SQL}
SELECT id, company, title, location, fscore AS score, strftime(seen, {FMT}) AS first_seen FROM fl WHERE failed IS NULL""", "pid applications")
def q1(t):
    return feed_of(t).feed().select("id", "company", "title", "location", "score", ts("first_seen").alias("first_seen"))


@query("a1_funnel", f"""WITH RECURSIVE {APPS_SQL}, {UNIQUE_SQL}, {FEED_SQL}
SELECT count(*) FILTER (failed = 'closed') AS dropped_closed, count(*) FILTER (failed = 'stale') AS dropped_stale, count(*) FILTER (failed = 'role_mismatch') AS dropped_role_mismatch,
 count(*) FILTER (failed = 'location') AS dropped_location, count(*) FILTER (failed = 'experience') AS dropped_experience, count(*) FILTER (failed = 'seniority_keywords') AS dropped_seniority_keywords,
 count(*) FILTER (failed = 'awaiting_scoring') AS awaiting_scoring, count(*) FILTER (failed = 'below_min_score') AS dropped_below_min_score, count(*) FILTER (failed = 'already_applied') AS already_applied,
 count(*) FILTER (failed IS NULL) AS shown, (SELECT count(*) FROM postings) AS total_in_store, (SELECT count(*) FROM postings WHERE title = 'Webinar on Cloud') AS dropped_invalid_at_dedup,
 (SELECT count(*) FROM postings) - count(*) AS duplicates_merged FROM fl""", "pid applications")
def a1(t):
    return feed_of(t).breakdown()


# --- cycles ------------------------------------------------------------------

@query("a2_source_counts", "SELECT source, count(*) AS postings FROM postings GROUP BY 1", "postings")
def a2(t):
    return R.source_counts(t.postings)


@query("a3_cycle_summary", """
SELECT (SELECT count(*) FROM pid) AS raw, (SELECT count(*) FROM store) AS deduplicated, count(*) AS filtered, round(avg(score), 1) AS avg_score FROM store WHERE score >= 60""", "store")
def a3(t):
    return R.cycle_summary(t.postings, t.store, t.store.where("score >= 60"))


BUCKET_SQL = """bk AS (SELECT printf('%02d:00-%02d:00', h, h + 3) AS bucket, h FROM (SELECT unnest(range(0, 24, 3)) AS h)),
agg AS (SELECT hour(started_at) // 3 * 3 AS h, count(*) AS samples, round(avg(jobs_found), 1) AS j, round(avg(relevant_found), 1) AS r, avg(jobs_found + 1.5 * relevant_found) AS m FROM {cycles} GROUP BY 1),
yb AS (SELECT bucket, bk.h AS start_hour, coalesce(samples, 0) AS samples, coalesce(j, 0) AS avg_jobs_found, coalesce(r, 0) AS avg_high_relevance,
  CAST(CASE WHEN samples >= 5 THEN least(2.5, greatest(0.3, round(m / (SELECT avg(jobs_found + 1.5 * relevant_found) FROM {cycles}), 2))) ELSE 1.0 END AS DOUBLE) AS yield_multiplier FROM bk LEFT JOIN agg USING (h))"""


@query("a15_yield_by_bucket", f"WITH {BUCKET_SQL.replace('{cycles}', 'cycles')} SELECT bucket, start_hour, samples, avg_jobs_found, avg_high_relevance, yield_multiplier FROM yb", "cycles")
def a15(t):
    return R.yield_by_bucket(t.cycles)


@query("a19_quota_forecast", f"""WITH {BUCKET_SQL.replace('{cycles}', 'cycles')},
k AS (SELECT CAST(sum(100 - user_id % 50) AS BIGINT) AS total_quota_remaining FROM events),
n AS (SELECT round(sum(yield_multiplier) * (SELECT avg(jobs_found) FROM cycles), 1) AS need FROM (SELECT unnest([10, 13, 16, 19, 22]) // 3 * 3 AS start_hour) JOIN yb USING (start_hour))
SELECT total_quota_remaining, need AS estimated_needed_today, 5 AS remaining_cycles_today, CASE WHEN total_quota_remaining < need THEN 'low' ELSE 'healthy' END AS status FROM k, n""", "cycles")
def a19(t):
    keys = t.events.select((100 - F.col("user_id") % 50).alias("quota_remaining"))
    return R.quota_forecast(keys, t.cycles, 10)


# --- applications ------------------------------------------------------------

@query("a5_role_stats", """
WITH f AS (SELECT r AS role, a.* FROM applications a, (VALUES ('Engineer'), ('Data Scientist')) v(r) WHERE contains(lower(job_title), lower(r))),
top AS (SELECT role, company FROM f WHERE status = 'offer' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY role ORDER BY count(*) DESC, company) = 1),
s AS (SELECT role, count(*) AS total_applications, round(count(*) FILTER (status = 'offer') / CAST(count(*) AS DOUBLE), 2) AS success_rate, round_even(avg(salary_offered), 0) AS avg_salary FROM f GROUP BY 1)
SELECT role, total_applications, success_rate, avg_salary, top.company AS most_successful_company,
 'You have ' || CAST(floor(success_rate * 100) AS BIGINT) || '% success rate for ''' || role || '''. Focus on top companies like ' || top.company || '.' AS recommendation FROM s JOIN top USING (role)""", "applications")
def a5(t):
    return R.role_stats(t.applications, ["Engineer", "Data Scientist"]).select(
        "role", "total_applications", "success_rate", "avg_salary", "most_successful_company", "recommendation")


@query("a6_location_stats", """
WITH f AS (SELECT r AS location, a.* EXCLUDE (location) FROM applications a, (VALUES ('Bangalore'), ('Remote')) v(r) WHERE contains(lower(location), lower(r))),
top AS (SELECT location, company FROM f GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY location ORDER BY count(*) DESC, company) = 1)
SELECT location, count(*) AS total_applications, round(count(*) FILTER (status = 'offer') / CAST(count(*) AS DOUBLE), 2) AS success_rate, round_even(avg(salary_offered), 0) AS avg_salary, any_value(top.company) AS top_company
FROM f JOIN top USING (location) GROUP BY 1""", "applications")
def a6(t):
    return R.location_stats(t.applications, ["Bangalore", "Remote"]).select("location", "total_applications", "success_rate", "avg_salary", "top_company")


@query("a7_timeline", f"""WITH {LATENCY_SQL}
SELECT count(*) AS total_applications, count(*) FILTER (applied_at >= {NOW} - INTERVAL 7 DAY) AS applications_this_week, count(*) FILTER (applied_at >= {NOW} - INTERVAL 30 DAY) AS applications_this_month,
 (SELECT round_even(avg(doo), 0) FROM latency) AS avg_days_to_offer FROM applications""", "applications status_history")
def a7(t):
    return R.timeline(t.applications, t.status_history, A.NOW)


TOP_SQL = "(SELECT {c} FROM applications WHERE status = 'offer' GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1)"


@query("a8_dashboard", f"""
SELECT count(*) AS total_applications, count(*) FILTER (status = 'offer') AS total_offers, count(*) FILTER (status = 'rejected') AS total_rejections, count(referral_source) AS total_referrals,
 count(*) FILTER (status = 'applied') AS applied, round((count(*) FILTER (status = 'offer') + count(referral_source)) / CAST(count(*) AS DOUBLE), 2) AS overall_success_rate,
 {TOP_SQL.replace('{c}', 'company')} AS top_company, {TOP_SQL.replace('{c}', 'job_title')} AS top_role, {TOP_SQL.replace('{c}', 'location')} AS top_location FROM applications""", "applications")
def a8(t):
    return R.dashboard(t.applications).select("total_applications", "total_offers", "total_rejections", "total_referrals", "applied",
                                              "overall_success_rate", "top_company", "top_role", "top_location")


@query("a9_wow", f"""
WITH a AS (SELECT floor(date_diff('second', applied_at, {NOW}) / 86400.0) AS d FROM applications), c AS (SELECT count(*) FILTER (d BETWEEN 0 AND 7) AS this_week, count(*) FILTER (d > 7 AND d <= 14) AS last_week FROM a)
SELECT this_week, last_week, CASE WHEN last_week > 0 THEN round((this_week - last_week) / CAST(last_week AS DOUBLE) * 100, 1) WHEN this_week > 0 THEN 100 ELSE 0 END AS percent_change FROM c""", "applications")
def a9(t):
    return R.wow(t.applications, A.NOW)


@query("a37_insights", """
WITH r AS (SELECT round((count(*) FILTER (contains(company, 'a8') AND status = 'offer') + count(referral_source) FILTER (contains(company, 'a8'))) / CAST(count(*) FILTER (contains(company, 'a8')) AS DOUBLE), 2) AS c,
 round(count(*) FILTER (job_title = 'Software Engineer' AND status = 'offer') / CAST(count(*) FILTER (job_title = 'Software Engineer') AS DOUBLE), 2) AS r,
 round(count(*) FILTER (location = 'Bangalore' AND status = 'offer') / CAST(count(*) FILTER (location = 'Bangalore') AS DOUBLE), 2) AS l, avg(salary_offered) AS s, count(*) AS n,
 count(*) FILTER (status = 'offer') AS o, count(*) FILTER (status = 'rejected') AS x FROM applications)
SELECT * FROM (SELECT 'company' AS type, 'high' AS priority, 'a8' AS subject, 'success_rate' AS measure, c AS value FROM r
UNION ALL SELECT 'role', 'high', 'Software Engineer', 'success_rate', r FROM r UNION ALL SELECT 'location', 'medium', 'Bangalore', 'success_rate', l FROM r
UNION ALL SELECT 'salary', 'medium', 'all', 'avg_salary_offered', round(s, 2) FROM r UNION ALL SELECT 'general', 'high', 'all', 'applications', n FROM r
UNION ALL SELECT 'general', 'high', 'all', 'offers', o FROM r UNION ALL SELECT 'general', 'high', 'all', 'interviews', 0 FROM r UNION ALL SELECT 'general', 'high', 'all', 'rejections', x FROM r) WHERE value IS NOT NULL""", "applications")
def a37(t):
    return R.insights(t.applications, "a8", "Software Engineer", "Bangalore")


# --- accuracy and feedback ---------------------------------------------------

@query("a10_efficiency", f"""WITH {METRICS_SQL}, {FM_SQL},
p AS (SELECT company_id, count(error) AS f FROM scan_log GROUP BY 1),
x AS (SELECT (SELECT avg(round(successful_scans / CAST(total_scans AS DOUBLE), 2)) * 100 FROM metrics) AS a, (SELECT count(*) FILTER (score >= 70) / CAST(count(*) AS DOUBLE) * 100 FROM store) AS b,
 (SELECT avg(precision * 100) FROM fm) AS c, (SELECT count(*) FILTER (f < 3) / CAST(count(*) AS DOUBLE) * 100 FROM p) AS d)
SELECT round(a, 1) AS parsing_accuracy_avg, round(b, 1) AS high_confidence_ratio, round(c, 1) AS filter_precision_avg, round(d, 1) AS pattern_health_ratio, round(a * 0.25 + b * 0.3 + c * 0.25 + d * 0.2, 1) AS efficiency_score FROM x""", "store scan_log feedback")
def a10(t):
    return R.efficiency(R.scan_metrics(last_scans(t)), t.store, filter_metrics(t), patterns(t))


@query("a11_worst_case", """
WITH f AS (SELECT count(*) FILTER (job_match_score >= 75) AS h, count(*) FILTER (job_match_score >= 75 AND action = 'no') AS m FROM feedback), s AS (SELECT count(*) AS n FROM store WHERE score >= 75)
SELECT m AS confident_misses, greatest(h, n) AS high_confidence_total, round(1 - m / CAST(greatest(h, n) AS DOUBLE), 2) AS accuracy, CASE WHEN m = 0 THEN 'improving' WHEN m > 2 THEN 'declining' ELSE 'stable' END AS trend FROM f, s""", "store feedback")
def a11(t):
    return R.worst_case(t.feedback, t.store)


@query("a11_worst_case_examples", "SELECT feedback_id, job_match_score FROM feedback WHERE action = 'no' AND job_match_score >= 75", "feedback")
def a11b(t):
    return R.worst_case_examples(t.feedback).select("feedback_id", "job_match_score")


def improvement_log(t):
    return titled_feedback(t).select(
        "feedback_id", F.when(F.col("action") == "yes", F.lit("keyword_learned")).otherwise(F.lit("threshold_adjustment")).alias("type"),
        F.lit("target_role").alias("filter"), F.col("job_title").alias("new_keyword"),
        F.concat(F.lit("adj_"), F.col("feedback_id").cast("string")).alias("adjustment_id"))


@query("a12_trending_keywords", f"WITH {FB_SQL} SELECT job_title AS skill, count(*) AS count, CAST(least(45.0, round(count(*) * 8.5, 1)) AS DOUBLE) AS percent_growth FROM fb WHERE action = 'yes' GROUP BY 1", "postings feedback")
def a12(t):
    return R.trending_keywords(improvement_log(t))


@query("a13_feedback_summary", "SELECT count(*) AS total_feedback, count(*) FILTER (action = 'yes') AS positive, count(*) FILTER (action = 'no') AS negative, round(count(*) FILTER (action = 'yes') / CAST(count(*) AS DOUBLE), 2) AS precision FROM feedback", "feedback")
def a13(t):
    return R.feedback_summary(t.feedback)


@query("a14_feedback_patterns", f"""WITH {FB_SQL}
SELECT 'data' AS pattern, count(*) AS hits FROM fb WHERE action = 'yes' AND contains(lower(job_title), 'data') HAVING count(*) >= 2
UNION ALL SELECT 'backend', count(*) FROM fb WHERE action = 'yes' AND (contains(lower(job_title), 'backend') OR contains(lower(job_title), 'python')) HAVING count(*) >= 3
UNION ALL SELECT 'experience', count(*) FROM fb WHERE action = 'no' AND contains(reason, 'senior') HAVING count(*) >= 2""", "postings feedback")
def a14(t):
    return R.feedback_patterns(titled_feedback(t)).select("pattern", "hits")


@query("a16_predict_relevance", f"""WITH {STATS_SQL}, {FB_SQL},
k AS (SELECT DISTINCT company, title FROM postings),
past AS (SELECT company, avg(score) AS mean FROM postings GROUP BY 1),
kt AS (SELECT company, title, unnest(list_distinct(regexp_extract_all(lower(title || ' ' || company), '\\w+'))) AS w FROM k),
ft AS (SELECT feedback_id, action, unnest(list_distinct(regexp_extract_all(lower(job_title || ' ' || company), '\\w+'))) AS w FROM fb),
ov AS (SELECT company, title, count(*) AS total, count(*) FILTER (action = 'yes') AS yes FROM (SELECT DISTINCT company, title, feedback_id, action FROM kt JOIN ft USING (w)) GROUP BY 1, 2)
SELECT k.company, k.title, round(CAST(0.4 AS DOUBLE) * CASE WHEN total_applications > 0 THEN least(1, success_rate) ELSE 0.5 END + CAST(0.3 AS DOUBLE) * coalesce(mean / 100, 0.5)
 + CAST(0.3 AS DOUBLE) * coalesce(ov.yes / CAST(ov.total AS DOUBLE), (SELECT count(*) FILTER (action = 'yes') / CAST(count(*) AS DOUBLE) FROM fb)), 6) AS relevance
FROM k LEFT JOIN stats ON stats.company = k.company LEFT JOIN past ON past.company = k.company LEFT JOIN ov ON ov.company = k.company AND ov.title = k.title""", "postings applications status_history feedback")
def a16(t):
    return R.predict_relevance(t.postings, stats(t), t.postings, titled_feedback(t), digits=6)


@query("a32_personalization_stats", "SELECT count(*) AS total_feedback_count, count(*) >= 5 AS personalization_active, (SELECT count(*) FROM events WHERE value >= 100) AS jobs_scored_with_personalization, least(count(*), 5) AS recent_examples_injected FROM feedback", "feedback")
def a32(t):
    return R.personalization_stats(t.feedback, t.events.select((F.col("value") / 100).cast("int").alias("examples_used")))


# --- usage -------------------------------------------------------------------

@query("a17_usage_pacing", f"WITH {PACE_SQL} SELECT ratio AS pace_ratio, CAST(CASE WHEN ratio < 0.7 THEN 0.03 WHEN ratio > 1.2 THEN -0.03 ELSE 0 END AS DOUBLE) AS modifier FROM pace", "usage_log")
def a17(t):
    return R.usage_pacing(t.usage_log, A.EVENT_NOW, 5000.0).select("pace_ratio", "modifier")


@query("a18_spend_status", """
WITH s AS (SELECT round(sum(credits) FILTER (called_at >= TIMESTAMP '2024-01-29' AND called_at < TIMESTAMP '2024-01-30'), 4) AS d, round(sum(credits), 4) AS m FROM usage_log)
SELECT d AS spent_today, m AS spent_month, d >= 1.5 AS daily_cap_reached, m >= 100000 AS monthly_cap_reached FROM s""", "usage_log")
def a18(t):
    return R.spend_status(t.usage_log, "2024-01-29 12:00:00", 1.5, 100000.0)


def scoring_log(t):
    return t.events.select(F.col("ts").alias("scored_at"), (F.col("user_id") % 6 + 1).alias("tier"), F.col("event_type").alias("model"), (F.col("value") / 10).alias("seconds"))


@query("a25_tier_stats", """
SELECT user_id % 6 + 1 AS tier, event_type AS model, count(*) AS scored, round(avg(value / 10), 2) AS avg_seconds FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16' GROUP BY ROLLUP (1, 2)""")
def a25(t):
    return R.tier_stats(scoring_log(t), "2024-01-15 00:00:00")


@query("a20_consensus_stats", """
WITH c AS (SELECT s.*, abs(score - second) > 20 AS dis FROM (SELECT first_seen, coalesce(score, 50) AS score, native_id % 101 AS second FROM store) s WHERE score BETWEEN 40 AND 60)
SELECT count(*) AS total_verified, count(*) FILTER (first_seen >= TIMESTAMP '1999-01-05' AND first_seen < TIMESTAMP '1999-01-06') AS verified_today, count(*) FILTER (dis) AS disputed_count, round(count(*) FILTER (NOT dis) / CAST(count(*) AS DOUBLE) * 100, 1) AS agreement_rate_percent FROM c""", "store")
def a20(t):
    log = C.consensus(t.store, t.store.select("id", (F.col("native_id") % 101).alias("score"))).join(t.store.select("id", F.col("first_seen").alias("at")), "id")
    return R.consensus_stats(log, "1999-01-05 00:00:00")


@query("a21_pattern_health", f"""WITH p AS (SELECT company_id, count(error) AS f FROM scan_log GROUP BY 1)
SELECT count(*) AS total_patterns, count(*) FILTER (f < 3) AS active_patterns, count(*) FILTER (f >= 3) AS stale_patterns, (SELECT strftime(max(scanned_at), {FMT}) FROM scan_log WHERE method = 'stored_pattern') AS last_revalidation FROM p""", "scan_log")
def a21(t):
    return R.pattern_health(patterns(t), t.scan_log.where("method = 'stored_pattern'").select(F.col("scanned_at").alias("at"))) \
        .withColumn("last_revalidation", ts("last_revalidation"))


# --- companies and discovery -------------------------------------------------

def discovery_cycles(t):
    """One discovery cycle per day: probed boards, admissions and rejections by reason."""
    day = F.date_trunc("day", "scanned_at")
    by_reason = t.scan_log.withColumn("reason", F.when(F.col("error").isNotNull(), F.lit("timeout")).when(F.col("jobs_found") < 3, F.lit("too few openings"))
                                      .when(F.col("fresher_found") == 0, F.lit("no fresher openings"))).groupBy(day.alias("finished_at"), "reason").agg(
        F.count(F.lit(1)).alias("n"), F.collect_set(F.when((F.col("jobs_found") > 27) & (F.col("fresher_found") > 0), F.col("company_id"))).alias("ids"))
    return by_reason.groupBy("finished_at").agg(
        F.sum("n").alias("candidates_probed"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("added"),
        F.map_from_entries(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))).alias("rejections"))


@query("a22_company_target", f"""WITH {STREAK_SQL},
c AS (SELECT count(*) AS total, count(*) FILTER (s.company_id IS NOT NULL) AS scanned, count(*) FILTER (jobs > 0) AS producing, count(*) FILTER (fresher_total > 0 AND fresher_streak = 0) AS fa FROM companies c LEFT JOIN streak s USING (company_id)),
r AS (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS adds FROM (SELECT date_trunc('day', scanned_at) AS d, count(DISTINCT company_id) AS n FROM scan_log WHERE jobs_found > 27 AND fresher_found > 0 AND error IS NULL GROUP BY 1) WHERE d >= {ENOW} - INTERVAL 14 DAY),
n AS (SELECT *, CASE WHEN fa / CAST(total AS DOUBLE) < 0.95 THEN CAST(floor((CAST(0.95 AS DOUBLE) * total - fa) / (1 - CAST(0.95 AS DOUBLE))) + 1 AS BIGINT) ELSE 0 END AS need FROM c, r)
SELECT total AS total_companies, scanned AS scanned_at_least_once, producing AS producing_jobs, fa AS fresher_active, need AS companies_needed, adds AS recent_adds_14d, round(fa / CAST(total AS DOUBLE) * 100, 1) AS fresher_active_pct,
 CASE WHEN adds > 0 AND need > 0 THEN CAST(floor(need / (adds / 14.0)) AS BIGINT) END AS eta_days FROM n""", "companies scan_log")
def a22(t):
    streaks = R.scan_streaks(t.scan_log).withColumn("fresher_zero_streak", F.when(F.col("fresher_zero_streak") > 0, F.lit(9)).otherwise(F.lit(0)))
    return R.company_target(t.companies, streaks, discovery_cycles(t), A.EVENT_NOW, 0.95)


@query("a23_discovery_summary", f"""WITH {PROBES_SQL}, r AS (SELECT reason, count(*) AS n FROM gated WHERE reason IS NOT NULL GROUP BY 1)
SELECT count(*) AS candidates_probed, count(*) FILTER (reason IS NULL AND fresher_jobs >= 3) AS verified, count(*) FILTER (reason IS NULL AND fresher_jobs < 3) AS watchlisted,
 (SELECT string_agg(reason || '=' || n, ',' ORDER BY reason) FROM r) AS rejections FROM gated""", "pid")
def a23(t):
    from ..operators.filters import admission_gate
    return R.discovery_summary(admission_gate(probes(t), 3)).withColumn("rejections", F.array_join(F.transform(
        F.map_entries("rejections"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query("a24_weekly_review", f"""
WITH d AS (SELECT date_trunc('day', scanned_at) AS d, CASE WHEN error IS NOT NULL THEN 'timeout' WHEN jobs_found < 3 THEN 'too few openings' WHEN fresher_found = 0 THEN 'no fresher openings' END AS reason FROM scan_log WHERE date_trunc('day', scanned_at) >= {ENOW} - INTERVAL 7 DAY)
SELECT reason, count(*) AS rejected, (SELECT count(*) FROM d) AS probed FROM d WHERE reason IS NOT NULL GROUP BY 1""", "scan_log")
def a24(t):
    return R.weekly_review(discovery_cycles(t), A.EVENT_NOW)


@query("a26_diagnostics", f"""WITH {APPS_SQL}
SELECT count(*) AS total, count(DISTINCT id) AS unique_ids, 0::BIGINT AS incomplete, count(*) FILTER (score IS NOT NULL AND profile_version = 'v2') AS current_scores, count(*) FILTER (score IS NOT NULL AND profile_version <> 'v2') AS stale_scores,
 count(*) - count(DISTINCT id) AS duplicates, (SELECT count(*) FROM apps WHERE id NOT IN (SELECT id FROM pid)) AS orphan_applications, (SELECT count(*) FROM pid WHERE id IN (SELECT id FROM apps)) AS applied_in_store
FROM pid""", "pid applications")
def a26(t):
    return R.diagnostics(t.normalized, apps_by_posting(t), "v2")


@query("a27_scan_report", f"""WITH {METRICS_SQL}
SELECT ats, count(*) AS companies, count(*) FILTER (successful_scans > 0 AND jobs_extracted > 0) AS succeeded, count(*) - count(*) FILTER (successful_scans > 0 AND jobs_extracted > 0) AS failed,
 CAST(coalesce(sum(jobs_extracted), 0) AS BIGINT) AS jobs_extracted, round(avg(round(successful_scans / CAST(total_scans AS DOUBLE), 2)), 4) AS mean_accuracy FROM companies LEFT JOIN metrics USING (company_id) GROUP BY 1""", "companies scan_log")
def a27(t):
    return R.scan_report(t.companies, R.scan_metrics(last_scans(t)))


@query("a28_flip_report", """
WITH m AS (SELECT company_id, CASE WHEN scanned_at < TIMESTAMP '2024-01-02' THEN 'b' ELSE 'a' END AS half, CASE WHEN error IS NULL THEN jobs_found ELSE 0 END AS j FROM scan_log)
SELECT company_id, CAST(coalesce(sum(j) FILTER (half = 'b'), 0) AS BIGINT) AS jobs_before, CAST(coalesce(sum(j) FILTER (half = 'a'), 0) AS BIGINT) AS jobs_after,
 coalesce(sum(j) FILTER (half = 'b'), 0) = 0 AND coalesce(sum(j) FILTER (half = 'a'), 0) > 0 AS flipped FROM m GROUP BY 1""", "scan_log")
def a28(t):
    return R.flip_report(R.scan_metrics(t.scan_log.where("scanned_at < timestamp'2024-01-02 00:00:00'")),
                         R.scan_metrics(t.scan_log.where("scanned_at >= timestamp'2024-01-02 00:00:00'")))


@query("a29_failure_categories", f"""WITH {METRICS_SQL}
SELECT company_id, CASE WHEN last_error = 'Timeout' THEN 'broken_url' ELSE 'no_current_openings' END AS category, coalesce(last_error, '0 jobs found on page using heuristic extraction') AS reason
FROM companies LEFT JOIN metrics USING (company_id) WHERE coalesce(successful_scans, 0) = 0 OR jobs_extracted = 0""", "companies scan_log")
def a29(t):
    return R.failure_categories(t.companies, R.scan_metrics(last_scans(t))).select("company_id", "category", "reason")


@query("a30_digest", f"""
WITH h AS (SELECT application_id, arg_max(status, struct_pack(a := step, b := "at", c := status)) AS st, arg_max("at", struct_pack(a := step, b := "at", c := status)) AS last FROM status_history GROUP BY 1)
SELECT count(*) FILTER (first_seen > TIMESTAMP '2000-01-01') AS new_jobs_count, count(*) FILTER (first_seen > TIMESTAMP '2000-01-01' AND coalesce(score, 0) >= 50) AS high_matches_count, count(*) AS total_jobs,
 (SELECT count(*) FROM h WHERE st = 'interviewed' AND floor(date_diff('second', last, {NOW}) / 86400.0) >= 5) AS followup_applications_count FROM store""", "store status_history")
def a30(t):
    return R.digest(t.store, t.applications, t.status_history, "2000-01-01 00:00:00", A.NOW)


@query("a31_scan_metrics", f"""
SELECT company_id, count(*) AS total_scans, count(*) FILTER (error IS NULL AND jobs_found > 0) AS successful_scans, CAST(coalesce(sum(jobs_found) FILTER (error IS NULL), 0) AS BIGINT) AS jobs_extracted, strftime(max(scanned_at), {FMT}) AS last_scan,
 arg_max(method, struct_pack(a := scanned_at, b := scan_id)) AS extraction_method, CAST(sum(fresher_found) AS BIGINT) AS fresher_jobs_total, arg_max(fresher_found, struct_pack(a := scanned_at, b := scan_id)) AS fresher_jobs_last_scan,
 round(count(*) FILTER (error IS NULL AND jobs_found > 0) / CAST(count(*) AS DOUBLE), 2) AS parsing_accuracy FROM scan_log GROUP BY 1""", "scan_log")
def a31(t):
    return R.scan_metrics(t.scan_log).drop("last_error").withColumn("last_scan", ts("last_scan"))


@query("a33_scoring_progress", "SELECT count(*) AS total_jobs, count(score) AS scored_jobs, count(*) - count(score) AS unscored_jobs, count(score) FILTER (profile_version = 'v2') AS current_version FROM store", "store")
def a33(t):
    return R.scoring_progress(t.store, "v2")


@query("a34_migration_report", """
WITH r AS (SELECT coalesce(CASE WHEN posting_id % 5 <> 0 THEN p.id END, 'old-' || posting_id) AS id FROM applications a LEFT JOIN pid p ON p.native_id = a.posting_id)
SELECT count(*) AS total_raw, count(*) FILTER (native_id % 4 = 0) AS missing_company, 0::BIGINT AS missing_title, 0::BIGINT AS invalid_url, count(*) FILTER (score IS NOT NULL AND profile_version <> 'v2') AS stale_scores,
 (SELECT count(*) FROM store) AS unique_canonical, (SELECT count(DISTINCT id) FROM r) AS migrated_applications, (SELECT count(DISTINCT id) FROM r WHERE id NOT IN (SELECT id FROM store)) AS orphan_applications FROM pid""", "store applications")
def a34(t):
    deps = t.applications.withColumn("id", F.concat(F.lit("old-"), F.col("posting_id").cast("string")))
    id_map = t.normalized.where("native_id % 5 <> 0").select(F.concat(F.lit("old-"), F.col("native_id").cast("string")).alias("old_id"), "id")
    landed = t.postings.withColumn("company", F.when(F.col("native_id") % 4 != 0, F.col("company")))
    return R.migration_report(landed, t.postings, t.store, J.remap_ids(deps, id_map, t.store, "application_id"), "v2")


@query("a35_threshold_impact", f"WITH {PRIOR_SQL} SELECT count(*) FILTER (round(parse_confidence, 2) BETWEEN 0.75 AND 0.8) AS affected, round(count(*) FILTER (round(parse_confidence, 2) BETWEEN 0.75 AND 0.8) * 30.0 / 300, 1)::DOUBLE AS added_minutes FROM conf", "scan_log")
def a35(t):
    return R.threshold_impact(confident_scans(t), 0.80, 0.75)


@query("a36_mine_companies", """
SELECT company AS name, count(*) AS postings FROM postings WHERE lower(company) NOT IN (SELECT lower(company) FROM applications) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40""", "postings applications")
def a36(t):
    return R.mine_companies(t.postings, t.applications.select(F.col("company").alias("name")), 40)


@query("a38_location_facets", "SELECT nlocation AS place, count(*) AS postings FROM pid GROUP BY 1", "pid")
def a38(t):
    return R.location_facets(t.postings)


@query("a39_keyword_history", f"WITH {FB_SQL} SELECT feedback_id, job_title AS new_keyword, job_title IN ('Software Engineer', 'Data Scientist', 'SDE 2') AS in_use FROM fb WHERE action = 'yes'", "postings feedback")
def a39(t):
    terms = t.postings.where("title IN ('Software Engineer', 'Data Scientist', 'SDE 2')").select(F.col("title").alias("term")).distinct()
    return R.keyword_history(improvement_log(t), terms).select("feedback_id", "new_keyword", "in_use")


@query("p22_display_status", """
SELECT f.feedback_id, CASE WHEN feedback_id % 3 = 0 THEN CASE WHEN feedback_id % 7 = 0 THEN 'Confirmed effective' WHEN feedback_id % 11 = 0 THEN 'Reverted - did not help' ELSE 'Pending trial' END
 WHEN action = 'yes' THEN 'Active' ELSE 'Pending trial' END AS display_status FROM feedback f JOIN postings p ON p.native_id = f.posting_native_id""", "postings feedback")
def p22(t):
    from .filtering import trials
    return R.display_status(J.improvements_with_trials(improvement_log(t), trials(t).where("threshold_name = 'role_filter'"))).select("feedback_id", "display_status")
