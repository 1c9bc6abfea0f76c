"""Queries over scores C*, reports A*, windows W*, orders O*, vectors V* and evaluation E*."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import fields as V
from ..functions import skills as S
from ..operators import evaluation as E
from ..operators import filters as P
from ..operators import ranking as O
from ..operators import scoring as C
from ..operators import stats as R
from ..operators import vectors as X
from ..operators import windows as W
from .base import query
from .filtering import ENOW, NOW, TRIALS_SQL, PROBES_SQL, last_scans, METRICS_SQL, patterns, probes, trials
from .joining import APPS_SQL, FB_SQL, apps_by_posting, legacy_apps, titled_feedback
from .text_fields import SKILLS_SQL, ts

FMT = "'%Y-%m-%d %H:%M:%S'"
PROFILE = C.Profile(A.PROFILE_SKILLS, 1, A.PROFILE_VERSION)

# --- scores ------------------------------------------------------------------

ROLE_CASE = r"""CASE WHEN title = 'Webinar on Cloud' THEN 15 WHEN title = 'Technical Support Engineer' THEN 45 WHEN title = 'Marketing Manager' THEN 15
 WHEN sup AND title <> 'SDE 2' THEN 45 WHEN title = 'Data Scientist' THEN 90 WHEN title LIKE '%Intern' OR title LIKE '%Fresher' THEN 95
 WHEN title LIKE '%Software Engineer' OR title LIKE 'Backend%' THEN 90 WHEN title LIKE 'QA%' THEN 45 WHEN title = 'C++ Developer' THEN 60 ELSE 40 END"""
CAT_CASE = r"""CASE WHEN title = 'Webinar on Cloud' OR title = 'Marketing Manager' THEN 'non_technical' WHEN title = 'Technical Support Engineer' THEN 'support'
 WHEN sup AND title <> 'SDE 2' THEN 'support' WHEN title = 'Data Scientist' THEN 'ai_ml'
 WHEN title LIKE '%Intern' OR title LIKE '%Fresher' OR title LIKE '%Software Engineer' OR title LIKE 'Backend%' THEN 'core_software'
 WHEN title LIKE 'QA%' THEN 'testing_qa' WHEN title = 'C++ Developer' THEN 'general_tech' ELSE 'unknown' END"""
SUP_SQL = r"""regexp_matches(upper(description), '(^|[^\pL\pN_])(HELPDESK|CUSTOMER SUPPORT|TECHNICAL SUPPORT|APPLICATION SUPPORT|PRODUCT SUPPORT|SERVICE DESK|TICKET ESCALATION|SUPPORT TICKETS|TIER 1 SUPPORT|TIER 2 SUPPORT|DESK SUPPORT)($|[^\pL\pN_])')"""

BASE_SCORE = rf"""
f AS (SELECT p.*, {SKILLS_SQL.replace('(t,', '(txt,')} AS js, {SUP_SQL} AS sup FROM (SELECT *, upper(title || ' ' || description) AS txt FROM {{src}}) p),
g AS (SELECT *, len(js) AS n, len(list_filter(js, lambda x: list_contains(['Python', 'PostgreSQL', 'Docker', 'Java', 'REST API', 'React'], x))) AS hits, {ROLE_CASE} AS role_score, {CAT_CASE} AS role_category,
 regexp_matches(regexp_replace(upper(description), '[^A-Z0-9+]', ' ', 'g'), '(^|[^A-Z0-9+])REQUIRES? (AT +LEAST +)?(10|12|15)[+]? *YEARS') AS execu,
 title LIKE 'Senior%' OR title LIKE '%Manager' OR regexp_matches(regexp_replace(upper(description), '[^A-Z0-9+]', ' ', 'g'), '(^|[^A-Z0-9+])(5|6|7|8)[+] +YEARS') AS sen,
 regexp_matches(txt, '(^|[^\pL\pN_])(INTERN|FRESHER|ENTRY\s*LEVEL|GRADUATE|0-1\s*YEAR|0-2\s*YEARS)($|[^\pL\pN_])') OR contains(upper(title), 'INTERN') AS entry FROM f),
h AS (SELECT *, CASE WHEN n >= 2 OR (n = 1 AND length(trim(description)) <= 300) THEN 'explicit' WHEN n = 1 THEN 'inferred' ELSE 'unknown' END AS skill_confidence,
 CASE WHEN n >= 2 OR (n = 1 AND length(trim(description)) <= 300) THEN least(98, greatest(10, CAST(round_even(hits / CAST(n AS DOUBLE) * 100, 0) AS INTEGER))) WHEN n = 1 THEN CASE WHEN hits = 1 THEN 65 ELSE 10 END END AS skill_score,
 CASE WHEN execu THEN 15 WHEN sen THEN 30 WHEN entry THEN 95 ELSE 75 END AS experience_score FROM g),
i AS (SELECT *, least(98, greatest(10, CAST(round_even(CASE WHEN skill_score IS NOT NULL THEN CAST(0.45 AS DOUBLE) * skill_score + CAST(0.35 AS DOUBLE) * role_score + CAST(0.20 AS DOUBLE) * experience_score
   ELSE (CAST(0.35 AS DOUBLE) * role_score + CAST(0.20 AS DOUBLE) * experience_score) / CAST(0.55 AS DOUBLE) END, 0) AS INTEGER))) AS s0 FROM h),
j AS (SELECT *, CASE WHEN skill_confidence = 'unknown' THEN least(65, s0) ELSE s0 END AS s1 FROM i),
k AS (SELECT *, CASE WHEN execu THEN least(35, s1) WHEN sen THEN least(60, s1) ELSE s1 END AS s2 FROM j),
scored AS (SELECT *, CASE WHEN role_category = 'non_technical' THEN least(25, s2) WHEN role_category IN ('support', 'testing_qa') THEN least(45, s2) ELSE s2 END AS local_score FROM k)"""
SCORED = BASE_SCORE.replace("{src}", "postings")
SCORED_STORE = BASE_SCORE.replace("{src}", "store")


@query("c1_classify_role", f"SELECT native_id, {ROLE_CASE} AS role_score, {CAT_CASE} AS role_category FROM (SELECT *, {SUP_SQL} AS sup FROM postings)", "postings")
def c1(t):
    r = S.classify_role("title", "description")
    return t.postings.select("native_id", r["score"].alias("role_score"), r["category"].alias("role_category"))


@query("c2_support_override", r"""
SELECT native_id, CASE native_id % 3 WHEN 0 THEN 'support' WHEN 1 THEN 'core_software' ELSE 'core_software' END AS category FROM postings""", "postings")
def c2(t):
    d = F.expr("""CASE native_id % 3 WHEN 0 THEN 'Handle support tickets daily' WHEN 1 THEN 'Handle support tickets; help developers'
                  ELSE 'Build services' END""")
    return t.postings.select("native_id", S.classify_role(F.lit("Software Engineer"), d)["category"].alias("category"))


@query("c3_seniority", r"""
SELECT native_id, FALSE AS executive, title LIKE 'Senior%' OR title LIKE '%Manager' OR native_id % 11 = 0 AS senior,
 title LIKE '%Intern' OR title LIKE '%Fresher' AS entry FROM postings""", "postings")
def c3(t):
    s = S.seniority("title", F.when(F.col("native_id") % 11 == 0, F.lit("needs 5+ years; Leadership")).otherwise(F.lit("managerial")))
    return t.postings.select("native_id", s["executive"].alias("executive"), s["senior"].alias("senior"), s["entry"].alias("entry"))


@query("c4_score_local", f"WITH {SCORED} SELECT native_id, local_score, skill_score, skill_confidence, role_score, experience_score FROM scored", "postings")
def c4(t):
    return C.score_local(t.postings, PROFILE).select(
        "native_id", "local_score", "skill_score", "skill_confidence", "role_score", "experience_score")


@query("c5_evidence_cap", """
WITH c AS (SELECT *, NOT (score IS NOT NULL AND tier <= 2) AND coalesce(score, 50) > 60 AND (length(description) < 140 OR contains(description, 'See posting for details')) AS capped FROM postings)
SELECT native_id, capped AS evidence_capped, CASE WHEN capped THEN 60 ELSE score END AS score FROM c""", "postings")
def c5(t):
    return C.evidence_cap(t.postings).select("native_id", "evidence_capped", "score")


def hybrid(t):
    """Store postings with a vector, against the profile's chunk vectors."""
    n = t.embeddings.agg(F.count(F.lit(1))).scalar()
    vec = t.embeddings.select(F.col("vec_id").alias("__v"), "embedding")
    items = t.store.withColumn("__v", F.pmod("native_id", n)).join(vec, "__v")
    chunks = t.vector_queries.select(F.col("query").alias("embedding"))
    return C.score_hybrid(X.nearest_distance(items.select("native_id", "title", "description", "embedding"), chunks, "native_id"), PROFILE)


HYBRID_SQL = f"""{SCORED_STORE},
cnt AS (SELECT count(*) AS c FROM embeddings),
near AS (SELECT e.vec_id, min(list_aggregate(list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), CAST(q.query AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])), 'sum')) AS d FROM embeddings e, vector_queries q GROUP BY 1),
hyb AS (SELECT s.*, CAST(round_even(greatest(0, least(1, (2 - d) / 2)) * 100, 0) AS INTEGER) AS semantic_score FROM scored s, cnt JOIN near ON vec_id = s.native_id % cnt.c),
h1 AS (SELECT *, least(98, greatest(10, CAST(round_even(CASE WHEN skill_score IS NOT NULL THEN CAST(0.35 AS DOUBLE) * skill_score + CAST(0.30 AS DOUBLE) * semantic_score + CAST(0.20 AS DOUBLE) * role_score + CAST(0.15 AS DOUBLE) * experience_score
 ELSE (CAST(0.30 AS DOUBLE) * semantic_score + CAST(0.20 AS DOUBLE) * role_score + CAST(0.15 AS DOUBLE) * experience_score) / CAST(0.65 AS DOUBLE) END, 0) AS INTEGER))) AS t0 FROM hyb),
h2 AS (SELECT *, CASE WHEN skill_confidence = 'unknown' THEN least(65, t0) ELSE t0 END AS t1 FROM h1),
hybrid AS (SELECT *, CASE WHEN execu THEN least(35, t1) WHEN sen THEN least(60, t1) ELSE t1 END AS hybrid_score FROM h2)"""


@query("c6_score_hybrid", f"WITH {HYBRID_SQL} SELECT native_id, semantic_score, hybrid_score, local_score FROM hybrid", "store vector_queries")
def c6(t):
    return hybrid(t).select("native_id", "semantic_score", "hybrid_score", "local_score")


ROUTE_SQL = """
r AS (SELECT native_id, native_id % 100 / 100.0 AS relevance, coalesce(score, 50) AS first_pass, CASE WHEN native_id % 4 = 0 THEN 0.5 ELSE 1.1 END AS m, native_id % 2 = 0 AS low FROM postings)"""


@query("c7_route", f"""WITH {ROUTE_SQL}
SELECT native_id, CASE WHEN first_pass BETWEEN 40 AND 75 THEN 'ambiguous' ELSE 'clear' END AS ambiguity_band,
 CASE WHEN relevance >= 0.6 AND first_pass BETWEEN 40 AND 75 THEN CASE WHEN low AND (m < 0.8 OR relevance < 0.75) THEN 'ollama' ELSE 'paid_llm' END
  WHEN relevance >= 0.6 OR first_pass BETWEEN 40 AND 75 THEN 'ollama' ELSE 'hybrid_semantic' END AS target_tier FROM r""", "postings")
def c7(t):
    p = t.postings.select("native_id", (F.col("native_id") % 100 / 100).alias("relevance"), F.coalesce("score", F.lit(50)).alias("first_pass"),
                          F.when(F.col("native_id") % 4 == 0, 0.5).otherwise(1.1).alias("yield_multiplier"), (F.col("native_id") % 2 == 0).alias("quota_low"))
    return C.route(p).select("native_id", "ambiguity_band", "target_tier")


@query("c8_category_cap", f"""SELECT native_id, CASE WHEN cat = 'non_technical' THEN least(25, score) WHEN cat IN ('support', 'testing_qa') THEN least(45, score) ELSE score END AS capped
FROM (SELECT *, {CAT_CASE} AS cat FROM (SELECT *, {SUP_SQL} AS sup FROM postings)) WHERE score IS NOT NULL""", "postings")
def c8(t):
    p = t.postings.where("score IS NOT NULL").withColumn("cat", S.classify_role("title", "description")["category"])
    return p.select("native_id", C.category_cap(F.col("score"), F.col("cat")).alias("capped"))


@query("c9_needs_scoring", """
SELECT native_id, NOT (score IS NOT NULL AND profile_version = 'v2') AS plain, NOT (score IS NOT NULL AND profile_version = 'v2' AND tier <= 2) AS forced FROM postings""", "postings")
def c9(t):
    return t.postings.select("native_id", C.needs_scoring("v2").alias("plain"), C.needs_scoring("v2", True).alias("forced"))


@query("c10_consensus", """
SELECT id, score AS primary_score, second AS secondary_score, abs(score - second) AS score_diff, abs(score - second) <= 20 AS consensus,
 CASE WHEN abs(score - second) > 20 THEN 'scores_disagree' END AS flag
FROM (SELECT id, coalesce(score, 50) AS score, CAST(native_id % 101 AS INTEGER) AS second FROM store) WHERE score BETWEEN 40 AND 60""", "store")
def c10(t):
    return C.consensus(t.store, t.store.select("id", (F.col("native_id") % 101).alias("score")))


@query("c11_score_simple", f"""
SELECT native_id, CAST(least(98, greatest(45, 50 + 12 * len(list_filter(js, lambda x: list_contains(['Python', 'AWS', 'React', 'Docker', 'SQL'], x))))) AS INTEGER) AS simple_score
FROM (SELECT native_id, {SKILLS_SQL} AS js FROM (SELECT native_id, upper(title || ' ' || description) AS t FROM postings))""", "postings")
def c11(t):
    return C.score_simple(t.postings, ["Python", "AWS", "React", "Docker", "SQL"]).select("native_id", "simple_score")


PRIOR_SQL = """prior AS (SELECT *, coalesce(avg(jobs_found) OVER (PARTITION BY company_id ORDER BY scanned_at, scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_avg FROM scan_log),
conf AS (SELECT *, CAST(CASE WHEN jobs_found = 0 THEN 0 ELSE CASE method WHEN 'workday_api' THEN 0.95 WHEN 'stored_pattern' THEN 0.9 WHEN 'heuristic' THEN 0.75 ELSE 0.9 END
  - CASE WHEN prior_avg > 0 AND jobs_found < 0.3 * prior_avg THEN 0.3 ELSE 0 END END AS DOUBLE) AS parse_confidence FROM prior)"""


def confident_scans(t):
    return C.parse_confidence(W.prior_avg_yield(t.scan_log))


@query("c12_parse_confidence", f"WITH {PRIOR_SQL} SELECT scan_id, round(parse_confidence, 2) AS parse_confidence FROM conf", "scan_log")
def c12(t):
    return confident_scans(t).select("scan_id", "parse_confidence")


@query("c13_difficulty", f"WITH {METRICS_SQL} SELECT company_id, CAST(CASE WHEN successful_scans > 0 AND jobs_extracted >= 5 THEN 0.3 ELSE 0.8 END AS DOUBLE) AS difficulty FROM metrics", "scan_log")
def c13(t):
    return C.difficulty(R.scan_metrics(last_scans(t))).select("company_id", "difficulty")


@query("c14_crosscheck_gate", f"""WITH {PRIOR_SQL}, g AS (SELECT scan_id, parse_confidence AS c, scan_id % 100 / 100.0 AS rel, CASE WHEN scan_id % 3 = 0 THEN 0.6 ELSE 1.0 END AS m, scan_id % 2 = 0 AS low FROM conf)
SELECT scan_id, CASE WHEN round(c, 2) >= 0.8 THEN 'not needed' WHEN low AND rel < 0.85 THEN 'skipped: quota headroom low' WHEN m < 0.8 AND rel < 0.7 THEN 'skipped: low-yield cycle'
 WHEN rel < 0.5 THEN 'skipped: low relevance' ELSE 'triggered' END AS crosscheck FROM g""", "scan_log")
def c14(t):
    s = confident_scans(t).withColumns({
        "threshold": F.lit(0.8), "relevance": F.col("scan_id") % 100 / 100,
        "yield_multiplier": F.when(F.col("scan_id") % 3 == 0, 0.6).otherwise(1.0), "quota_low": F.col("scan_id") % 2 == 0})
    return C.crosscheck_gate(s).select("scan_id", "crosscheck")


STREAK_SQL = """
streak AS (SELECT s.company_id, count(*) FILTER (z.last IS NULL OR (scanned_at, scan_id) > (z.last.a, z.last.b)) AS zero_streak, any_value(z.last.a) AS last_success,
  count(*) FILTER (f.last IS NULL OR (scanned_at, scan_id) > (f.last.a, f.last.b)) AS fresher_streak, any_value(f.last.a) AS last_fresher, CAST(sum(jobs_found) AS BIGINT) AS jobs, CAST(sum(fresher_found) AS BIGINT) AS fresher_total FROM scan_log s
 LEFT JOIN (SELECT company_id, max(struct_pack(a := scanned_at, b := scan_id)) AS last FROM scan_log WHERE jobs_found > 0 GROUP BY 1) z ON z.company_id = s.company_id
 LEFT JOIN (SELECT company_id, max(struct_pack(a := scanned_at, b := scan_id)) AS last FROM scan_log WHERE fresher_found > 0 GROUP BY 1) f ON f.company_id = s.company_id GROUP BY 1)"""


@query("c15_partition_companies", f"""WITH {STREAK_SQL},
d AS (SELECT c.company_id, zero_streak >= 1 AND NOT coalesce(last_success > {ENOW} - INTERVAL 2 DAY, FALSE) AS dormant, fresher_streak >= 1 AND jobs > 0 AS slow FROM companies c LEFT JOIN streak s USING (company_id))
SELECT company_id, CASE WHEN dormant THEN 'dormant' ELSE 'active' END AS scan_tier, CASE WHEN dormant THEN FALSE ELSE NOT slow END AS scan_now FROM d""", "companies scan_log")
def c15(t):
    return C.partition_companies(t.companies, R.scan_streaks(t.scan_log), 7, A.EVENT_NOW, failures=1, days=2, fresher_streak=1).select(
        "company_id", "scan_tier", "scan_now")


def filter_metrics(t):
    """Precision and recall of three filters, from feedback."""
    f = t.feedback.withColumn("filter", F.expr("CASE feedback_id % 3 WHEN 0 THEN 'role_filter' WHEN 1 THEN 'location_filter' ELSE 'exclude_filter' END"))
    return f.groupBy("filter").agg(
        F.round(F.count_if(F.col("action") == "yes") / F.count(F.lit(1)), 4).alias("precision"),
        F.round(F.count_if(F.col("job_match_score") >= 10) / F.count(F.lit(1)), 4).alias("recall")).withColumn("threshold", F.lit(0.8))


FM_SQL = """fm AS (SELECT CASE feedback_id % 3 WHEN 0 THEN 'role_filter' WHEN 1 THEN 'location_filter' ELSE 'exclude_filter' END AS filter,
 round(count(*) FILTER (action = 'yes') / CAST(count(*) AS DOUBLE), 4) AS precision, round(count(*) FILTER (job_match_score >= 10) / CAST(count(*) AS DOUBLE), 4) AS recall FROM feedback GROUP BY 1)"""


@query("c16_optimize_thresholds", f"""WITH {FM_SQL}, m AS (SELECT count(*) AS n FROM feedback WHERE action = 'no' AND job_match_score >= 75),
s AS (SELECT fm.*, n, least(0.15, 0.08 * CASE WHEN n <= 0 THEN 1 WHEN n = 1 THEN 1.25 WHEN n = 2 THEN 1.5 ELSE 2 END) AS d FROM fm, m)
SELECT filter, n AS confident_misses, CAST(round(CASE WHEN precision < 0.8 AND recall > 0.85 THEN least(0.95, 0.8 + d) WHEN recall < 0.8 AND precision > 0.85 THEN greatest(0.5, 0.8 - d) ELSE 0.8 END, 2) AS DOUBLE) AS new_threshold FROM s""", "feedback")
def c16(t):
    return C.optimize_thresholds(filter_metrics(t), t.feedback).select("filter", "confident_misses", F.round("new_threshold", 2).alias("new_threshold"))


@query("c17_evaluate_trials", f"""WITH {TRIALS_SQL}, {FM_SQL}, m AS (SELECT count(*) / 20.0 AS rate FROM feedback WHERE action = 'no' AND job_match_score >= 95)
SELECT adjustment_id, CASE WHEN round(rate, 4) > pre_miss_rate OR precision < pre_precision - 0.05 THEN 'reverted' ELSE 'confirmed' END AS verdict
FROM trials JOIN fm ON fm.filter = threshold_name, m WHERE status = 'pending' AND (trial_period_end <= {ENOW} OR outcomes_count >= 20)""", "feedback")
def c17(t):
    rare = t.feedback.withColumn("job_match_score", F.when(F.col("job_match_score") >= 95, F.col("job_match_score")).otherwise(F.lit(0)))
    return C.evaluate_trials(P.trials_due(trials(t), A.EVENT_NOW), filter_metrics(t), rare).select("adjustment_id", "verdict")


PACE_SQL = """pace AS (SELECT round(sum(credits) FILTER (strftime(called_at, '%Y-%m') = '2024-01') / (31 / 31.0 * 5000.0), 2) AS ratio FROM usage_log)"""


@query("c18_pacing_adjustment", f"""WITH {PACE_SQL} SELECT CAST(0.8 AS DOUBLE) AS old_threshold, CAST(CASE WHEN ratio < 0.7 THEN 0.83 WHEN ratio > 1.2 THEN 0.77 ELSE 0.8 END AS DOUBLE) AS new_threshold FROM pace""", "usage_log")
def c18(t):
    return C.pacing_adjustment(R.usage_pacing(t.usage_log, A.EVENT_NOW, 5000.0), 0.8).select("old_threshold", F.round("new_threshold", 2).alias("new_threshold"))


def pattern_events(t):
    return t.scan_log.select("company_id", F.col("scanned_at").alias("at"), F.col("scan_id").alias("event_id"),
                             F.expr("CASE WHEN error IS NOT NULL THEN 'failed' WHEN method = 'heuristic' THEN 'saved' WHEN method = 'stored_pattern' THEN 'validated' ELSE 'failed' END").alias("kind"))


@query("c19_pattern_status", f"""
WITH e AS (SELECT company_id, struct_pack(a := scanned_at, b := scan_id) AS k, error IS NOT NULL OR method NOT IN ('heuristic', 'stored_pattern') AS failed FROM scan_log),
r AS (SELECT company_id, max(k) FILTER (NOT failed) AS k FROM e GROUP BY 1)
SELECT company_id, count(*) FILTER (failed AND (r.k IS NULL OR e.k > r.k)) AS failure_count, CASE WHEN count(*) FILTER (failed AND (r.k IS NULL OR e.k > r.k)) >= 3 THEN 'stale' ELSE 'active' END AS status
FROM e JOIN r USING (company_id) GROUP BY 1""", "scan_log")
def c19(t):
    return C.pattern_status(pattern_events(t)).select("company_id", "failure_count", "status")


@query("c20_match_struct", f"""WITH {SCORED}
SELECT native_id, local_score AS score, 'v2' AS profile_version, 'Local score: skill=' || coalesce(CAST(skill_score AS VARCHAR), 'None') || ' (' || skill_confidence || '), role=' || role_score || ' (' || role_category || '), exp=' || experience_score || '%.' AS reasoning FROM scored""", "postings")
def c20(t):
    return C.match_struct(C.score_local(t.postings, PROFILE), PROFILE).select("native_id", "match.score", "match.profile_version", "match.reasoning")


@query("x15_weighted_sum", f"WITH {SCORED} SELECT native_id, s0 AS weighted FROM scored", "postings")
def x15(t):
    from ..operators.scoring import _clamp
    parts = C.components(t.postings, PROFILE)
    skill, role, exp = (F.col(c).cast("double") for c in ("skill_score", "role_score", "experience_score"))
    full = F.rint(0.45 * skill + 0.35 * role + 0.20 * exp)
    return parts.select("native_id", _clamp(F.coalesce(full, F.rint((0.35 * role + 0.20 * exp) / 0.55)).cast("int"), 10, 98).alias("weighted"))


# --- windows -----------------------------------------------------------------

@query("w1_rank_companies", """
SELECT company_id, row_number() OVER (ORDER BY preference DESC, success_rate DESC, avg_salary DESC, difficulty, company_id) AS rank,
 printf('preference %.2f + success %.0f%% + salary %.0f + difficulty %.1f', preference, success_rate * 100, avg_salary, difficulty) AS reason FROM companies""", "companies")
def w1(t):
    return W.rank_companies(t.companies).select("company_id", "rank", "reason")


@query("w2_running_spend", """
SELECT call_id, round(sum(credits) OVER (PARTITION BY strftime(called_at, '%Y-%m') ORDER BY called_at, call_id ROWS UNBOUNDED PRECEDING), 5) AS running_monthly_total FROM usage_log""", "usage_log")
def w2(t):
    return W.running_spend(t.usage_log).select("call_id", F.round("running_monthly_total", 5).alias("running_monthly_total"))


@query("w3_zero_yield_streak", f"WITH {STREAK_SQL} SELECT company_id, zero_streak AS zero_yield_streak, strftime(last_success, {FMT}) AS last_success_at FROM streak", "scan_log")
def w3(t):
    return W.zero_yield_streak(t.scan_log).select("company_id", "zero_yield_streak", ts("last_success_at").alias("last_success_at"))


@query("w4_fresher_streak", f"WITH {STREAK_SQL} SELECT company_id, fresher_streak AS fresher_zero_streak, strftime(last_fresher, {FMT}) AS last_fresher_at FROM streak", "scan_log")
def w4(t):
    return W.fresher_streak(t.scan_log).select("company_id", "fresher_zero_streak", ts("last_fresher_at").alias("last_fresher_at"))


@query("w5_prior_avg_yield", f"WITH {PRIOR_SQL} SELECT scan_id, round(prior_avg, 6) AS prior_avg FROM prior", "scan_log")
def w5(t):
    return W.prior_avg_yield(t.scan_log).select("scan_id", F.round("prior_avg", 6).alias("prior_avg"))


@query("w6_rpm_window", """
SELECT call_id, count(*) OVER (PARTITION BY key_id ORDER BY epoch_us(called_at) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS calls_last_60s FROM usage_log""", "usage_log")
def w6(t):
    return W.rpm_window(t.usage_log, 2).select("call_id", "calls_last_60s")


@query("w7_failure_backoff", """
WITH x AS (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY called_at, call_id) AS rn FROM usage_log),
y AS (SELECT *, coalesce(max(CASE WHEN NOT failed THEN rn END) OVER (PARTITION BY key_id ORDER BY rn), 0) AS last_ok FROM x)
SELECT call_id, rn - last_ok AS consecutive_failures, CAST(least(3600, 120 * pow(2, rn - last_ok - 1)) AS DOUBLE) AS backoff_seconds FROM y WHERE failed""", "usage_log")
def w7(t):
    return W.failure_backoff(t.usage_log).select("call_id", F.col("consecutive_failures").cast("long").alias("consecutive_failures"), "backoff_seconds")


LATENCY_SQL = """lat AS (SELECT application_id, arg_max("at", struct_pack(a := step, b := "at")) FILTER (status = 'applied') AS a, arg_max("at", struct_pack(a := step, b := "at")) FILTER (status = 'interviewed') AS i,
  arg_max("at", struct_pack(a := step, b := "at")) FILTER (status = 'offer') AS o FROM status_history GROUP BY 1),
latency AS (SELECT application_id, CASE WHEN i >= a THEN date_diff('second', a, i) / 86400.0 END AS di, CASE WHEN o >= a THEN date_diff('second', a, o) / 86400.0 END AS doo FROM lat)"""


@query("w8_status_latency", f"WITH {LATENCY_SQL} SELECT application_id, CAST(round(di, 6) AS DOUBLE) AS days_to_interview, CAST(round(doo, 6) AS DOUBLE) AS days_to_offer FROM latency", "status_history")
def w8(t):
    return W.status_latency(t.status_history).select("application_id", F.round("days_to_interview", 6).alias("days_to_interview"), F.round("days_to_offer", 6).alias("days_to_offer"))


@query("w9_best_match", """
SELECT id, arg_max(struct_pack(score, tier, native_id), struct_pack(a := CASE WHEN tier <= 2 AND score IS NOT NULL THEN 1 ELSE 0 END, b := CASE WHEN score IS NOT NULL THEN 1 ELSE 0 END, c := native_id)).native_id AS native_id FROM pid GROUP BY 1""", "pid")
def w9(t):
    v = t.normalized.select("id", "score", "tier", "native_id", F.col("native_id").alias("writer"))
    return W.best_match(v).select("id", "native_id")


@query("w10_recency_bonus", "SELECT feedback_id, round((row_number() OVER (ORDER BY feedback_id) - 1) * 0.1, 4)::DOUBLE AS recency_bonus FROM feedback", "feedback")
def w10(t):
    return W.recency_bonus(t.feedback, "feedback_id").select("feedback_id", F.round("recency_bonus", 4).alias("recency_bonus"))


@query("w11_daily_cap", """
SELECT native_id FROM postings QUALIFY row_number() OVER (PARTITION BY posted_date ORDER BY coalesce(score, 0) DESC, native_id) <= 3""", "postings")
def w11(t):
    return W.daily_cap(t.postings, 3, "posted_date", F.coalesce("score", F.lit(0)).desc(), F.col("native_id")).select("native_id")


def watch_probes(t):
    return t.scan_log.select(F.concat(F.lit("firm "), F.col("company_id").cast("string")).alias("name"), F.col("scan_id").alias("probe_id"),
                             F.col("scanned_at").alias("checked_at"), F.col("jobs_found").alias("india_jobs"), F.col("fresher_found").alias("fresher_jobs"))


WATCH_SQL = """watch AS (SELECT 'firm ' || company_id AS name, count(*) AS checks, max(fresher_found) AS best_fresher_seen, min(scanned_at) AS first_seen, max(scanned_at) AS last_checked,
 arg_max(jobs_found, struct_pack(a := scanned_at, b := scan_id)) AS last_india_jobs, arg_max(fresher_found, struct_pack(a := scanned_at, b := scan_id)) AS last_fresher_jobs FROM {src} GROUP BY 1)"""


@query("w12_watch_history", f"WITH {WATCH_SQL.replace('{src}', 'scan_log')} SELECT name, checks, best_fresher_seen, strftime(first_seen, {FMT}) AS first_seen, strftime(last_checked, {FMT}) AS last_checked, last_india_jobs, last_fresher_jobs FROM watch", "scan_log")
def w12(t):
    return W.watch_history(watch_probes(t)).withColumns({"first_seen": ts("first_seen"), "last_checked": ts("last_checked")})


@query("w13_transition_audit", """
WITH h AS (SELECT application_id, step, status, lag(status) OVER (PARTITION BY application_id ORDER BY step, "at", status) AS previous FROM status_history)
SELECT application_id, step, previous, status, previous = status OR (previous = 'applied') OR (previous = 'interviewed' AND status = 'offer') AS legal FROM h WHERE previous IS NOT NULL""", "status_history")
def w13(t):
    return W.transition_audit(t.status_history).select("application_id", "step", "previous", "status", "legal")


# --- orders ------------------------------------------------------------------

def placed(df, *cols):
    """All rows of an ordered result with their ranks, to check the order itself."""
    from ..session import with_global_rank
    return with_global_rank(df.select(*cols).withColumn("__o", F.monotonically_increasing_id()), F.col("__o")).drop("__o")


@query("o1_sort_feed", "SELECT native_id, row_number() OVER (ORDER BY coalesce(score, 0) DESC, id) AS rank FROM store", "store")
def o1(t):
    from ..session import with_global_rank
    return with_global_rank(t.store.withColumn("s", -F.coalesce("score", F.lit(0))), F.col("s"), F.col("id")).select("native_id", "rank")


@query("o1_sort_feed_recent", "SELECT native_id, row_number() OVER (ORDER BY first_seen DESC, id) AS rank FROM store", "store")
def o1b(t):
    return placed(O.sort_feed(t.store, "recent"), "native_id")


@query("o1_sort_feed_salary", "SELECT native_id, row_number() OVER (ORDER BY CASE WHEN salary_text LIKE 'INR%' THEN 600000 WHEN salary_text LIKE '8%' THEN 800000 END DESC NULLS LAST, id) AS rank FROM store", "store")
def o1c(t):
    return placed(O.sort_feed(t.store, "salary"), "native_id")


TIER_SQL = r"""CASE WHEN contains(x, 'gurugram') OR contains(x, 'bangalore') THEN 0 WHEN contains(x, 'delhi') OR contains(x, 'noida') THEN 1 WHEN contains(x, 'remote') OR contains(x, 'india') THEN 2 ELSE 3 END"""


@query("o2_priority_sort", f"""
WITH x AS (SELECT *, CASE WHEN location = '' THEN lower(title || ' ' || company || ' ' || description) ELSE lower(location || ' ' || title) END AS x FROM store)
SELECT native_id, {TIER_SQL} AS location_priority, row_number() OVER (ORDER BY floor(coalesce(score, 0) / 5) DESC, {TIER_SQL}, coalesce(score, 0) DESC, first_seen, id) AS rank FROM x""", "store")
def o2(t):
    return placed(O.priority_sort(t.store, [["Gurugram", "Bangalore"], ["Delhi", "Noida"], ["Remote", "India"]]), "native_id", "location_priority")


STATS_SQL = f"""{LATENCY_SQL},
names AS (SELECT DISTINCT company AS asked FROM postings),
found AS (SELECT asked, a.*, di FROM names JOIN applications a ON contains(lower(a.company), lower(asked)) LEFT JOIN latency USING (application_id)),
cs AS (SELECT asked, count(*) AS total, count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status = 'offer') AS offer, count(*) FILTER (status = 'rejected') AS rejected,
  count(referral_source) AS refs, coalesce(round_even(avg(salary_offered), 0), 0) AS avg_salary, round(avg(di), 1) AS days FROM found GROUP BY 1),
md AS (SELECT asked, job_title FROM found GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY asked ORDER BY count(*) DESC, job_title) = 1),
stats AS (SELECT n.asked AS company, coalesce(total, 0) AS total_applications, coalesce(applied, 0) AS applied, coalesce(offer, 0) AS offer, coalesce(rejected, 0) AS rejected, coalesce(refs, 0) AS referral_count,
  CAST(coalesce(avg_salary, 0) AS DOUBLE) AS avg_salary, coalesce(md.job_title, 'N/A') AS most_common_role, days AS avg_days_to_interview,
  coalesce(round((offer + refs) / CAST(total AS DOUBLE), 2), 0.0) AS success_rate, coalesce(round(offer / CAST(total AS DOUBLE), 2), 0.0) AS interview_rate
  FROM names n LEFT JOIN cs USING (asked) LEFT JOIN md USING (asked))"""


def stats(t):
    return R.company_stats(t.postings.select("company"), t.applications, t.status_history)


@query("a4_company_stats", f"""WITH {STATS_SQL}
SELECT *, CASE WHEN total_applications = 0 THEN 'no_record' WHEN success_rate >= 0.25 THEN 'apply_more' WHEN interview_rate >= 0.4 THEN 'keep_applying' ELSE 'improve_match' END AS advice FROM stats""", "postings applications status_history")
def a4(t):
    return stats(t).select("company", "total_applications", "applied", "offer", "rejected", "referral_count", "avg_salary", "most_common_role",
                           "avg_days_to_interview", "success_rate", "interview_rate", "advice")


@query("o3_affinity_sort", f"""WITH {STATS_SQL}
SELECT native_id, affinity, row_number() OVER (ORDER BY affinity DESC, coalesce(score, 50) DESC, company, id) AS rank FROM (
SELECT *, CAST(coalesce(score, 50) + coalesce(CASE WHEN total_applications = 0 THEN 0 WHEN success_rate >= 0.5 THEN 35 WHEN success_rate > 0 THEN 20 WHEN rejected = total_applications THEN -5 ELSE 10 END, 0) AS DOUBLE) AS affinity
FROM store LEFT JOIN stats USING (company))""", "store postings applications status_history")
def o3(t):
    return placed(O.affinity_sort(t.store, stats(t)), "native_id", "affinity")


@query("o4_top_feed", "SELECT native_id FROM store ORDER BY coalesce(score, 0) DESC, id LIMIT 20", "store")
def o4(t):
    return O.top_feed(t.store).select("native_id")


@query("o5_refine_candidates", "SELECT native_id FROM store WHERE score >= 50 AND tier > 2 ORDER BY score DESC, id LIMIT 150", "store")
def o5(t):
    return O.refine_candidates(t.store).select("native_id")


@query("o6_next_targets", "SELECT native_id FROM store WHERE score >= 50 ORDER BY score DESC, id LIMIT 5", "store")
def o6(t):
    return O.top(P.due_for_check(t.store, t.store.select("id", F.col("first_seen").alias("checked_at")), "2030-01-01 00:00:00"), 5,
                 F.desc("score"), F.col("id")).select("native_id")


@query("o7_select_examples", f"""WITH {FB_SQL},
l AS (SELECT *, row_number() OVER (ORDER BY feedback_id) - 1 AS pos, list_distinct(regexp_extract_all(lower(job_title || ' ' || reason), '\\w+')) AS w FROM fb),
q AS (SELECT DISTINCT title, list_distinct(regexp_extract_all(lower(title), '\\w+')) AS w FROM postings),
s AS (SELECT q.title, l.*, len(list_intersect(q.w, l.w)) + pos * 0.1 AS score FROM q, l)
SELECT title, action, row_number() OVER (PARTITION BY title, action ORDER BY round(score, 6) DESC, feedback_id) AS example_rank, feedback_id,
 '- User ' || CASE action WHEN 'yes' THEN 'approved' ELSE 'rejected' END || ' "' || job_title || '" at ' || company || ': "' || reason || '" (Match score was ' || job_match_score || '%)' AS line
FROM s QUALIFY row_number() OVER (PARTITION BY title, action ORDER BY round(score, 6) DESC, feedback_id) <= 2""", "postings feedback")
def o7(t):
    return O.select_examples(t.postings, titled_feedback(t)).select(
        "title", "action", F.col("example_rank").cast("long").alias("example_rank"), "feedback_id", "line")


@query("o8_recheck_batch", f"WITH {WATCH_SQL.replace('{src}', 'scan_log')} SELECT name FROM watch ORDER BY last_checked, name LIMIT 40", "scan_log")
def o8(t):
    return O.recheck_batch(W.watch_history(watch_probes(t))).select("name")


# every seventh firm never has an entry-level opening
BARREN = "(SELECT * REPLACE (CASE WHEN company_id % 7 = 0 THEN 0 ELSE fresher_found END AS fresher_found) FROM scan_log)"


@query("o9_near_misses", f"WITH {WATCH_SQL.replace('{src}', BARREN)} SELECT name FROM watch WHERE best_fresher_seen = 0 AND last_india_jobs > 0 ORDER BY last_india_jobs DESC, name LIMIT 15", "scan_log")
def o9(t):
    return O.near_misses(W.watch_history(watch_probes(t).withColumn(
        "fresher_jobs", F.when(F.substring("name", 6, 20).cast("long") % 7 == 0, 0).otherwise(F.col("fresher_jobs"))))).select("name")


@query("o10_long_parked", f"WITH {WATCH_SQL.replace('{src}', 'scan_log')} SELECT name, checks FROM watch ORDER BY checks DESC, name LIMIT 10", "scan_log")
def o10(t):
    return O.long_parked(W.watch_history(watch_probes(t))).select("name", "checks")


@query("o11_admit", """
WITH v AS (SELECT * FROM companies WHERE lower(name) NOT IN (SELECT lower(name) FROM companies WHERE company_id % 5 = 0) ORDER BY company_id LIMIT 25)
SELECT DISTINCT regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') AS company_id FROM v""", "companies")
def o11(t):
    known = t.companies.where("company_id % 5 = 0").select(F.lit("x").alias("id"), F.upper("name").alias("name"))
    return O.admit(t.companies.withColumnRenamed("company_id", "n"), known, 25, "n").select("company_id")


@query("o12_tail", f"SELECT strftime(started_at, {FMT}) AS started_at FROM cycles ORDER BY started_at DESC LIMIT 20", "cycles")
def o12(t):
    return O.top(t.cycles, 20, F.desc("started_at")).select(ts("started_at").alias("started_at"))


@query("o13_sort_verified_first", "SELECT native_id, row_number() OVER (ORDER BY (tier <= 2 AND score IS NOT NULL) DESC, coalesce(score, 0) DESC, id) AS rank FROM store", "store")
def o13(t):
    return placed(O.sort_verified_first(t.store), "native_id")


# --- vectors -----------------------------------------------------------------

@query("v2_l2_normalize", """
WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT vec_id, round(list_aggregate(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))), 'sum'), 5) AS total FROM n""")
def v2(t):
    return t.embeddings.select("vec_id", F.round(F.aggregate(X.l2_normalize("embedding"), F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("v3_cosine", """
WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT a.vec_id, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)), 5) AS similarity FROM n a JOIN n b ON b.vec_id = a.vec_id + 1
UNION ALL SELECT vec_id, 0.0 FROM n WHERE vec_id = (SELECT max(vec_id) FROM n)""")
def v3(t):
    nxt = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(nxt, "vec_id", "left").select("vec_id", F.round(X.cosine("embedding", "other"), 5).alias("similarity"))


@query("v4_knn", """
WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT q.vec_id AS query_id, b.vec_id, list_dot_product(q.e, q.e) + list_dot_product(b.e, b.e) - 2 * list_dot_product(q.e, b.e) AS dist FROM n q, n b)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), vec_id) AS rank, vec_id, round(greatest(dist, 0), 4) AS distance FROM d
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(greatest(dist, 0), 9), vec_id) <= 5""")
def v4(t):
    queries = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return X.knn(queries, t.embeddings, 5).select(
        "query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("distance", 4).alias("distance"))


@query("j19_nearest_chunks", """
WITH n AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT q.vec_id AS asked, b.vec_id, b.label, greatest(0, list_dot_product(q.e, q.e) + list_dot_product(b.e, b.e) - 2 * list_dot_product(q.e, b.e)) AS dist FROM n q, n b WHERE b.vec_id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY round(dist, 9), vec_id) AS rank FROM d QUALIFY rank <= 5)
SELECT s.native_id, r.rank, r.vec_id AS chunk_id, r.label, round(r.dist, 4) AS distance, CAST(round_even(greatest(0, least(1, (2 - dist) / 2)) * 100, 0) AS INTEGER) AS score
FROM store s JOIN r ON r.asked = s.native_id % (SELECT count(*) FROM embeddings)""", "store")
def j19(t):
    n = t.embeddings.agg(F.count(F.lit(1))).scalar()
    vec = t.embeddings.select(F.col("vec_id").alias("__v"), "embedding")
    items = t.store.select("native_id").withColumn("__v", F.pmod("native_id", n)).join(vec, "__v")
    chunks = t.embeddings.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "chunk_id")
    return X.nearest_chunks(items, chunks, 5, key="native_id").select(
        "native_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "label", F.round("distance", 4).alias("distance"), "score")


@query("v5_distance_to_score", "SELECT l_orderkey AS k, l_linenumber AS n, CAST(sum(round_even(greatest(0, least(1, (2 - l_quantity / 20) / 2)) * 100, 0)) AS BIGINT) AS score FROM lineitem GROUP BY 1, 2")
def v5(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).agg(
        F.sum(X.distance_to_score(F.col("l_quantity") / 20)).alias("score"))


@query("v6_add_vectors", """
SELECT vec_id, label FROM embeddings UNION ALL SELECT (SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY vec_id), label FROM embeddings WHERE label > 3""")
def v6(t):
    return X.add_vectors(t.embeddings, t.embeddings.where("label > 3").withColumn("o", F.col("vec_id")), "o").select("vec_id", "label")


# --- evaluation --------------------------------------------------------------

def labelled(t):
    return t.ranking_labels.join(t.normalized.select("native_id", "score", "source"), "native_id").where("score IS NOT NULL") \
        .withColumnRenamed("source", "query").withColumnRenamed("native_id", "id")


LAB_SQL = """lab AS (SELECT l.native_id AS id, label, score, source AS query, CASE label WHEN 'A' THEN 3 WHEN 'B' THEN 2 WHEN 'C' THEN 1 ELSE 0 END AS gain FROM ranking_labels l JOIN postings p USING (native_id) WHERE score IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r FROM lab)"""


@query("e1_precision_at_k", f"WITH {LAB_SQL} SELECT query, round(avg(CASE WHEN label IN ('A', 'B') THEN 1.0 ELSE 0 END), 6) AS precision FROM rk WHERE r <= 10 GROUP BY 1", "postings ranking_labels")
def e1(t):
    return E.precision_at_k(labelled(t), 10).select("query", F.round("precision", 6).alias("precision"))


@query("e2_mrr", f"WITH {LAB_SQL} SELECT round(avg(rr), 6) AS mrr FROM (SELECT query, coalesce(1.0 / min(r) FILTER (label IN ('A', 'B')), 0) AS rr FROM rk GROUP BY 1)", "postings ranking_labels")
def e2(t):
    return E.mrr(labelled(t)).select(F.round("mrr", 6).alias("mrr"))


@query("e3_ndcg_at_k", f"""WITH {LAB_SQL}, top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY gain DESC, id) AS b FROM rk WHERE r <= 10)
SELECT query, round(sum(gain / log2(r + 1)) / sum(gain / log2(b + 1)), 6) AS ndcg FROM top GROUP BY 1""", "postings ranking_labels")
def e3(t):
    return E.ndcg_at_k(labelled(t), 10).select("query", F.round("ndcg", 6).alias("ndcg"))


@query("e3_ndcg_at_k_all", f"""WITH {LAB_SQL}, ideal AS (SELECT query, sum(gain / log2(b + 1)) AS i FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY gain DESC, id) AS b FROM lab) WHERE b <= 10 GROUP BY 1)
SELECT query, round(sum(gain / log2(r + 1)) / any_value(i), 6) AS ndcg FROM rk JOIN ideal USING (query) WHERE r <= 10 GROUP BY 1""", "postings ranking_labels")
def e3b(t):
    return E.ndcg_at_k(labelled(t), 10, ideal="all").select("query", F.round("ndcg", 6).alias("ndcg"))


@query("e4_label_rates", f"""WITH {LAB_SQL} SELECT round(count(*) FILTER (label = 'E' AND score >= 50) / CAST(count(*) FILTER (label = 'E') AS DOUBLE), 6) AS false_positive_rate,
 round(count(*) FILTER (label = 'A' AND score >= 70) / CAST(count(*) FILTER (label = 'A') AS DOUBLE), 6) AS retention FROM lab""", "postings ranking_labels")
def e4(t):
    return E.label_rates(labelled(t)).select(F.round("false_positive_rate", 6).alias("false_positive_rate"), F.round("retention", 6).alias("retention"))


@query("e5_feed_quality", """
WITH r AS (SELECT *, row_number() OVER (ORDER BY id) AS rank FROM store WHERE score IS NOT NULL), l AS (SELECT *, lag(score) OVER (ORDER BY rank) AS p FROM r)
SELECT count(*) AS total, count(*) FILTER (title LIKE 'Senior%' OR title LIKE '%Manager') AS senior, count(*) FILTER ((title LIKE 'Senior%' OR title LIKE '%Manager') AND rank <= 50) AS senior_in_top,
 count(*) FILTER (p < score) AS out_of_order FROM l""", "store")
def e5(t):
    from ..session import with_global_rank
    return E.feed_quality(with_global_rank(t.store.where("score IS NOT NULL"), F.col("id")))
