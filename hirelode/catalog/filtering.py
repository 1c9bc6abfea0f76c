"""Queries over the filters F* and their checking SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import fields as V
from ..functions import text as T
from ..operators import filters as P
from .base import query

NOW = "TIMESTAMP '2001-08-02 00:00:00'"
ENOW = "TIMESTAMP '2024-01-31 00:00:00'"

ROLE_SQL = """(title IN ('Software Engineer', 'Senior Software Engineer', 'Software Engineer Intern', 'C++ Developer', 'Data Scientist', 'Full Stack Developer - Fresher', 'Backend Developer (Python)'))"""
LOC_SQL = r"""(location IN ('Gurgaon, India', 'Bengaluru, Karnataka', 'Noida Sector 62', 'Remote') OR (location = '' AND regexp_matches(lower(description), '(^|[^\pL\pN_])remote($|[^\pL\pN_])')))"""
YEARS_SQL = r"""coalesce(list_min(list_transform(list_concat(list_concat(list_concat(
  regexp_extract_all(title || '  ' || description, '(?i)(\d{1,2})\s*(?:-|–|to)\s*\d{1,2}\s*\+?\s*(?:years?|yrs?)', 1),
  regexp_extract_all(title || '  ' || description, '(?i)(\d{1,2})\s*\+\s*(?:years?|yrs?)', 1)),
  regexp_extract_all(title || '  ' || description, '(?i)(\d{1,2})\s*\+?\s*(?:years?|yrs?)\s*(?:of\s+)?(?:relevant\s+|professional\s+|industry\s+|prior\s+|hands.on\s+|work(?:ing)?\s+)*experience', 1)),
  regexp_extract_all(title || '  ' || description, '(?i)(?:min\.?(?:imum)?(?:\s+of)?|at\s+least|requires?|needs?|must\s+have)\s+(?:of\s+)?(\d{1,2})\s*\+?\s*(?:years?|yrs?)', 1)), lambda v: CAST(v AS INTEGER))), 0) <= 2"""
SENIOR_SQL = """(title IN ('Senior Software Engineer', 'Marketing Manager', 'SDE 2'))"""
VALID_SQL = """(title <> 'Webinar on Cloud')"""


@query("f1_validity", """
SELECT native_id, title <> 'Webinar on Cloud' AND NOT (company LIKE '%India' AND location LIKE 'Berlin%') AS is_valid,
 concat_ws(' | ', CASE WHEN title = 'Webinar on Cloud' THEN 'Title matches non-job listing pattern: ''Webinar on Cloud''' END,
  CASE WHEN native_id % 10 = 1 THEN 'URL hostname/path indicates non-job article/event/course: ''blog.'' in ''blog.example.com/x''' END,
  CASE WHEN native_id % 10 = 2 AND title <> 'Webinar on Cloud' THEN NULL END,
  CASE WHEN company LIKE '%India' AND location LIKE 'Berlin%' THEN 'Non-India location ''Berlin, Germany'' for India-scoped company ''' || company || '''' END) AS reasons
FROM (SELECT *  REPLACE (CASE WHEN native_id % 4 = 0 THEN company || ' India' ELSE company END AS company) FROM postings)
WHERE native_id % 10 <> 1
UNION ALL SELECT native_id, FALSE, concat_ws(' | ', CASE WHEN title = 'Webinar on Cloud' THEN 'Title matches non-job listing pattern: ''Webinar on Cloud''' END,
  'URL hostname/path indicates non-job article/event/course: ''blog.'' in ''blog.example.com/x''',
  CASE WHEN native_id % 4 = 0 AND location LIKE 'Berlin%' THEN 'Non-India location ''Berlin, Germany'' for India-scoped company ''' || company || ' India''' END)
FROM postings WHERE native_id % 10 = 1""", "postings")
def f1(t):
    p = t.postings.withColumns({
        "company": F.when(F.col("native_id") % 4 == 0, F.concat("company", F.lit(" India"))).otherwise(F.col("company")),
        "url": F.when(F.col("native_id") % 10 == 1, F.lit("https://blog.example.com/x?a=1")).otherwise(F.col("url"))})
    return P.validity(p).select("native_id", "is_valid", F.array_join("reasons", " | ").alias("reasons"))


@query("f2_integrity_errors", """
SELECT native_id, concat_ws(' | ', CASE WHEN native_id % 13 = 0 THEN 'Id matches forbidden synthetic pattern' END,
  CASE WHEN title = 'Webinar on Cloud' THEN 'Title matches non-job listing pattern: ''Webinar on Cloud''' END) AS reasons
FROM postings WHERE native_id % 13 = 0 OR title = 'Webinar on Cloud'""", "postings")
def f2(t):
    p = t.normalized.withColumn("id", F.when(F.col("native_id") % 13 == 0, F.concat(
        F.lit("x-job-career-"), F.col("native_id").cast("string"))).otherwise(F.col("id")))
    return P.integrity_errors(p).select("native_id", F.array_join("reasons", " | ").alias("reasons"))


@query("f2_enforce_integrity", "SELECT native_id FROM postings WHERE title <> 'Webinar on Cloud'", "postings")
def f2b(t):
    return P.enforce_integrity(t.normalized).select("native_id")


@query("f3_recent", f"""
WITH r AS (SELECT native_id, CASE WHEN native_id % 5 = 0 THEN NULL WHEN native_id % 5 = 1 THEN first_seen ELSE posted_date END AS t FROM postings)
SELECT native_id FROM r WHERE t IS NULL OR date_diff('second', t, {NOW}) <= 720 * 3600""", "postings")
def f3(t):
    p = t.postings.withColumn("posted_date", F.expr(
        "CASE native_id % 5 WHEN 0 THEN 'Posted yesterday' WHEN 1 THEN '' ELSE cast(posted_date AS string) END"))
    return P.recent(p, 720, A.NOW).select("native_id")


@query("f3_recent_fallback", "SELECT native_id FROM postings", "postings")
def f3b(t):
    return P.recent(t.postings, 1, A.NOW).select("native_id")


@query("f4_expand_if_sparse", f"""
WITH a AS (SELECT native_id, date_diff('second', first_seen, {NOW}) / 3600.0 AS age FROM postings),
c AS (SELECT s, count(*) FILTER (age <= s) AS n FROM a, (VALUES (2.0), (6.0), (24.0), (72.0)) v(s) GROUP BY s),
u AS (SELECT CAST(coalesce(min(s) FILTER (n >= 10), 72.0) AS DOUBLE) AS used FROM c)
SELECT native_id, used AS timeframe_used_hours, used > 2 AS was_expanded FROM a, u WHERE age <= used""", "postings")
def f4(t):
    return P.expand_if_sparse(t.postings, 2.0, 10, A.NOW).select("native_id", "timeframe_used_hours", "was_expanded")


@query("f5_match_role", f"SELECT native_id FROM postings WHERE {ROLE_SQL} AND title <> 'Backend Developer (Python)' OR title LIKE 'Backend%'", "postings")
def f5(t):
    return P.match_role(t.postings, A.TARGET_ROLES).select("native_id")


@query("f6_match_location", f"SELECT native_id FROM postings WHERE {LOC_SQL}", "postings")
def f6(t):
    return P.match_location(t.postings, A.TARGET_LOCATIONS).select("native_id")


@query("f7_within_experience", f"SELECT native_id FROM postings WHERE {YEARS_SQL}", "postings")
def f7(t):
    return P.within_experience(t.postings, 2).select("native_id")


@query("f8_exclude_seniority", f"SELECT native_id FROM postings WHERE NOT {SENIOR_SQL}", "postings")
def f8(t):
    return P.exclude_seniority(t.postings, A.EXCLUSIONS).select("native_id")


@query("f9_min_score", """
SELECT native_id FROM postings WHERE coalesce(score, 50) >= CASE WHEN tier <= 2 AND score IS NOT NULL THEN 45 ELSE 55 END""", "postings")
def f9(t):
    return P.min_score(t.postings, 55).select("native_id")


@query("f10_split_pending", """
SELECT CASE WHEN score IS NULL THEN 'pending' WHEN profile_version <> 'v2' THEN 'stale' ELSE 'ready' END AS match_state, count(*) AS n, CAST(sum(native_id) AS BIGINT) AS id_sum
FROM postings GROUP BY 1""", "postings")
def f10(t):
    ready, pending = P.split_pending(t.postings, A.PROFILE_VERSION)
    return ready.unionByName(pending).groupBy("match_state").agg(
        F.count(F.lit(1)).alias("n"), F.sum("native_id").alias("id_sum"))


GLOBAL = {"Skills & Tech Stack": ["Python", "Java"], "Location & Model": ["remote", "bengaluru"], "Job Type": []}


@query("f11_global_filters", """
WITH b AS (SELECT native_id, lower(concat_ws(' ', title, location, company, description)) AS x FROM postings)
SELECT native_id FROM b WHERE (contains(x, 'python') OR contains(x, 'java')) AND (contains(x, 'remote') OR contains(x, 'bengaluru'))""", "postings")
def f11(t):
    return P.global_filters(t.postings, GLOBAL).select("native_id")


@query("f12_search_filter", f"""
SELECT native_id FROM postings WHERE score >= 60 AND title IN ('Software Engineer', 'Senior Software Engineer', 'Software Engineer Intern', 'Data Scientist')
 AND (location LIKE 'Noida%' OR location = 'Remote' OR regexp_matches(lower(description), '(^|[^\\pL\\pN_])remote($|[^\\pL\\pN_])'))
 AND date_diff('second', first_seen, {NOW}) <= 20000 * 3600
 AND contains(lower(concat_ws(' ', title, location, company, description)), 'python')""", "postings")
def f12(t):
    return P.search_filter(t.postings, A.NOW, 60, ["software engineer", "data scientist"], ["Noida", "Remote"],
                           20000, {"skills": ["python"]}).select("native_id")


@query("f13_location_in_scope", """
SELECT native_id FROM postings WHERE NOT (native_id % 2 = 0 AND (location = 'Berlin, Germany' OR (title = 'Technical Support Engineer' AND location IN ('', 'Remote'))))""", "postings")
def f13(t):
    p = t.postings.withColumn("career_url", F.when(F.col("native_id") % 2 == 0, F.lit("https://x.example.com/India/jobs")))
    return P.location_in_scope(p).select("native_id")


@query("f14_eligible_location", """
SELECT native_id, location IN ('', 'Remote', 'Gurgaon, India') AS eligible FROM postings""", "postings")
def f14(t):
    return t.postings.select("native_id", V.eligible_location("location").alias("eligible"))


@query("f15_fresher_and_india", """
SELECT native_id, title IN ('Software Engineer Intern', 'Full Stack Developer - Fresher') AS fresher,
 location IN ('Bengaluru, Karnataka', 'Gurgaon, India', 'Noida Sector 62', 'Mumbai') AS in_india FROM postings""", "postings")
def f15(t):
    return t.postings.select("native_id", V.is_fresher_title("title").alias("fresher"), V.is_india("location").alias("in_india"))


PROBES_SQL = """
probes AS (SELECT ncompany AS name, source AS ats, count(*) AS total_jobs,
  count(*) FILTER (location IN ('Bengaluru, Karnataka', 'Gurgaon, India', 'Noida Sector 62', 'Mumbai')) AS india_jobs,
  count(*) FILTER (title IN ('Software Engineer Intern', 'Full Stack Developer - Fresher')) AS fresher_jobs,
  count(*) FILTER (title IN ('Software Engineer Intern', 'Full Stack Developer - Fresher') AND location IN ('Bengaluru, Karnataka', 'Gurgaon, India', 'Noida Sector 62', 'Mumbai')) AS fresher_india_jobs
  FROM pid GROUP BY 1, 2),
gated AS (SELECT *, CASE WHEN india_jobs = 0 THEN 'no India-based openings' WHEN fresher_jobs = 0 THEN 'no fresher-eligible openings right now'
  WHEN fresher_india_jobs = 0 THEN 'fresher openings exist but none in India' END AS reason FROM probes)"""


def probes(t):
    from ..sources.json_api import probe_summary
    p = t.normalized.select(F.col("normalized_company").alias("name"), F.col("source").alias("ats"), "title", "location")
    return probe_summary(p)


@query("f16_admission_gate", f"""WITH {PROBES_SQL}
SELECT name, ats, reason, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN fresher_jobs >= 3 THEN 'verified' ELSE 'watchlisted' END AS status FROM gated""", "pid")
def f16(t):
    return P.admission_gate(probes(t), 3).select("name", "ats", "reason", "status")


@query("f17_detect_closed", r"""
WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END AS status,
  CASE page_id % 4 WHEN 3 THEN 'no longer accepting applications' WHEN 2 THEN 'This job is no longer available' ELSE '' END AS mark FROM pages)
SELECT page_id, NOT (status = 404 OR (status = 200 AND mark <> '')) AS alive,
 CASE WHEN status = 404 THEN 'HTTP 404' WHEN status = 503 THEN 'inconclusive HTTP 503' WHEN mark <> '' THEN 'closed marker: ''' || mark || '''' ELSE 'no closed markers' END AS reason FROM p""")
def f17(t):
    p = t.pages.withColumn("status", F.expr("CASE page_id % 6 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END")).withColumn(
        "html", F.concat("html", F.expr("""CASE page_id % 4 WHEN 3 THEN '<p>We are no longer accepting applications.</p>'
          WHEN 2 THEN '<p>This job is no longer available</p>' ELSE '' END""")))
    return P.detect_closed(p).select("page_id", "alive", "reason")


@query("f18_due_for_check", f"""
WITH s AS (SELECT id, first_seen AS checked_at FROM store WHERE native_id % 2 = 0)
SELECT native_id FROM store LEFT JOIN s USING (id) WHERE score >= 50 AND (checked_at IS NULL OR date_diff('second', checked_at, {NOW}) > 72 * 3600)""", "store")
def f18(t):
    state = t.store.where("native_id % 2 = 0").select("id", F.col("first_seen").alias("checked_at"))
    return P.due_for_check(t.store, state, A.NOW).select("native_id")


@query("f19_due_for_enrichment", """
SELECT native_id FROM store WHERE source = 'lever' AND length(CASE WHEN native_id % 2 = 0 THEN 'short' ELSE description END) < 140 AND score >= 50 AND native_id % 7 <> 0""", "store")
def f19(t):
    s = t.store.withColumn("description", F.when(F.col("native_id") % 2 == 0, F.lit("short")).otherwise(F.col("description")))
    return P.due_for_enrichment(s, t.store.where("native_id % 7 = 0"), "lever", "careers.example.com/job").select("native_id")


@query("f20_list_applications", """
SELECT application_id FROM applications WHERE status = 'offer' AND contains(company, 'a') AND location = 'Bangalore'""", "applications")
def f20(t):
    return P.list_applications(t.applications, "Offer", "A", "bang").select("application_id")


@query("f21_prune", f"""
WITH m AS (SELECT native_id, NOT (date_diff('second', posted_date, {NOW}) > 72000 * 3600 / 10) OR native_id % 30 = 0 AS kept FROM store)
SELECT native_id, kept FROM m""", "store")
def f21(t):
    kept, dropped = P.prune(t.store, t.store.where("native_id % 30 = 0"), A.NOW, 7200)
    return kept.select("native_id", F.lit(True).alias("kept")).union(dropped.select("native_id", F.lit(False)))


@query("f22_semantic_filter", """
WITH pairs AS (SELECT e.vec_id, e.label, t.vec_id AS tid, t.label AS kind,
   list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(t.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[]))) AS sim
  FROM embeddings e, vector_queries q JOIN embeddings t ON t.vec_id = q.query_id),
m AS (SELECT vec_id, label, coalesce(max(sim) FILTER (tid % 2 = 0), 0) AS target_sim, coalesce(max(sim) FILTER (tid % 2 = 1), 0) AS exclude_sim FROM pairs GROUP BY 1, 2)
SELECT vec_id, round(target_sim, 4) AS target_similarity, round(exclude_sim, 4) AS exclude_similarity,
 (target_sim >= 0.3 OR label = 3) AND NOT exclude_sim > 0.6 AS passed FROM m""", "vector_queries")
def f22(t):
    from ..operators.vectors import semantic_filter
    targets = t.vector_queries.select(
        F.when(F.col("query_id") % 2 == 0, F.lit("target")).otherwise(F.lit("exclude")).alias("kind"), F.col("query").alias("vector"))
    items = t.embeddings.withColumn("keyword_hit", F.col("label") == 3)
    return semantic_filter(items, targets, 0.3, 0.6, keyword="keyword_hit", key="vec_id").select(
        "vec_id", F.round("target_similarity", 4).alias("target_similarity"),
        F.round("exclude_similarity", 4).alias("exclude_similarity"), "passed")


METRICS_SQL = """
metrics AS (SELECT company_id * 2 AS company_id, count(*) AS total_scans, count(*) FILTER (jobs_found > 0 AND error IS NULL) AS successful_scans,
  CAST(coalesce(sum(jobs_found) FILTER (jobs_found > 0 AND error IS NULL), 0) AS BIGINT) AS jobs_extracted, max_by(error, scanned_at) FILTER (error IS NOT NULL) AS last_error FROM scan_log GROUP BY 1)"""


def last_scans(t):
    """All scans of the log, dealt to every second company, so that the others have none."""
    return t.scan_log.withColumn("company_id", F.col("company_id") * 2)


@query("f23_zero_yield", f"""WITH {METRICS_SQL}
SELECT company_id FROM companies LEFT JOIN metrics USING (company_id) WHERE coalesce(successful_scans, 0) = 0 OR coalesce(jobs_extracted, 0) = 0""", "companies scan_log")
def f23(t):
    from ..operators.stats import scan_metrics
    return P.zero_yield(t.companies, scan_metrics(last_scans(t))).select("company_id")


@query("f24_preview_filter", """
SELECT count(*) FILTER (coalesce(score, 50) >= 90) AS would_match_count, count(*) AS total_evaluated,
 (SELECT string_agg(title, '|' ORDER BY native_id) FROM (SELECT * FROM store WHERE coalesce(score, 50) >= 90 ORDER BY native_id LIMIT 3)) AS sample_matches FROM store""", "store")
def f24(t):
    return P.preview_filter(t.store, 90, ["native_id"]).withColumn("sample_matches", F.array_join("sample_matches", "|"))


def trials(t):
    """Threshold trials derived from the feedback table."""
    return t.feedback.select(
        F.concat(F.lit("adj_"), F.col("feedback_id").cast("string")).alias("adjustment_id"),
        F.expr("CASE feedback_id % 3 WHEN 0 THEN 'role_filter' WHEN 1 THEN 'location_filter' ELSE 'exclude_filter' END").alias("threshold_name"),
        F.lit(0.8).alias("old_value"), F.lit(0.85).alias("new_value"),
        F.expr("timestamp'2024-01-25 00:00:00' + make_dt_interval(cast(feedback_id % 12 AS int))").alias("trial_period_end"),
        (F.col("job_match_score") % 30).alias("outcomes_count"),
        F.expr("CASE WHEN feedback_id % 7 = 0 THEN 'confirmed' WHEN feedback_id % 11 = 0 THEN 'reverted' ELSE 'pending' END").alias("status"),
        (F.col("job_match_score") / 100).alias("pre_precision"), (F.col("feedback_id") % 20 / 20).alias("pre_miss_rate"))


TRIALS_SQL = """
trials AS (SELECT 'adj_' || feedback_id AS adjustment_id, CASE feedback_id % 3 WHEN 0 THEN 'role_filter' WHEN 1 THEN 'location_filter' ELSE 'exclude_filter' END AS threshold_name,
  TIMESTAMP '2024-01-25 00:00:00' + to_days(CAST(feedback_id % 12 AS INTEGER)) AS trial_period_end, job_match_score % 30 AS outcomes_count,
  CASE WHEN feedback_id % 7 = 0 THEN 'confirmed' WHEN feedback_id % 11 = 0 THEN 'reverted' ELSE 'pending' END AS status,
  job_match_score / 100.0 AS pre_precision, feedback_id % 20 / 20.0 AS pre_miss_rate FROM feedback)"""


@query("f25_trials_due", f"""WITH {TRIALS_SQL}
SELECT adjustment_id FROM trials WHERE status = 'pending' AND (trial_period_end <= {ENOW} OR outcomes_count >= 20)""", "feedback")
def f25(t):
    return P.trials_due(trials(t), A.EVENT_NOW).select("adjustment_id")


def patterns(t):
    """Stored scraping patterns: one per scanned company, with its last validation."""
    return t.scan_log.groupBy("company_id").agg(F.max("scanned_at").alias("last"), F.count_if(F.col("error").isNotNull()).alias("failure_count")) \
        .withColumns({"last_validated": F.expr("CASE WHEN company_id % 9 = 0 THEN 'never' ELSE cast(last - make_dt_interval(cast(company_id % 10 AS int)) AS string) END"),
                      "status": F.when(F.col("failure_count") >= 3, F.lit("stale")).otherwise(F.lit("active"))}).drop("last")


@query("f26_patterns_due", f"""
WITH p AS (SELECT company_id, max(scanned_at) - to_days(CAST(company_id % 10 AS INTEGER)) AS last FROM scan_log GROUP BY 1)
SELECT company_id FROM p WHERE company_id % 9 = 0 OR last <= {ENOW} - INTERVAL 7 DAY""", "scan_log")
def f26(t):
    return P.patterns_due(patterns(t), A.EVENT_NOW).select("company_id")


@query("f27_followups_due", f"""
WITH h AS (SELECT application_id, max_by(status, struct_pack(a := step, b := "at", c := status)) AS st, max_by("at", struct_pack(a := step, b := "at", c := status)) AS last FROM status_history GROUP BY 1)
SELECT application_id FROM h WHERE st = 'interviewed' AND floor(date_diff('second', last, {NOW}) / 86400.0) >= 5""", "status_history")
def f27(t):
    from ..operators.windows import last_status
    return P.followups_due(t.applications.drop("status").join(last_status(t.status_history), "application_id"), A.NOW).select("application_id")


@query("f28_import_companies", r"""
WITH raw AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'Firm ' || CAST(o_custkey % 700 AS VARCHAR) END AS name,
  CASE o_orderkey % 6 WHEN 0 THEN 'nodots' WHEN 1 THEN 'http://f' || o_custkey % 700 || '.example.com' ELSE 'f' || o_custkey % 700 || '.example.com' END AS u FROM orders),
c AS (SELECT row_id, lower(name) AS n, CASE WHEN u LIKE 'http://%' THEN u ELSE 'https://' || u END AS url, name <> '' AND u <> 'nodots' AS ok FROM raw),
f AS (SELECT *, ok AND NOT (n IN ('firm 1', 'firm 2')) AS fresh FROM c),
g AS (SELECT *, min(row_id) FILTER (fresh) OVER (PARTITION BY n) AS fn, min(row_id) FILTER (fresh) OVER (PARTITION BY url) AS fu FROM f)
SELECT row_id, CASE WHEN NOT ok THEN 'invalid' WHEN fresh AND row_id = fn AND row_id = fu THEN 'added' ELSE 'duplicate' END AS outcome FROM g""")
def f28(t):
    raw = t.orders.select(
        F.col("o_orderkey").alias("row_id"),
        F.expr("CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE concat('Firm ', o_custkey % 700) END").alias("name"),
        F.expr("""CASE o_orderkey % 6 WHEN 0 THEN 'nodots' WHEN 1 THEN concat('http://f', o_custkey % 700, '.example.com')
                  ELSE concat('f', o_custkey % 700, '.example.com') END""").alias("career_url"))
    existing = t.spark.createDataFrame([("Firm 1", "https://z.example.com"), ("FIRM 2", "https://y.example.com")], "name string, career_url string")
    return P.import_companies(raw, existing, "row_id").select("row_id", "outcome")
