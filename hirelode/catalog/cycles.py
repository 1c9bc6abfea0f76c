"""Queries over the batch cycles Q*, chunking V1 and the streams T*."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import filters as P
from ..operators import scoring as C
from ..operators import sets as U
from ..operators import stats as R
from ..operators.identity import normalize_postings
from ..operators.texts import bring_texts, leave_texts, texts_aside
from ..plans import cycles as Y
from ..session import scratch_path, set_aside
from ..streaming import jobs as ST
from .base import ORACLES, query
from .filtering import TRIALS_SQL, trials
from .joining import D_SELECT, FB_SQL, MERGED_SQL, UNIQUE_SQL, merged_view, titled_feedback
from .reports import FM_SQL, PRIOR_SQL, PROFILE, SCORED, SCORED_STORE, STREAK_SQL, filter_metrics
from .summaries import BUCKET_SQL
from .text_fields import ts

FMT = "'%Y-%m-%d %H:%M:%S'"

Q_UNIQUE = """uq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY parse_confidence DESC, length(description) DESC, first_seen, native_id) AS rn,
  min(first_seen) OVER (PARTITION BY id) AS seen FROM pid WHERE title <> 'Webinar on Cloud') WHERE rn = 1)"""
UQ_SCORED = SCORED.replace("FROM postings) p)", "FROM uq) p)")


@query("q2_search_cycle", f"""WITH RECURSIVE {UNIQUE_SQL}, {UQ_SCORED}, x AS (SELECT *, coalesce(score, local_score) AS s FROM scored),
kk AS (SELECT *, date_diff('second', seen, TIMESTAMP '1999-06-15 00:00:00') / 3600.0 AS age FROM x WHERE s >= 20 AND date_diff('second', seen, TIMESTAMP '1999-06-15 00:00:00') <= 60 * 24 * 3600),
u AS (SELECT CASE WHEN count(*) FILTER (age <= 24) >= 10 THEN 24 ELSE 72 END AS used FROM kk)
SELECT native_id, s AS score FROM kk, u WHERE age <= used""", "pid")
def q2(t):
    mine = [t.postings.where(F.col("source") == s) for s in ("greenhouse", "lever", "shine", "adzuna", "web")]
    r = Y.search_cycle(mine, t.store, t.store.limit(0).select("id"), PROFILE, "1999-06-15 00:00:00", 20, [], [], 24 * 60)
    return r.curated.select("native_id", "score")


def moved(postings, host: str):
    """Changed copies of postings: under another host, so with other canonical ids."""
    return postings.withColumns({"url": F.replace("url", F.lit("careers.example.com"), F.lit(host)), "native_id": -F.col("native_id")})


@query("q3_scan_cycle")
def q3(t):
    # every posting meets the store; changed copies of a source are new to it, others are only stored; of the new ones those in Berlin are buried
    new = moved(t.postings.where("source = 'web'"), "new.example.com")
    gone = U.first_by(normalize_postings(moved(t.postings.where("source = 'adzuna'"), "old.example.com")), ["id"], ["native_id"])
    tombs = t.store.select("id").unionAll(normalize_postings(new.where("location = 'Berlin, Germany'")).select("id"))
    r = Y.scan_cycle(t.postings.unionByName(new), t.scan_log, t.store.unionByName(gone), tombs,
                     t.store.where("native_id % 30 = 0"), PROFILE, A.NOW, hours=24 * 1200, near=False)
    return r.store.select("id", "title", "score", "tier", "profile_version")


def scanned(t, near: bool = False):
    """A scan cycle with all it can know, over every posting and scan."""
    inputs = Y.ScanInputs(
        companies=t.companies, relevance=t.companies.select("company_id", F.col("preference").alias("relevance")), cycles=t.cycles,
        quota=t.events.select((100 - F.col("user_id") % 50).alias("quota_remaining")), filters=filter_metrics(t), feedback=t.feedback)
    none = t.store.limit(0).select("id")
    return Y.scan_cycle(t.postings, t.scan_log, t.store, none, none, PROFILE, A.EVENT_NOW, hours=24 * 12000, inputs=inputs, near=near)


@query("q3_scan_checks", f"""WITH {PRIOR_SQL}, {BUCKET_SQL.replace('{cycles}', 'cycles')},
q AS (SELECT (SELECT CAST(sum(100 - user_id % 50) AS BIGINT) FROM events) < round((SELECT sum(yield_multiplier) FROM yb) * (SELECT avg(jobs_found) FROM cycles), 1) AS low),
g AS (SELECT scan_id, round(parse_confidence, 2) AS c, coalesce(preference, 0.5) AS rel, yield_multiplier AS m, low FROM conf LEFT JOIN companies USING (company_id) JOIN yb ON start_hour = hour(scanned_at) // 3 * 3, q)
SELECT scan_id, m AS yield_multiplier, CASE WHEN c >= 0.8 THEN 'not needed' WHEN low AND rel < 0.85 THEN 'skipped: quota headroom low' WHEN m < 0.8 AND rel < 0.7 THEN 'skipped: low-yield cycle'
 WHEN rel < 0.5 THEN 'skipped: low relevance' ELSE 'triggered' END AS crosscheck FROM g""", "scan_log cycles companies")
def q3_checks(t):
    return scanned(t).checks.select("scan_id", "yield_multiplier", "crosscheck")


@query("q3_scan_ranking", """WITH m AS (SELECT company_id, CAST(CASE WHEN count(*) FILTER (jobs_found > 0 AND error IS NULL) > 0 AND coalesce(sum(jobs_found) FILTER (jobs_found > 0 AND error IS NULL), 0) >= 5 THEN 0.3 ELSE 0.8 END AS DOUBLE) AS d FROM scan_log GROUP BY 1)
SELECT c.company_id, row_number() OVER (ORDER BY preference DESC, success_rate DESC, avg_salary DESC, coalesce(d, 0.8), c.company_id) AS rank FROM companies c LEFT JOIN m USING (company_id)""", "companies scan_log")
def q3_ranking(t):
    return scanned(t).ranking.select("company_id", "rank")


@query("q3_scan_thresholds", ORACLES["c16_optimize_thresholds"])
def q3_thresholds(t):
    return scanned(t).thresholds.select("filter", "confident_misses", F.round("new_threshold", 2).alias("new_threshold"))


@query("q3_scan_counts", "SELECT count(*) AS unique_ids, 0::BIGINT AS above, 0::BIGINT AS unscored FROM store", "store")
def q3_counts(t):
    # every cluster keeps its rows' ids together: the sizes of all clusters add up to the unique ids, and no cluster is left without a score
    from ..operators.dedup import near_clusters, without_text
    r = scanned(t, near=True)
    clusters = near_clusters(without_text(t.store)).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    rows = r.store.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("score").isNull()).alias("unscored"), F.count_distinct("id").alias("ids"))
    sizes = clusters.agg(F.sum("n").alias("unique_ids"), F.count(F.lit(1)).alias("clusters"))
    return sizes.select("unique_ids", (rows.select("rows").scalar() - F.col("clusters")).alias("above"), rows.select("unscored").scalar().alias("unscored"))


@query("q4_rescore", f"""WITH {SCORED_STORE}
SELECT native_id, CASE WHEN score IS NOT NULL AND profile_version = 'v2' THEN score ELSE local_score END AS score, CASE WHEN score IS NOT NULL AND profile_version = 'v2' THEN tier ELSE 6 END AS tier FROM scored""", "store")
def q4(t):
    return Y.rescore(t.store, PROFILE)[0].select("native_id", "score", "tier")


@query("q4_refine_candidates", f"""WITH {SCORED_STORE}, r AS (SELECT *, CASE WHEN score IS NOT NULL AND profile_version = 'v2' THEN score ELSE local_score END AS s, CASE WHEN score IS NOT NULL AND profile_version = 'v2' THEN tier ELSE 6 END AS t2 FROM scored)
SELECT native_id, s AS score FROM r WHERE t2 > 2 AND s >= 50 ORDER BY s DESC, id LIMIT 150""", "store")
def q4b(t):
    return Y.rescore(t.store, PROFILE)[1].select("native_id", "score")


@query("q5_discovery_cycle", """
WITH c AS (SELECT company AS name, count(*) AS n FROM postings WHERE lower(company) NOT IN (SELECT lower(company) FROM applications) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40),
p AS (SELECT company AS name, source AS ats, count(*) FILTER (location IN ('Bengaluru, Karnataka', 'Gurgaon, India', 'Noida Sector 62', 'Mumbai')) AS india,
  count(*) FILTER (title IN ('Software Engineer Intern', 'Full Stack Developer - Fresher')) AS fresher, count(*) FILTER (title IN ('Software Engineer Intern', 'Full Stack Developer - Fresher') AND location IN ('Bengaluru, Karnataka', 'Gurgaon, India', 'Noida Sector 62', 'Mumbai')) AS two FROM postings WHERE company IN (SELECT name FROM c) GROUP BY 1, 2),
v AS (SELECT name, ats FROM p WHERE india > 0 AND fresher > 0 AND two > 0 ORDER BY name || '|' || ats LIMIT 25)
SELECT replace(lower(name), ' ', '-') AS company_id, min(name) AS name FROM v GROUP BY 1""", "postings applications")
def q5(t):
    names = t.applications.select(F.col("company").alias("name"))
    probed = t.postings.select(F.col("company").alias("name"), F.col("source").alias("ats"), "title", "location")
    none = t.companies.limit(0)
    return Y.discovery_cycle(t.postings, names, none.select("name"), probed, none.select(F.lit("x").alias("id"), "name"))[0].select("company_id", "name")


@query("q6_migrate", """
WITH v AS (SELECT * FROM pid WHERE title <> 'Webinar on Cloud'), r AS (SELECT coalesce(v.id, 'old-' || posting_id) AS id FROM applications a LEFT JOIN v ON v.native_id = a.posting_id)
SELECT count(*) AS total_raw, 0::BIGINT AS missing_company, 0::BIGINT AS missing_title, 0::BIGINT AS invalid_url, count(*) FILTER (title <> 'Webinar on Cloud' AND score IS NOT NULL AND profile_version <> 'v2') AS stale_scores,
 (SELECT count(DISTINCT id) FROM v) AS unique_canonical, (SELECT count(DISTINCT id) FROM r) AS migrated_applications, (SELECT count(DISTINCT id) FROM r WHERE id LIKE 'old-%') AS orphan_applications FROM pid""", "pid applications")
def q6(t):
    landed = t.postings.withColumn("old_id", F.concat(F.lit("old-"), F.col("native_id").cast("string")))
    apps = t.applications.withColumn("id", F.concat(F.lit("old-"), F.col("posting_id").cast("string")))
    return Y.migrate(landed, apps, "v2", near=False)[2]


@query("q7_feedback_cycle", f"""WITH {FB_SQL}, {FM_SQL}, {TRIALS_SQL}
SELECT 'feedback' AS what, count(*) AS n FROM fb UNION ALL SELECT 'liked terms', count(DISTINCT job_title) FROM fb WHERE action = 'yes' UNION ALL SELECT 'filters', count(*) FROM fm
UNION ALL SELECT 'trials', count(*) FROM trials WHERE status = 'pending' AND (trial_period_end <= TIMESTAMP '2024-01-31' OR outcomes_count >= 20)""", "postings feedback")
def q7(t):
    r = Y.feedback_cycle(titled_feedback(t), filter_metrics(t), trials(t), A.EVENT_NOW, [], [])
    one = F.count(F.lit(1)).alias("n")
    parts = [r["summary"].select(F.lit("feedback").alias("what"), F.col("total_feedback").alias("n")),
             r["keywords"].where("filter = 'target_role'").agg(one).select(F.lit("liked terms").alias("what"), "n"),
             r["thresholds"].agg(one).select(F.lit("filters").alias("what"), "n"), r["trials"].agg(one).select(F.lit("trials").alias("what"), "n")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("v1_chunk")
def v1(t):
    from ..operators.chunks import chunk
    return chunk(t.documents, "doc_id", "text").select("doc_id", "chunk_id", F.length("content").alias("n_chars"), F.md5("content").alias("digest"))


# --- streams -----------------------------------------------------------------

def deliver(t, df, at: str, tie: str, run):
    """Land a table in four deliveries and call ``run(stream)`` after each; the second one comes twice.

    Deliveries are quarters of the time the table covers; of the last hour before a new
    quarter, rows with an odd ``tie`` come with the quarter, so times cross the files.
    """
    root, stream = scratch_path(t.spark, "landing"), None
    us = F.unix_micros(F.col(at))
    low, high = df.agg(F.min(us), F.max(us)).first()
    part = F.floor((us + F.when(F.col(tie) % 2 == 1, 3_600_000_000).otherwise(0) - (low or 0)) * 4 / (((high or 0) - (low or 0)) + 1))
    rows, texts = leave_texts(df)
    # found once for all deliveries
    rows = set_aside(rows.withColumn("part", F.least(F.lit(3), part).cast("int")))
    texts = None if texts is None else texts_aside(df)
    # merged by their marks, rows with one text stand next to each other in the files and cost little there
    placed = bring_texts(rows, None if texts is None else texts.hint("merge"), df.columns)
    for n, part in enumerate([0, 1, 1, 2, 3]):
        placed.where(F.col("part") == part).select(*df.columns).write.parquet(f"{root}/landed/delivery-{n}")
        if n == 0:
            stream = t.spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{root}/landed")
        run(stream)
    return stream


def ordered(t, make, events, at: str, tie: str):
    """An ordered job over the deliveries of ``events``; what is still held counts as complete."""
    job = make(ST.Ledger(t.spark, scratch_path(t.spark, "ordered")))
    deliver(t, events, at, tie, job.run)
    return job.view()


def windowed(t, job, events, at: str, tie: str):
    root = scratch_path(t.spark, "windows")
    stream = deliver(t, events, at, tie, lambda s: job.run(s, root))
    return job.all(stream, root)


def scan_events(t):
    return t.scan_log.select("scan_id", "company_id", "scanned_at", "jobs_found", "fresher_found")


def posting_stream(t):
    o = ST.read_folder(t.spark, t.folder, "orders")
    return normalize_postings(t.spark.sql(A.definition("postings", "STRING", lambda n: "{%s}" % n), orders=o, documents=t.documents))


def ingested(t):
    job = ST.IngestJob(ST.Ledger(t.spark, scratch_path(t.spark, "ingest")), ST.IngestConfig(PROFILE, "1999-06-15 00:00:00", 20, hours=60 * 24))
    # boards land postings without a match
    landed = t.postings.withColumns({"score": F.lit(None).cast("int"), "tier": F.lit(None).cast("int"), "profile_version": F.lit(None).cast("string")})
    deliver(t, landed, "first_seen", "native_id", job.run)
    return job


@query("t1_ingest_stream", f"WITH {Q_UNIQUE}, {UQ_SCORED} SELECT native_id, local_score FROM scored", "pid")
def t1(t):
    job = ingested(t)
    return job.table("store").join(job.table("scores"), "id").select("native_id", "local_score")


@query("t1_ingest_store", f"WITH valid AS (SELECT * FROM pid WHERE title <> 'Webinar on Cloud'), {MERGED_SQL.replace('{src}', 'valid')} {D_SELECT}", "pid")
def t1b(t):
    return merged_view(ingested(t).table("store"))


@query("t1_ingest_curated", f"""WITH {Q_UNIQUE}, {UQ_SCORED}, kk AS (SELECT *, date_diff('second', seen, TIMESTAMP '1999-06-15 00:00:00') / 3600.0 AS age FROM scored WHERE local_score >= 20 AND date_diff('second', seen, TIMESTAMP '1999-06-15 00:00:00') <= 60 * 24 * 3600),
u AS (SELECT CASE WHEN count(*) FILTER (age <= 24) >= 10 THEN 24 ELSE 72 END AS used FROM kk)
SELECT native_id, local_score AS score FROM kk, u WHERE age <= used""", "pid")
def t1c(t):
    return ingested(t).table("curated").select("native_id", "score")


@query("t2_dedup_stream", "SELECT DISTINCT id FROM pid", "pid")
def t2(t):
    ST.enable_state(t.spark)
    return ST.run_available(ST.dedup_stream(posting_stream(t).select("id", "first_seen"))).select("id")


@query("t3_tombstone_stream", """
WITH o AS (SELECT 'p' || o_custkey % 50 AS id, o_orderdate AS seen_at, o_orderkey % 5 = 0 AS pruned FROM orders),
m AS (SELECT *, max(CASE WHEN pruned THEN seen_at END) OVER (PARTITION BY id ORDER BY seen_at, CASE WHEN pruned THEN 0 ELSE 1 END ROWS UNBOUNDED PRECEDING) AS last_at FROM o)
SELECT id, count(*) AS seen FROM m WHERE NOT pruned AND (last_at IS NULL OR date_diff('second', last_at, seen_at) >= 30 * 86400) GROUP BY 1""")
def t3(t):
    events = t.orders.select(
        F.col("o_orderkey").alias("event_id"), F.expr("concat('p', o_custkey % 50)").alias("id"), F.col("o_orderdate").alias("at"),
        F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'pruned' ELSE 'seen' END").alias("kind"))
    return ordered(t, ST.tombstone_job, events, "at", "event_id")[1].groupBy("id").agg(F.count(F.lit(1)).alias("seen"))


@query("t4_event_time", "SELECT native_id, strftime(CASE WHEN native_id % 2 = 0 THEN posted_date ELSE first_seen END, '%Y-%m-%d %H:%M:%S') AS event_ts FROM postings", "postings")
def t4(t):
    p = t.postings.withColumn("posted_date", F.when(F.col("native_id") % 2 == 0, F.col("posted_date")))
    return ST.with_event_time(p).select("native_id", ts("event_ts").alias("event_ts"))


@query("t5_yield_stream", f"""
SELECT strftime(time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '2000-01-01'), {FMT}) AS started_at, count(*) AS scans, CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 30 END) AS BIGINT) AS jobs_found FROM events GROUP BY 1""")
def t5(t):
    return ST.yield_rows(windowed(t, ST.yield_windows(), scan_events(t), "scanned_at", "scan_id")).select(ts("started_at").alias("started_at"), "scans", "jobs_found")


@query("t6_rate_stream", f"""
WITH e AS (SELECT user_id % 5 AS key_id, epoch(ts) AS s FROM events), w AS (SELECT key_id, CAST(floor(s / 10) AS BIGINT) * 10 - k * 10 AS st FROM e, (SELECT unnest(range(6)) AS k))
SELECT key_id, st AS started_at, count(*) AS calls FROM w GROUP BY 1, 2""")
def t6(t):
    rows = ST.rate_rows(windowed(t, ST.rate_windows("2 hours"), t.usage_log, "called_at", "call_id"))
    return rows.select("key_id", F.unix_timestamp("started_at").alias("started_at"), "calls")


@query("t7_streak_stream", f"WITH {STREAK_SQL} SELECT company_id, zero_streak AS zero_yield_streak, fresher_streak AS fresher_zero_streak FROM streak", "scan_log")
def t7(t):
    return ordered(t, ST.streak_job, scan_events(t), "scanned_at", "scan_id")[0].select("company_id", "zero_yield_streak", "fresher_zero_streak")


@query("t8_pattern_stream", """
WITH e AS (SELECT user_id AS company_id, struct_pack(a := ts, b := event_id) AS k, event_type NOT IN ('view', 'click') AS failed FROM events), r AS (SELECT company_id, max(k) FILTER (NOT failed) AS k FROM e GROUP BY 1)
SELECT company_id, count(*) FILTER (failed AND (r.k IS NULL OR e.k > r.k)) AS failure_count FROM e JOIN r USING (company_id) GROUP BY 1""")
def t8(t):
    events = t.scan_log.select(F.col("scan_id").alias("event_id"), "company_id", F.col("scanned_at").alias("at"), F.when(
        F.col("method").isin("heuristic", "stored_pattern") & F.col("error").isNull(), F.lit("validated")).otherwise(F.lit("failed")).alias("kind"))
    return ordered(t, ST.pattern_job, events, "at", "event_id")[0].select("company_id", "failure_count")


# a deadline passes with the time of all events, not only of the trial's own
@query("t9_trial_stream", """
WITH e AS (SELECT 'trial ' || user_id AS trial, epoch_us(ts) AS us, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS t0 FROM events),
c AS (SELECT trial, t0, count(*) FILTER (us - t0 < 3 * 86400000000) AS n FROM e GROUP BY 1, 2)
SELECT trial, least(20, n) AS outcomes, CASE WHEN n >= 20 THEN 'outcomes' ELSE 'deadline' END AS closed_by FROM c
WHERE n >= 20 OR (SELECT max(epoch_us(ts)) FROM events) - t0 >= 3 * 86400000000""")
def t9(t):
    outcomes = t.events.select(F.col("event_id").alias("outcome_id"), F.expr("concat('trial ', user_id)").alias("trial"), F.col("ts").alias("at"))
    return ordered(t, ST.trial_job, outcomes, "at", "outcome_id")[0].where("closed_by IS NOT NULL").select("trial", "outcomes", "closed_by")


@query("t10_quota_stream", "SELECT user_id % 5 AS key_id, strftime(ts - INTERVAL 8 HOUR, '%Y-%m-%d') AS quota_day, count(*) AS used, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1, 2")
def t10(t):
    return ST.quota_rows(windowed(t, ST.quota_windows("2 hours"), t.usage_log, "called_at", "call_id"))


@query("t11_watch_stream", """
SELECT 'firm ' || user_id AS name, count(*) AS checks, CAST(max(f) AS BIGINT) AS best_fresher_seen, CASE WHEN arg_max(f, struct_pack(a := ts, b := event_id)) > 0 THEN 'promoted' ELSE 'parked' END AS state
FROM (SELECT *, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 4 END AS f FROM events) GROUP BY 1""")
def t11(t):
    probes = t.scan_log.select(F.col("scan_id").alias("probe_id"), F.expr("concat('firm ', company_id)").alias("name"),
                               F.col("scanned_at").alias("checked_at"), F.col("fresher_found").alias("fresher_jobs"))
    return ordered(t, ST.watch_job, probes, "checked_at", "probe_id")[0]


@query("t12_since", "SELECT native_id FROM postings WHERE first_seen > TIMESTAMP '2000-01-01'", "postings")
def t12(t):
    return ST.run_available(ST.since(posting_stream(t).select("native_id", "first_seen"), "2000-01-01 00:00:00")).select("native_id")
