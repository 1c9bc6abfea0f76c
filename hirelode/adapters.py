"""Domain tables derived from the given tables, for queries, tests and benches.

Each definition is one SQL text read by both engines; only the name of the
string type differs.  ``{name}`` refers to another table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

SPREAD = ["orders", "lineitem", "events", "documents", "pages", "embeddings"]

NOW = "2001-08-02 00:00:00"          # order-derived tables end on 2001-08-01
EVENT_NOW = "2024-01-31 00:00:00"    # event-derived tables end on 2024-01-30

DEFINITIONS = {
    "postings": """
SELECT o_orderkey AS native_id,
  concat('https://careers.example.com/job/', CAST(g AS {STR}), '?utm_source=s', CAST(o_orderkey % 3 AS {STR}), '&gh_jid=', CAST(g AS {STR})) AS url,
  concat(substr(md5(CAST(g % 400 AS {STR})), 1, 6), CASE o_orderkey % 3 WHEN 0 THEN ' Pvt Ltd' WHEN 1 THEN ' Technologies' ELSE '' END) AS company,
  CASE CAST(g / 3 AS BIGINT) % 12
    WHEN 0 THEN 'Software Engineer' WHEN 1 THEN 'Senior Software Engineer' WHEN 2 THEN 'Software Engineer Intern'
    WHEN 3 THEN 'Backend Developer (Python)' WHEN 4 THEN 'SDE 2' WHEN 5 THEN 'Technical Support Engineer'
    WHEN 6 THEN 'Data Scientist' WHEN 7 THEN 'Marketing Manager' WHEN 8 THEN 'C++ Developer'
    WHEN 9 THEN 'QA Automation Engineer' WHEN 10 THEN 'Full Stack Developer - Fresher' ELSE 'Webinar on Cloud' END AS title,
  CASE o_orderkey % 7 WHEN 0 THEN 'Bengaluru, Karnataka' WHEN 1 THEN 'Gurgaon, India' WHEN 2 THEN 'Remote'
    WHEN 3 THEN 'Noida Sector 62' WHEN 4 THEN 'Berlin, Germany' WHEN 5 THEN 'Mumbai' ELSE '' END AS location,
  concat(CASE o_orderkey % 5 WHEN 0 THEN '3-5 years experience with Java and Spring Boot. ' WHEN 1 THEN 'Python, FastAPI and PostgreSQL; 0-2 years. '
    WHEN 2 THEN 'Minimum 4 years. React, TypeScript, AWS. ' WHEN 3 THEN 'See posting for details' ELSE 'Launched 9 years ago. SQL and Docker. ' END,
    coalesce(d.text, '')) AS description,
  o_orderdate AS posted_date,
  o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 4 AS INT) AS first_seen,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'greenhouse' WHEN '2-HIGH' THEN 'lever' WHEN '3-MEDIUM' THEN 'shine' WHEN '4-NOT SPECIFIED' THEN 'adzuna' ELSE 'web' END AS source,
  0.5 + CAST(o_orderkey % 5 AS DOUBLE) / 10 AS parse_confidence,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS INT) END AS score,
  CAST(1 + o_orderkey % 6 AS INT) AS tier,
  CASE WHEN o_orderkey % 8 = 0 THEN 'v1' ELSE 'v2' END AS profile_version,
  CASE o_orderstatus WHEN 'F' THEN 'INR 6,00,000 - 15,00,000' WHEN 'O' THEN '8 - 18 LPA' ELSE 'unspecified' END AS salary_text
FROM (SELECT *, o_orderkey - o_orderkey % 3 AS g FROM {orders}) o
LEFT JOIN {documents} d ON d.doc_id = o.g % (SELECT count(*) FROM {documents})""",
    "companies": """
SELECT s_suppkey AS company_id, concat(substr(md5(CAST(s_suppkey % 400 AS {STR})), 1, 6), ' India') AS name,
  CASE s_suppkey % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'workday' ELSE 'custom' END AS ats,
  concat('https://boards.example.com/', CAST(s_suppkey AS {STR})) AS career_url,
  CAST(s_suppkey % 10 AS DOUBLE) / 10 AS preference, CAST(s_suppkey % 5 AS DOUBLE) / 10 AS success_rate,
  s_acctbal * 100 AS avg_salary, CASE WHEN s_suppkey % 2 = 0 THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS difficulty
FROM {supplier}""",
    "applications": """
SELECT o_orderkey AS application_id, o_orderkey AS posting_id, substr(md5(CAST(o_orderkey % 400 AS {STR})), 1, 6) AS company,
  CASE o_orderkey % 3 WHEN 0 THEN 'Software Engineer' WHEN 1 THEN 'Data Scientist' ELSE 'QA Engineer' END AS job_title,
  CASE o_orderkey % 2 WHEN 0 THEN 'Bangalore' ELSE 'Remote' END AS location,
  CASE o_orderstatus WHEN 'F' THEN 'offer' WHEN 'O' THEN 'applied' ELSE 'rejected' END AS status,
  o_orderdate AS applied_at, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 10 END AS salary_offered,
  CASE WHEN o_orderkey % 20 = 0 THEN 'alumni' END AS referral_source
FROM {orders} WHERE o_orderkey % 4 = 0""",
    "status_history": """
SELECT o_orderkey AS application_id, 'applied' AS status, o_orderdate AS at, CAST(0 AS INT) AS step FROM {orders} WHERE o_orderkey % 4 = 0
UNION ALL SELECT l_orderkey, CASE l_linenumber % 2 WHEN 0 THEN 'interviewed' ELSE 'offer' END, l_shipdate, CAST(l_linenumber AS INT) FROM {lineitem} WHERE l_orderkey % 4 = 0""",
    "scan_log": """
SELECT event_id AS scan_id, user_id AS company_id, ts AS scanned_at,
  CASE WHEN event_type = 'error' THEN 0 ELSE CAST(event_id % 30 AS INT) END AS jobs_found,
  CASE WHEN event_type = 'error' THEN 0 ELSE CAST(event_id % 4 AS INT) END AS fresher_found,
  CASE event_type WHEN 'view' THEN 'heuristic' WHEN 'click' THEN 'stored_pattern' WHEN 'signup' THEN 'workday_api' ELSE 'apify' END AS method,
  CASE WHEN event_type = 'error' THEN 'Timeout' END AS error
FROM {events}""",
    "usage_log": """
SELECT event_id AS call_id, user_id % 5 AS key_id, ts AS called_at, value / 1000 AS credits, event_type = 'error' AS failed FROM {events}""",
    "feedback": """
SELECT l.doc_id AS feedback_id, l.doc_id * 3 AS posting_native_id, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS action,
  CASE WHEN toxic = 1 THEN 'too senior, lead role' ELSE 'good fit' END AS reason, CAST(l.doc_id * 37 % 101 AS INT) AS job_match_score
FROM {labels} l""",
    "ranking_labels": """
SELECT doc_id * 3 AS native_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'A' WHEN quality = 1 THEN 'B' WHEN toxic = 1 THEN 'E' ELSE 'D' END AS label FROM {labels}""",
    "vector_base": "SELECT vec_id, embedding, label FROM {embeddings} WHERE vec_id >= 20",
    "vector_queries": "SELECT vec_id AS query_id, embedding AS query FROM {embeddings} WHERE vec_id < 20",
    "cycles": """
SELECT date_trunc('hour', scanned_at) AS started_at, CAST(sum(jobs_found) AS BIGINT) AS jobs_found, CAST(sum(fresher_found) AS BIGINT) AS relevant_found
FROM {scan_log} GROUP BY date_trunc('hour', scanned_at)""",
}

# Target terms and the candidate profile used by the example queries.
TARGET_ROLES = ["Software Engineer", "Backend Developer", "C++", "Data Scientist", "Full Stack Developer"]
TARGET_LOCATIONS = ["Gurugram", "Bangalore", "NCR", "Remote"]
TARGET_EXPERIENCE = ["0-2 years", "Fresher"]
EXCLUSIONS = ["Senior", "Lead", "Manager", "Principal", "Director", "Architect", "Staff", "Sr"]
PROFILE_SKILLS = ["Python", "Postgres", "Docker", "java", "REST API", "ReactJS"]
PROFILE_VERSION = "v2"


def definition(name: str, string_type: str, ref) -> str:
    """SQL of a table with references rendered by ``ref``."""
    text = DEFINITIONS[name].replace("{STR}", string_type)
    for other in BASE + list(DEFINITIONS):
        text = text.replace("{%s}" % other, ref(other))
    return text


def references(name: str) -> list[str]:
    return [o for o in BASE + list(DEFINITIONS) if "{%s}" % o in DEFINITIONS[name]]


def zoned(df: DataFrame) -> DataFrame:
    """Times without a zone become instants; every rule here reads them as UTC."""
    return df.select(*[
        df[n].cast("timestamp").alias(n) if kind == "timestamp_ntz" else df[n] for n, kind in df.dtypes])


class Tables:
    """Given and derived tables of one data folder, built on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder, self._made = spark, folder.rstrip("/"), {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in BASE and name not in DEFINITIONS):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = self._read(name)
            else:
                used = {o: getattr(self, o) for o in references(name)}
                self._made[name] = self.spark.sql(definition(name, "STRING", lambda o: "{%s}" % o), **used)
        return self._made[name]

    def _read(self, name: str) -> DataFrame:
        df = zoned(self.spark.read.parquet(f"{self.folder}/{name}.parquet"))
        # a folder of many files already gives every core work; one small file does not
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if name in SPREAD and len(df.inputFiles()) < cores else df

    @cached_property
    def normalized(self) -> DataFrame:
        """Postings with canonical identity columns."""
        from .operators.identity import normalize_postings
        return normalize_postings(self.postings)

    @cached_property
    def store(self) -> DataFrame:
        """One posting per canonical id: the first landed row."""
        from .operators.sets import first_by
        return first_by(self.normalized, ["id"], ["native_id"])
