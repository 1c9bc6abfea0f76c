"""Queries over the Column functions: projections P*, scalar functions X*."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..functions import fields as V
from ..functions import skills as S
from ..functions import text as T
from ..operators.filters import stated_years
from .base import query


def ts(col):
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


# --- projections -------------------------------------------------------------

@query("p1_normalize_url", r"""
WITH raw AS (SELECT page_id, CASE WHEN url LIKE 'http://%' OR url LIKE 'https://%' THEN url ELSE 'https://' || url END AS u FROM pages),
parts AS (SELECT page_id, lower(regexp_extract(u, '^([a-z]+)://', 1)) AS s, lower(regexp_extract(u, '^[a-z]+://([^/?#]*)', 1)) AS h,
    regexp_replace(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS p, regexp_extract(u, '\?([^#]*)', 1) AS q FROM raw),
pairs AS (SELECT page_id, unnest(string_split(q, '&')) AS kv FROM parts),
kept AS (SELECT page_id, kv FROM pairs WHERE position('=' IN kv) > 0 AND split_part(kv, '=', 2) <> '' AND NOT regexp_matches(lower(kv), '^(utm_[a-z_]*|source|ref|referrer|tracking|session|session_id|fbclid|gclid|msclkid|spm|src|trk|trkparams|mode|from|via|_hsenc|_hsmi|mc_cid|mc_eid)=')),
qs AS (SELECT page_id, string_agg(kv, '&' ORDER BY kv) AS q FROM kept GROUP BY page_id)
SELECT p.page_id, s || '://' || h || p || CASE WHEN qs.q IS NULL THEN '' ELSE '?' || qs.q END AS canonical_url
FROM parts p LEFT JOIN qs USING (page_id)""")
def p1(t):
    return t.pages.select("page_id", T.normalize_url("url").alias("canonical_url"))


@query("p2_clean_company", r"""
SELECT native_id, CASE WHEN c = '' THEN 'unknown' ELSE c END AS company_clean FROM (
SELECT native_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(company), '\b(inc|incorporated|ltd|limited|pvt|private|llp|corp|corporation|co|technologies|solutions|india|services)\b\.?', '', 'g'), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')) AS c FROM postings)""", "postings")
def p2(t):
    return t.postings.select("native_id", T.clean_company("company").alias("company_clean"))


@query("p3_clean_title", r"""
SELECT native_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(title), '[()\[\]{}]', ' ', 'g'), '[^\w\s-]', '', 'g'), '\s+', ' ', 'g')) AS title_clean FROM postings""", "postings")
def p3(t):
    return t.postings.select("native_id", T.clean_title("title").alias("title_clean"))


@query("p4_clean_location", r"""
SELECT native_id, CASE WHEN l LIKE '%bengaluru%' THEN 'bangalore' WHEN l LIKE '%gurgaon%' THEN 'gurugram' WHEN l LIKE '%noida%' THEN 'noida'
 WHEN l LIKE '%hyderabad%' THEN 'hyderabad' WHEN l LIKE '%mumbai%' THEN 'mumbai' WHEN l LIKE '%delhi%' THEN 'delhi'
 WHEN l LIKE '%remote%' OR l LIKE '%work from home%' THEN 'remote' WHEN l = '' THEN 'india' ELSE l END AS location_clean
FROM (SELECT native_id, trim(regexp_replace(regexp_replace(lower(location), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS l FROM postings)""", "postings")
def p4(t):
    return t.postings.select("native_id", T.clean_location("location").alias("location_clean"))


@query("p5_req_id", r"""
SELECT native_id, CASE WHEN native_id % 10 = 0 THEN 'r-' || native_id ELSE lower(regexp_extract(url, '(?i)\b(req[-_]?\d+|\d{5,10})\b', 1)) END AS req FROM postings""", "postings")
def p5(t):
    stated = F.when(F.col("native_id") % 10 == 0, F.concat(F.lit(" R-"), F.col("native_id").cast("string")))
    return t.postings.select("native_id", T.req_id(stated, "url").alias("req"))


@query("p6_canonical_id", r"""
SELECT native_id, substr(sha256(CASE WHEN native_id % 5 = 0 AND source <> 'web' THEN 'native:' || source || ':' || native_id
  WHEN native_id % 7 <> 0 THEN 'url:' || canonical_url ELSE 'fp:' || ncompany || '|' || ntitle || '|' || nlocation END), 1, 16) AS canonical FROM pid""", "pid")
def p6(t):
    p = t.postings.withColumn("source_id", F.when(F.col("native_id") % 5 == 0, F.col("native_id"))) \
        .withColumn("url", F.when(F.col("native_id") % 7 != 0, F.col("url")))
    return p.select("native_id", T.canonical_id(
        "company", "title", "location", "url", source="source", source_id="source_id").alias("canonical"))


@query("p7_normalize_postings", r"""
SELECT native_id, id, canonical_url, ncompany AS normalized_company, ntitle AS normalized_title, nlocation AS normalized_location,
  req AS req_id, source AS sources, source || '=' || native_id AS source_ids FROM pid""", "pid")
def p7(t):
    return t.normalized.select(
        "native_id", "id", "canonical_url", "normalized_company", "normalized_title", "normalized_location", "req_id",
        F.array_join("sources", ",").alias("sources"),
        F.array_join(F.transform(F.map_entries("source_ids"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
        .alias("source_ids"))


@query("p8_probe_slug", r"""
SELECT company_id, CASE WHEN length(s) >= 3 THEN s END AS slug FROM (
SELECT company_id, regexp_replace(regexp_replace(lower(name), '\b(pvt|private|limited|ltd|inc|llc|technologies|technology|solutions|group|india|labs)\b', '', 'g'), '[^a-z0-9]', '', 'g') AS s FROM companies)""", "companies")
def p8(t):
    return t.companies.select("company_id", T.probe_slug("name").alias("slug"))


@query("p9_dash_slug", r"""
SELECT native_id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM postings""", "postings")
def p9(t):
    return t.postings.select("native_id", T.dash_slug("title").alias("slug"))


@query("p10_split_glued_title", r"""
SELECT native_id, title AS title_part, CASE WHEN native_id % 2 = 0 THEN CASE native_id % 3 WHEN 0 THEN 'India, Pune' WHEN 1 THEN 'Germany' ELSE 'United States, Austin' END END AS location_part
FROM postings WHERE title <> 'C++ Developer' OR TRUE""", "postings")
def p10(t):
    place = F.when(F.col("native_id") % 3 == 0, F.lit("India, Pune")).when(
        F.col("native_id") % 3 == 1, F.lit("Germany")).otherwise(F.lit("United States, Austin"))
    raw = F.when(F.col("native_id") % 2 == 0, F.concat("title", place, F.lit("Posted 19 days ago"))) \
        .otherwise(F.concat("title", F.lit(" Posted today")))
    s = T.split_glued_title(raw)
    return t.postings.select("native_id", s["title"].alias("title_part"), s["location"].alias("location_part"))


@query("p11_resolve_url", r"""
WITH links AS (SELECT page_id, regexp_extract(url, '^https?://[^/?#]*') AS site, url, CASE page_id % 5 WHEN 0 THEN '/jobs/' || page_id WHEN 1 THEN 'javascript:void(0)' WHEN 2 THEN '#' WHEN 3 THEN 'https://x.example.com/a' ELSE '' END AS href FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN site || href WHEN 3 THEN href ELSE url END AS link FROM links""")
def p11(t):
    href = F.expr("""CASE page_id % 5 WHEN 0 THEN concat('/jobs/', page_id) WHEN 1 THEN 'javascript:void(0)' WHEN 2 THEN '#'
                     WHEN 3 THEN 'https://x.example.com/a' ELSE '' END""")
    return t.pages.select("page_id", T.resolve_url(href, "url").alias("link"))


@query("p12_min_experience_years", r"""
WITH x AS (SELECT native_id, title || '  ' || description AS t FROM postings),
h AS (SELECT native_id, list_concat(regexp_extract_all(t, '(?i)(\d{1,2})\s*(?:-|–|to)\s*\d{1,2}\s*\+?\s*(?:years?|yrs?)', 1),
  regexp_extract_all(t, '(?i)(\d{1,2})\s*\+\s*(?:years?|yrs?)', 1)) AS a,
  list_concat(regexp_extract_all(t, '(?i)(?:minimum(?:\s+of)?|at\s+least)\s+(\d{1,2})\s*(?:years?|yrs?)', 1),
  regexp_extract_all(t, '(?i)(\d{1,2})\s*\+?\s*(?:years?|yrs?)(?:[''’]s?)?\s*(?:of\s+)?(?:relevant\s+|professional\s+|industry\s+|prior\s+|hands.on\s+|work(?:ing)?\s+)*experience', 1)) AS b,
  list_concat(regexp_extract_all(t, '(?i)experience\s*(?:required|needed)?\s*[:\-–]\s*(\d{1,2})\s*\+?\s*(?:years?|yrs?)', 1),
  regexp_extract_all(t, '(?i)(?:min\.?(?:imum)?|at\s+least|requires?|needs?|must\s+have)\s+(?:of\s+)?(\d{1,2})\s*\+?\s*(?:years?|yrs?)', 1)) AS c FROM x)
SELECT native_id, list_min(list_transform(list_concat(list_concat(a, b), c), lambda v: CAST(v AS INTEGER))) AS min_years FROM h""", "postings")
def p12(t):
    return stated_years(t.postings).select("native_id", "min_years")


@query("p13_max_user_years", r"""
SELECT company_id, CASE company_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 5 END AS max_years FROM companies""", "companies")
def p13(t):
    terms = F.expr("""CASE company_id % 4 WHEN 0 THEN array('0-2 years', 'Fresher') WHEN 1 THEN array('Entry-level')
                      WHEN 2 THEN array('3 years', '1 to 5 years') ELSE array('any') END""")
    return t.companies.select("company_id", V.max_user_years(terms).alias("max_years"))


@query("p14_is_stub", r"""
SELECT native_id, length(description) < 140 OR description LIKE '%See posting for details%' AS stub FROM postings""", "postings")
def p14(t):
    return t.postings.select("native_id", V.is_stub("description").alias("stub"))


@query("p15_age_hours", r"""
SELECT native_id, CAST(date_diff('hour', CASE WHEN native_id % 3 = 0 THEN first_seen WHEN native_id % 3 = 1 THEN posted_date END, TIMESTAMP '2001-08-02 00:00:00') AS DOUBLE) AS age FROM postings""", "postings")
def p15(t):
    from ..operators.filters import age_hours
    p = t.postings.withColumns({
        "posted_date": F.when(F.col("native_id") % 3 == 1, F.col("posted_date").cast("string")).when(
            F.col("native_id") % 3 == 2, F.lit("Posted yesterday")),
        "first_seen": F.when(F.col("native_id") % 3 == 0, F.col("first_seen"))})
    return p.select("native_id", age_hours(p, A.NOW).alias("age"))


@query("p16_parse_any_ts", r"""
SELECT event_id, CASE WHEN event_id % 7 IN (0, 1, 5) THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN event_id % 7 = 6 THEN NULL ELSE strftime(ts, '%Y-%m-%d 00:00:00') END AS parsed FROM events""")
def p16(t):
    text = F.expr("""CASE event_id % 7 WHEN 0 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'") WHEN 1 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss')
      WHEN 2 THEN date_format(ts, 'yyyy-MM-dd') WHEN 3 THEN date_format(ts, 'dd/MM/yyyy') WHEN 4 THEN date_format(ts, 'yyyy/MM/dd')
      WHEN 5 THEN date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'") ELSE 'Posted 3 days ago' END""")
    return t.events.select("event_id", ts(V.parse_any_ts(text)).alias("parsed"))


@query("p17_hour_bucket", r"""
SELECT event_id, printf('%02d:00-%02d:00', hour(ts) // 3 * 3, hour(ts) // 3 * 3 + 3) AS bucket FROM events""")
def p17(t):
    return t.events.select("event_id", V.hour_bucket("ts").alias("bucket"))


@query("p18_fill_defaults", r"""
SELECT native_id, CASE WHEN native_id % 4 = 0 THEN 'Unknown Company' ELSE company END AS company,
  CASE WHEN native_id % 3 = 0 THEN title || ' role at ' || CASE WHEN native_id % 4 = 0 THEN 'Unknown Company' ELSE company END ELSE description END AS description FROM postings""", "postings")
def p18(t):
    from ..sources.common import fill_defaults
    p = t.postings.withColumns({
        "company": F.when(F.col("native_id") % 4 == 0, F.lit("  ")).otherwise(F.col("company")),
        "description": F.when(F.col("native_id") % 3 != 0, F.col("description"))})
    return fill_defaults(p).select("native_id", "company", "description")


@query("p19_parse_salary", r"""
SELECT native_id, CASE WHEN salary_text LIKE 'INR%' THEN 600000.0::DOUBLE WHEN salary_text LIKE '8%' THEN 800000.0::DOUBLE END AS low,
  CASE WHEN salary_text LIKE 'INR%' THEN 1500000.0::DOUBLE WHEN salary_text LIKE '8%' THEN 1800000.0::DOUBLE END AS high FROM postings""", "postings")
def p19(t):
    s = V.parse_salary("salary_text")
    return t.postings.select("native_id", s["low"].cast("double").alias("low"), s["high"].cast("double").alias("high"))


@query("p20_combined_text", r"""
SELECT native_id, lower(title || ' ' || location || ' ' || company || ' ' || description || '  python java') AS body FROM postings""", "postings")
def p20(t):
    return t.postings.select("native_id", T.combined_text(
        "title", "location", "company", "description", None, F.array(F.lit("Python"), F.lit("Java"))).alias("body"))


@query("p21_compress_html", r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<svg[^>]*>.*?</svg>|<noscript[^>]*>.*?</noscript>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?i)\s(?:data-[\w-]+|srcset|style|integrity|nonce)="[^"]*"', '', 'g'), '\s+', ' ', 'g') AS h FROM a)
SELECT page_id, length(h) AS n_chars, md5(h) AS digest FROM b""")
def p21(t):
    h = T.compress_html("html")
    return t.pages.select("page_id", F.length(h).cast("long").alias("n_chars"), F.md5(h).alias("digest"))


# --- scalar functions --------------------------------------------------------

PAIRED = r"""
WITH w AS (SELECT native_id, list_distinct(string_split(lower(title), ' ')) AS a, list_distinct(string_split(lower(CASE native_id % 3 WHEN 0 THEN 'Software Engineer' WHEN 1 THEN 'Senior Software Engineer Intern' ELSE 'Data Developer' END), ' ')) AS b FROM postings)
SELECT native_id, round(len(list_intersect(a, b)) / CAST({pick}(len(a), len(b)) AS DOUBLE), 6) AS ratio FROM w"""


def _other():
    return F.expr("CASE native_id % 3 WHEN 0 THEN 'Software Engineer' WHEN 1 THEN 'Senior Software Engineer Intern' ELSE 'Data Developer' END")


@query("x1_token_set_ratio", PAIRED.replace("{pick}", "greatest"), "postings")
def x1(t):
    return t.postings.select("native_id", F.round(T.token_set_ratio("title", _other()), 6).alias("ratio"))


@query("x2_subset_ratio", PAIRED.replace("{pick}", "least"), "postings")
def x2(t):
    return t.postings.select("native_id", F.round(T.subset_ratio("title", _other()), 6).alias("ratio"))


@query("x3_seq_ratio")
def x3(t):
    from ..operators.near_dup import seq_ratio
    return t.postings.select("title").distinct().select(
        "title", F.round(seq_ratio("title", F.lit("Software Engineer")), 6).alias("ratio"))


@query("x4_tokens", r"""
SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (
SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\pL\pM\pN_\x{200c}\x{200d}]+')) AS t FROM documents)""")
def x4(t):
    tk = T.tokens("text")
    return t.documents.select("doc_id", F.size(tk).cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort(tk), " ")).alias("digest"))


@query("x5_has_word", r"""
SELECT native_id, regexp_matches(lower(title), '(^|[^a-z0-9_])engineer($|[^a-z0-9_])') AS hit FROM postings""", "postings")
def x5(t):
    return t.postings.select("native_id", T.has_word("title", "Engineer").alias("hit"))


def _skill_sql() -> str:
    # written apart from the library: one test per skill on padded text
    words = ("Python Java JavaScript TypeScript React Angular Vue Node.js Express Flask Django FastAPI Spring_Boot SQL "
             "PostgreSQL MySQL MongoDB Redis AWS Azure GCP Docker Kubernetes Git Linux REST_API GraphQL Microservices "
             "Machine_Learning Deep_Learning NLP Pandas NumPy PyTorch TensorFlow HTML Tailwind Bootstrap CI/CD").split()
    tests = []
    for w in (x.replace("_", " ") for x in words):
        p = w.upper().replace(".", r"\.")
        extra = {"PostgreSQL": "|POSTGRES", "AWS": "|AMAZON WEB SERVICES|AWS EC2", "GCP": "|GOOGLE CLOUD PLATFORM",
                 "JavaScript": "|JS", "TypeScript": "|TS"}.get(w, "")
        tests.append(rf"CASE WHEN regexp_matches(t, '(^|[^\pL\pN_])({p}{extra})($|[^\pL\pN_])') THEN '{w}' END")
    tests.append(r"CASE WHEN regexp_matches(t, '(^|[^\pL\pN_])C\+\+($|\s|[\pL\pN_])') THEN 'C++' END")
    tests.append(r"CASE WHEN regexp_matches(t, '(^|[^\pL\pN_])C#($|\s|[\pL\pN_])') THEN 'C#' END")
    tests.append(r"CASE WHEN regexp_matches(t, '(^|\s|\b)(GOLANG|GO\s*(DEVELOPER|ENGINEER|PROGRAMMING|LANGUAGE|BACKEND|STACK|CODE)|(WRITTEN IN|EXPERIENCE IN|PROFICIENT IN|KNOWLEDGE OF|USING)\s+GO|GO\s*[/,]\s*(PYTHON|C\+\+|JAVA|RUST|DOCKER|KUBERNETES))($|\s|\b)') THEN 'Go' END")
    tests.append(r"CASE WHEN regexp_matches(t, '(^|\s|\b)(C\s*(/\s*C\+\+|PROGRAMMING|PROGRAMMER|LANGUAGE|DEVELOPER|ENGINEER|CODE|DRIVER)|EMBEDDED\s+C|C\s+(OR|,)\s+C\+\+|(WRITTEN IN|EXPERIENCE IN|PROFICIENT IN|KNOWLEDGE OF)\s+C)($|\s|\b)') THEN 'C' END")
    tests.append(r"CASE WHEN regexp_matches(t, '(^|\s|\b)(RSTUDIO|R-STUDIO|R\s*(PROGRAMMING|LANGUAGE|STUDIO|DEVELOPER|ANALYTICS)|(WRITTEN IN|EXPERIENCE IN|PROFICIENT IN)\s+R|R\s*[/,]\s*(PYTHON|SQL|SAS|STATA|PANDAS))($|\s|\b)') THEN 'R' END")
    tests.append(r"CASE WHEN regexp_matches(t, '(^|\s|\b)(ARTIFICIAL INTELLIGENCE|GENAI|GENERATIVE AI|AI/ML|AI\s*(ENGINEER|DEVELOPER|MODEL|SYSTEM|PLATFORM|SOLUTION|APPLICATION|RESEARCH|TOOLS))($|\s|\b)') THEN 'AI' END")
    tests.append(r"CASE WHEN regexp_matches(t, '(^|\s|\b)(CSS3?|HTML\s*[/,&\+]\s*CSS|TAILWIND|BOOTSTRAP)($|\s|\b)') THEN 'CSS' END")
    return "list_sort(list_distinct(list_filter([" + ",\n ".join(tests) + "], lambda s: s IS NOT NULL)))"


SKILLS_SQL = _skill_sql()   # of a column named t, upper-cased


@query("x6_extract_skills", f"""
SELECT native_id, array_to_string({SKILLS_SQL}, '|') AS skills FROM (SELECT native_id, upper(title || ' ' || description) AS t FROM postings)""", "postings")
def x6(t):
    return t.postings.select("native_id", F.array_join(S.extract_skills(F.concat_ws(" ", "title", "description")), "|").alias("skills"))


@query("x7_canonical_skill", r"""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'PostgreSQL' WHEN 1 THEN 'JavaScript' WHEN 2 THEN 'React' WHEN 3 THEN 'REST API' WHEN 4 THEN 'Node.js' ELSE 'Cobol' END AS skill FROM events""")
def x7(t):
    raw = F.expr("CASE event_id % 6 WHEN 0 THEN ' postgres ' WHEN 1 THEN 'js' WHEN 2 THEN 'ReactJS' WHEN 3 THEN 'restful apis' WHEN 4 THEN 'node' ELSE ' Cobol' END")
    return t.events.select("event_id", S.canonical_skill(raw).alias("skill"))


@query("x8_numeric_score", r"""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 50 WHEN 1 THEN 50 WHEN 2 THEN 0 ELSE least(100, CAST(floor(value) AS INTEGER)) END AS score FROM events""")
def x8(t):
    raw = F.expr("CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'invalid' WHEN 2 THEN concat('-', abs(value) + 1) ELSE concat(' ', value, ' ') END")
    return t.events.select("event_id", V.numeric_score(raw).alias("score"))


@query("x9_iso_ts", r"""
SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 2 THEN strftime(ts - INTERVAL 5 HOUR - INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed FROM events""")
def x9(t):
    raw = F.expr("""CASE event_id % 4 WHEN 0 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'") WHEN 1 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
                    WHEN 2 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+05:30'") ELSE 'Posted 30+ Days Ago' END""")
    return t.events.select("event_id", ts(V.iso_ts(raw)).alias("parsed"))


@query("x10_time_differences", r"""
SELECT l_orderkey AS k, l_linenumber AS n, round(date_diff('second', l_shipdate, TIMESTAMP '1998-01-01 12:00:00') / 3600.0, 6) AS hours,
  round(date_diff('second', l_shipdate, TIMESTAMP '1998-01-01 12:00:00') / 86400.0, 6) AS days,
  CAST(floor(date_diff('second', l_shipdate, TIMESTAMP '1998-01-01 12:00:00') / 86400.0) AS BIGINT) AS whole_days FROM lineitem""")
def x10(t):
    b = F.lit("1998-01-01 12:00:00").cast("timestamp")
    return t.lineitem.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"),
        F.round(V.hours_between("l_shipdate", b), 6).alias("hours"), F.round(V.days_between("l_shipdate", b), 6).alias("days"),
        V.whole_days_between("l_shipdate", b).alias("whole_days"))


@query("x11_month_day_keys", r"""
SELECT event_id, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day, CAST(day(last_day(ts)) AS INTEGER) AS days_in_month FROM events""")
def x11(t):
    return t.events.select("event_id", V.month_key("ts").alias("month"), V.day_key("ts").alias("day"),
                           F.dayofmonth(F.last_day("ts")).alias("days_in_month"))


@query("x12_quota_day", r"""
SELECT event_id, strftime(ts - INTERVAL 8 HOUR, '%Y-%m-%d') AS quota_day FROM events""")
def x12(t):
    return t.events.select("event_id", V.quota_day("ts").alias("quota_day"))


@query("x13_cycle_seed", r"SELECT event_id, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS seed FROM events")
def x13(t):
    return t.events.select("event_id", V.cycle_seed("ts").alias("seed"))


@query("x14_html_to_text", r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&mdash;', '—'), '&amp;', '&') AS h FROM a)
SELECT page_id, length(x) AS n_chars, md5(x) AS digest FROM (SELECT page_id, trim(regexp_replace(h, '\s+', ' ', 'g')) AS x FROM b)""")
def x14(t):
    h = T.html_to_text("html")
    return t.pages.select("page_id", F.length(h).cast("long").alias("n_chars"), F.md5(h).alias("digest"))


@query("x16_first_non_empty", r"""
SELECT native_id, CASE WHEN location <> '' THEN location ELSE company END AS first_value FROM postings""", "postings")
def x16(t):
    return t.postings.select("native_id", T.first_non_empty(F.lit(None).cast("string"), F.lit("  "), "location", "company").alias("first_value"))


@query("x17_json_path", r"""
SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS missing FROM events""")
def x17(t):
    return t.events.select("event_id", V.json_path("props", "$.k").alias("k"),
                           V.json_path("props", "$.no.such.step").alias("missing"))


@query("x18_map_merge", r"""
SELECT native_id, CASE WHEN source = 'web' THEN 'web=2' ELSE source || '=1,web=2' END AS merged FROM postings""", "postings")
def x18(t):
    m = V.map_merge(F.create_map("source", F.lit(1)), F.create_map(F.lit("web"), F.lit(2)))
    return t.postings.select("native_id", F.array_join(F.transform(
        F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("merged"))


@query("x18_map_sum", r"""
SELECT native_id, CASE WHEN source = 'web' THEN 'web=' || (1 + native_id % 3) ELSE source || '=1,web=' || native_id % 3 END AS merged FROM postings""", "postings")
def x18b(t):
    m = V.map_sum(F.create_map("source", F.lit(1)), F.create_map(F.lit("web"), (F.col("native_id") % 3).cast("int")))
    return t.postings.select("native_id", F.array_join(F.transform(F.array_sort(
        F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("merged"))


@query("x19_version_hash", r"SELECT doc_id, substr(sha256(text), 1, 16) AS version FROM documents")
def x19(t):
    return t.documents.select("doc_id", T.version_hash("text").alias("version"))
