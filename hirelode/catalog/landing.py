"""Queries over sources S*: payloads are written from the postings and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import files as FI
from ..sources import json_api as J
from ..sources import markup as M
from .base import query

VALID = "title <> 'Webinar on Cloud'"
PLACE = "CASE WHEN location = '' THEN 'India' ELSE location END"


def payloads(t, fields: str, wrap="{}"):
    """A payload for each posting: ``fields`` builds its item, ``wrap`` the JSON around the list.

    Ninety neighbouring keys hold no company twice (keys are dense, companies repeat after 400 groups), so
    payloads by company and page always had one item; built in place, no description is shuffled for it.
    """
    items = t.postings.select("company", F.to_json(F.array(F.expr(f"named_struct({fields})"))).alias("items"))
    head, tail = wrap.split("{}", 1)
    return items.select("company", F.lower("company").alias("company_id"), F.lit("https://careers.example.com/all/").alias("career_url"),
                        F.concat(F.lit(head), "items", F.lit(tail)).alias("body"),
                        F.lit("wd.example.com").alias("host"), F.lit("Ext").alias("site"), F.lit("https://th.example.com").alias("origin"))


def markup_pages(t, card: str, head: str = "<html><body>", tail: str = "</body></html>"):
    items = t.postings.select("company", F.floor(F.col("native_id") / 90).alias("page"), "native_id", F.expr(card).alias("item"))
    pages = items.groupBy("company", "page").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("native_id", "item"))), lambda x: x["item"]), "\n").alias("items"))
    return pages.select("company", F.lower("company").alias("company_id"), F.lit("https://careers.example.com/all").alias("career_url"),
                        F.concat("company", F.lit("-"), F.col("page").cast("string")).alias("page_id"),
                        F.concat(F.lit(head), "items", F.lit(tail)).alias("body"))


ID = "'id', cast(native_id AS string)"


def view(df, *extra):
    return df.select("source_id", "company", "title", "location", "url", *extra)


EXPECT = f"SELECT CAST(native_id AS VARCHAR) AS source_id, company, title, {PLACE} AS location, url FROM postings WHERE {VALID}"
EXPECT_DATE = EXPECT.replace(" FROM", ", strftime(posted_date, '%Y-%m-%d') AS posted_date FROM")
DAY = "date_format(posted_date, 'yyyy-MM-dd')"


@query("s1_read_store", "SELECT id, title, CAST(score AS DOUBLE) AS score, source FROM pid", "pid")
def s1(t):
    path = scratch_path(t.spark, "store")
    t.normalized.select("id", "title", "source", F.struct(F.col("score").cast("double").alias("score")).alias("match"), F.floor(F.col("native_id") / 500).alias("f")) \
        .groupBy("f").agg(F.collect_list(F.struct("id", "title", "source", "match")).alias("jobs")).write.partitionBy("f").json(path)
    return FI.read_store(t.spark, f"{path}/*/*.json").select("id", "title", "match.score", "source")


@query("s2_read_companies_csv", "SELECT trim(name) AS name, career_url, CASE WHEN company_id % 4 = 3 THEN 'custom' ELSE ats END AS ats_hint FROM companies", "companies")
def s2(t):
    path = scratch_path(t.spark, "csv")
    t.companies.select(F.concat(F.lit(" "), "name").alias("Company"), F.col("career_url").alias("url"), F.when(F.col("company_id") % 4 != 3, F.col("ats")).alias("ats")) \
        .write.option("header", True).csv(path)
    return FI.read_companies_csv(t.spark, path)


@query("s3_read_companies_json", "SELECT name, career_url, CASE WHEN company_id % 2 = 0 THEN ats ELSE 'custom' END AS ats_hint FROM companies", "companies")
def s3(t):
    each = t.companies.withColumn("doc", F.to_json(F.array(F.struct("name", "career_url", F.when(F.col("company_id") % 2 == 0, F.col("ats")).alias("ats_hint")))))
    body = F.when(F.col("company_id") % 3 == 0, F.concat(F.lit('{"companies":'), "doc", F.lit("}"))).otherwise(F.col("doc"))
    return FI.parse_companies_json(each.select(body.alias("body")))


@query("s4_normalize_greenhouse", EXPECT_DATE, "postings")
def s4(t):
    raw = payloads(t, f"{ID}, 'title', title, 'location', named_struct('name', location), 'absolute_url', url, 'content', concat('<p>', description, '</p>'), 'updated_at', {DAY}", '{"jobs":{}}')
    return view(J.normalize_greenhouse(raw), "posted_date")


@query("s5_normalize_lever", EXPECT.replace(" FROM", ", 'About ' || title || chr(10) || chr(10) || 'Skills:' || chr(10) || source AS description FROM"), "postings")
def s5(t):
    raw = payloads(t, f"{ID}, 'text', title, 'categories', named_struct('location', location), 'hostedUrl', url, 'descriptionPlain', concat('About ', title), 'lists', array(named_struct('text', 'Skills', 'content', source))")
    return view(J.normalize_lever(raw), "description")


@query("s6_normalize_ashby", EXPECT_DATE, "postings")
def s6(t):
    raw = payloads(t, f"{ID}, 'title', title, 'locationName', location, 'jobUrl', url, 'descriptionHtml', description, 'publishedAt', {DAY}", '{"jobs":{}}')
    return view(J.normalize_ashby(raw), "posted_date")


@query("s7_normalize_smartrecruiters", f"""
SELECT CAST(native_id AS VARCHAR) AS source_id, company, title, {PLACE} AS location, 'https://jobs.smartrecruiters.com/' || lower(company) || '/' || native_id AS url,
 CASE WHEN native_id % 2 = 0 THEN 'We are ' || company || ' Role ' || title ELSE 'SmartRecruiters posting: ' || title END AS description FROM postings WHERE {VALID}""", "postings")
def s7(t):
    raw = payloads(t, f"{ID}, 'name', title, 'location', named_struct('city', location), 'releasedDate', {DAY}", '{"content":{}}')
    details = t.postings.where("native_id % 2 = 0").select(F.col("native_id").cast("string").alias("posting_id"), F.to_json(F.expr(
        "named_struct('jobAd', named_struct('sections', named_struct('companyDescription', named_struct('text', concat('<b>We are</b> ', company)), 'jobDescription', named_struct('text', concat('Role ', title)))))")).alias("body"))
    return view(J.normalize_smartrecruiters(raw, details), "description")


@query("s8_normalize_workday", f"""
SELECT '/job/' || native_id AS source_id, company, title, {PLACE} AS location, 'https://wd.example.com/en-US/Ext/job/' || native_id AS url,
 CASE WHEN native_id % 2 = 0 THEN 'Work on ' || source ELSE 'Workday job posting: ' || title || ' (' || {PLACE} || ')' END AS description FROM postings WHERE {VALID}""", "postings")
def s8(t):
    raw = payloads(t, "'title', title, 'locationsText', location, 'externalPath', concat('/job/', native_id), 'postedOn', 'Posted 30+ Days Ago'", '{"jobPostings":{}}')
    details = t.postings.where("native_id % 2 = 0").select(F.expr("concat('/job/', native_id)").alias("external_path"),
                                                           F.to_json(F.expr("named_struct('jobDescription', concat('<p>Work on</p>', source))")).alias("body"))
    return view(J.normalize_workday(raw, details), "description")


@query("s9_normalize_oraclehcm", f"""
SELECT CAST(native_id AS VARCHAR) AS source_id, company, title, {PLACE} AS location, 'https://wd.example.com/hcmUI/CandidateExperience/en/sites/Ext/job/' || native_id AS url,
 'Short. Department: ' || source || '.' AS description FROM postings WHERE {VALID}""", "postings")
def s9(t):
    raw = payloads(t, "'Id', cast(native_id AS string), 'Title', title, 'PrimaryLocation', location, 'ShortDescriptionStr', 'Short.', 'Department', source", '{"items":[{"requisitionList":{}},{"x":1}]}')
    return view(J.normalize_oraclehcm(raw), "description")


@query("s10_normalize_turbohire", f"""
SELECT CAST(native_id AS VARCHAR) AS source_id, company, title, CASE WHEN native_id % 2 = 0 THEN {PLACE} ELSE 'A, B, C, D' END AS location, 'https://th.example.com/careerpage/jobdetails/' || native_id AS url,
 title || ' at ' || company || '. Department: ' || source || '.' AS description FROM postings WHERE {VALID}""", "postings")
def s10(t):
    raw = payloads(t, """'JobIdObfuscated', cast(native_id AS string), 'JobTitle', title, 'Department', source, 'Location',
      CASE WHEN native_id % 2 = 0 THEN location ELSE '[{"Address":"A"},{"Address":""},{"Address":"B"},{"Address":"C"},{"Address":"D"}]' END""", '{"Result":{}}')
    return view(J.normalize_turbohire(raw), "description")


@query("s11_normalize_keka", f"""
SELECT CAST(native_id AS VARCHAR) AS source_id, company, title, CASE WHEN location = '' THEN 'Pune' ELSE location || ', Pune' END AS location, 'https://careers.example.com/all/' || native_id || '/' AS url,
 'Build it Experience: 0-1 Skills: Python, SQL' AS description FROM postings WHERE {VALID}""", "postings")
def s11(t):
    raw = payloads(t, f"""{ID}, 'title', title, 'places', location, 'description', '<p>Build it</p>', 'experience', '0-1', 'skillNames', array('Python', 'SQL')""")
    mixed = F.regexp_replace("body", r'"places":"([^"]*)"', r'"jobLocations":[{"city":"$1"},"Pune"]')
    both = F.when(F.hash("company") % 2 == 0, F.concat(F.lit('{"data":'), mixed, F.lit("}"))).otherwise(mixed)
    return view(J.normalize_keka(raw.withColumn("body", both)), "description")


@query("s12_normalize_successfactors", f"""
SELECT '/job/' || native_id AS source_id, company, title, {PLACE} AS location, 'https://sf.example.com/job/' || native_id AS url FROM postings WHERE {VALID}""", "postings")
def s12(t):
    card = """concat('<tr><td><a href="x" class="other">no</a><a class="jobTitle-link" href="/job/', native_id, '">', title, '</a><a class="jobTitle-link" href="/job/', native_id, '">', title,
      '</a></td><td><span class="jobLocation">', CASE WHEN location = '' THEN 'India' ELSE location END, '</span></td></tr>')"""
    raw = markup_pages(t, card, '<th class="jobLocation header">Location</th>').withColumn("base", F.lit("https://sf.example.com"))
    return view(M.normalize_successfactors(raw))


@query("s13_extract_json_ld", f"SELECT company, title, {PLACE} AS location, url, strftime(posted_date, '%Y-%m-%d') AS posted_date FROM postings WHERE {VALID}", "postings")
def s13(t):
    raw = payloads(t, f"'@type', 'JobPosting', 'title', title, 'url', url, 'description', description, 'datePosted', {DAY}, 'jobLocation', named_struct('address', named_struct('addressLocality', location))")
    doc = F.when(F.hash("body") % 2 == 0, F.concat(F.lit('{"@graph":'), "body", F.lit("}"))).otherwise(F.col("body"))
    safe = F.replace(doc, F.lit("</"), F.lit("<\\/"))
    pages = raw.withColumn("body", F.concat(F.lit('<html><script type="application/ld+json">'), safe, F.lit("</script></html>")))
    return M.extract_json_ld(pages).select("company", "title", "location", "url", "posted_date")


CARD = """concat('<div class="job-card"><h3>', title, '</h3><span class="loc">', location, '</span><a href="/job/', native_id, '">Apply</a></div>')"""
CARD_EXPECT = f"SELECT company, title, {{place}} AS location, 'https://careers.example.com/job/' || native_id AS url FROM postings WHERE {VALID}"


@query("s14_extract_with_patterns", CARD_EXPECT.replace("{place}", "CASE WHEN location = '' THEN 'Unknown' ELSE location END"), "postings")
def s14(t):
    pages = markup_pages(t, CARD)
    patterns = t.postings.select(F.lower("company").alias("company_id"), F.lit("div.job-card").alias("job_card_selector"), F.lit("h3").alias("title_selector"),
                                 F.lit("[class*='loc']").alias("location_selector"), F.lit("a").alias("apply_link_selector")).distinct()
    return M.extract_with_patterns(pages, patterns).select("company", "title", "location", "url")


@query("s15_extract_cards_heuristic", CARD_EXPECT.replace("{place}", PLACE), "postings")
def s15(t):
    decoy = F.concat(F.lit('<div class="opening"><h2>About us</h2></div>'), "body")
    return M.extract_cards_heuristic(markup_pages(t, CARD).withColumn("body", decoy)).select("company", "title", "location", "url")


@query("s16_extract_anchor_jobs", r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref="[^"]*"[^>]*>(.*?)</a>', 1)) AS x FROM (SELECT page_id, html || '<p><a href="/j/1">Lead Analyst</a><a href="/j/2">Data  Engineer</a><a href="/j/3">Lead Analyst</a><a href="/k">leadership</a></p>' AS html FROM pages))
SELECT DISTINCT page_id, trim(regexp_replace(x, '\s+', ' ', 'g')) AS title FROM a WHERE regexp_matches(x, '(?i)(^|[^\pL\pN_])(engineer|developer|intern|manager|analyst|designer|consultant|associate|specialist|lead|architect|sde|swe)($|[^\pL\pN_])') AND length(trim(x)) BETWEEN 4 AND 100""")
def s16(t):
    pages = t.pages.withColumn("html", F.concat("html", F.lit('<p><a href="/j/1">Lead Analyst</a><a href="/j/2">Data  Engineer</a><a href="/j/3">Lead Analyst</a><a href="/k">leadership</a></p>')))
    return M.extract_anchor_jobs(pages).select("page_id", "title")


@query("s17_discover_ats_tokens", r"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'g' || page_id WHEN 1 THEN 'emb' || page_id END AS greenhouse, CASE WHEN page_id % 4 = 2 THEN 'l-' || page_id END AS lever, CAST(NULL AS VARCHAR) AS ashby FROM pages""")
def s17(t):
    link = F.expr("""CASE page_id % 4 WHEN 0 THEN concat('<a href="https://boards.greenhouse.io/g', page_id, '">') WHEN 1 THEN concat('<iframe src="https://boards.greenhouse.io/embed/job_board?for=emb', page_id, '">')
                     WHEN 2 THEN concat('<a href="https://jobs.lever.co/l-', page_id, '/x">') ELSE '' END""")
    return M.discover_ats_tokens(t.pages.withColumn("html", F.concat("html", link))).select("page_id", "greenhouse", "lever", "ashby")


@query("s18_classify_ats", """
SELECT company_id, CASE company_id % 5 WHEN 0 THEN 'workday' WHEN 1 THEN 'lever' END AS detected_ats, CASE WHEN company_id % 5 <= 2 OR ats <> 'custom' THEN 'api' ELSE 'browser' END AS lane FROM companies""", "companies")
def s18(t):
    url = F.expr("CASE company_id % 5 WHEN 0 THEN 'https://x.wd1.myworkdayjobs.com/Ext' WHEN 1 THEN 'https://jobs.lever.co/x' WHEN 2 THEN 'https://x.keka.com/careers' ELSE career_url END")
    return M.classify_ats(t.companies.withColumn("career_url", url)).select("company_id", "detected_ats", "lane")


@query("s19_board_token", """
SELECT company_id, CASE company_id % 4 WHEN 0 THEN 'tok' || company_id WHEN 1 THEN 'acme' || company_id ELSE 'firm' || company_id END AS token FROM companies""", "companies")
def s19(t):
    url = F.expr("""CASE company_id % 4 WHEN 0 THEN concat('https://boards.greenhouse.io/embed/job_board?for=tok', company_id, '&b=1') WHEN 1 THEN concat('https://jobs.lever.co/careers/acme', company_id, '/')
                    WHEN 2 THEN 'https://x.example.com/careers/jobs' ELSE 'https://x.example.com/' END""")
    return t.companies.select("company_id", M.board_token(url, F.expr("concat('Firm', company_id, '-india')")).alias("token"))


@query("s20_normalize_adzuna", EXPECT.replace(" FROM", ", CASE WHEN native_id % 2 = 0 THEN 'INR 600,000 - 1,500,000' ELSE 'unspecified' END AS salary_text FROM"), "postings")
def s20(t):
    raw = payloads(t, f"{ID}, 'title', title, 'redirect_url', url, 'company', named_struct('display_name', company), 'location', named_struct('display_name', location), 'description', description, "
                   f"'salary_min', 600000.7D, 'salary_max', CASE WHEN native_id % 2 = 0 THEN 1500000D END, 'created', {DAY}", '{"results":{}}')
    return view(J.normalize_adzuna(raw), "salary_text")


@query("s21_normalize_jooble", EXPECT_DATE, "postings")
def s21(t):
    raw = payloads(t, f"{ID}, 'title', title, 'link', url, 'company', company, 'location', location, 'snippet', description, 'updated', {DAY}", '{"jobs":{}}')
    return view(J.normalize_jooble(raw), "posted_date")


REMOTE_EXPECT = f"SELECT CAST(native_id AS VARCHAR) AS source_id, company, title, CASE WHEN location = '' THEN 'Remote' ELSE location END AS location, url FROM postings WHERE {VALID} AND location IN ('', 'Remote', 'Gurgaon, India')"


@query("s22_normalize_remoteok", REMOTE_EXPECT, "postings")
def s22(t):
    raw = payloads(t, f"{ID}, 'position', title, 'url', url, 'company', company, 'location', location, 'tags', array('a'), 'description', description, 'date', {DAY}", '[{"legal":"notice"},{}]')
    body = F.regexp_replace("body", r'^(\[\{"legal":"notice"\},)\[', "$1")
    return view(J.normalize_remoteok(raw.withColumn("body", F.regexp_replace(body, r"\]\]$", "]"))))


@query("s23_normalize_remotive", REMOTE_EXPECT, "postings")
def s23(t):
    raw = payloads(t, f"{ID}, 'title', title, 'url', url, 'company_name', company, 'candidate_required_location', location, 'tags', array('a'), 'description', description, 'publication_date', {DAY}", '{"jobs":{}}')
    return view(J.normalize_remotive(raw))


@query("s24_normalize_indeed", EXPECT, "postings")
def s24(t):
    raw = payloads(t, "'jobkey', cast(native_id AS string), 'jobtitle', title, 'company', company, 'formattedLocation', location, 'url', url, 'snippet', description", '{"results":{}}')
    return view(J.normalize_indeed(raw))


def rss_pages(t):
    card = """concat('<item><guid>', native_id, '</guid><title>', title, CASE native_id % 2 WHEN 0 THEN ' - ' ELSE ' at ' END, company, '</title><link>', replace(url, '&', '&amp;'), '</link><description>x</description></item>')"""
    return markup_pages(t, card, '<rss><channel>', '</channel></rss>')


# titles with a dash of their own: the role is what stands before the first dash, the company what stands between the first two
RSS_SQL = f"""SELECT CAST(native_id AS VARCHAR) AS source_id, CASE WHEN title NOT LIKE 'Full Stack%' THEN company WHEN native_id % 2 = 0 THEN 'Fresher' ELSE 'Fresher at ' || company END AS company,
 CASE WHEN title LIKE 'Full Stack%' THEN 'Full Stack Developer' ELSE title END AS title, 'India' AS location FROM postings WHERE {VALID}"""


@query("s25_normalize_rss", RSS_SQL, "postings")
@query("s25_normalize_rss_whole", RSS_SQL, "postings")
def s25(t):
    return M.normalize_rss(rss_pages(t)).select("source_id", "company", "title", "location")


@query("s26_normalize_naukri_actor", EXPECT.replace(" FROM", ", strftime(posted_date + CASE WHEN native_id % 2 = 0 THEN INTERVAL 1000000000 SECOND ELSE INTERVAL 0 SECOND END, '%Y-%m-%d %H:%M:%S') AS posted_date FROM"), "postings")
def s26(t):
    raw = payloads(t, "'jobId', cast(native_id AS string), 'title', title, 'jdURL', url, 'companyName', company, 'placeholders', named_struct('location', location), 'jobDescription', description, 'tagsAndSkills', 'sql', "
                   "'createdDate', CASE native_id % 2 WHEN 0 THEN cast(unix_millis(posted_date) + 1000000000000 AS string) ELSE date_format(posted_date, 'yyyy-MM-dd HH:mm:ss') END")
    # epoch milliseconds arrive as a number
    number = F.regexp_replace("body", r'"createdDate":"(\d{13,})"', r'"createdDate":$1')
    return view(J.normalize_naukri_actor(raw.withColumn("body", number)), "posted_date")


@query("s27_normalize_jobspy", EXPECT.replace(", url FROM", ", url || '&jk=' || native_id AS url, strftime(posted_date, '%Y-%m-%dT00:00:00+00:00') AS posted_date FROM"), "postings")
def s27(t):
    rows = t.postings.select("title", F.expr("concat(url, '&jk=', native_id)").alias("job_url"), "company", "location", "description", F.expr(DAY).alias("date_posted"))
    return view(J.normalize_jobspy(rows), "posted_date")


@query("s28_normalize_cutshort", EXPECT.replace(" FROM", ", '0-2 years' AS experience_text FROM"), "postings")
def s28(t):
    raw = payloads(t, "'_id', cast(native_id AS string), 'headline', title, 'publicUrl', url, 'companyDetails', named_struct('name', company), 'locations', CASE WHEN location = '' THEN array() ELSE array(location) END, 'allSkills', array('SQL'), 'expRange', named_struct('min', 0, 'max', 2)",
                   '<html><script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"dehydratedState":{"queries":[{"queryKey":["other"]},{"queryKey":["jobListData","x"],"state":{"data":{"data":{"pageData":{"jobs":{}}}}}}]}}}}</script></html>')
    return view(M.normalize_cutshort(raw), "experience_text")


@query("s29_normalize_shine", f"""SELECT CAST(native_id AS VARCHAR) AS source_id, company, title, {PLACE} AS location,
 'https://www.shine.com/jobs/' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') || '/' || replace(lower(company), ' ', '-') || '/' || native_id AS url FROM postings WHERE {VALID}""", "postings")
def s29(t):
    raw = payloads(t, f"{ID}, 'jJT', title, 'jCName', company, 'jLoc', array(location), 'jExp', '0 to 3 Yrs'",
                   '<script id="__NEXT_DATA__" type="application/json">{"props":{"pageProps":{"initialState":{"jsrp":{"searchresult":{"data":{"results":{}}}}}}}}</script>')
    return view(M.normalize_shine(raw))


@query("s30_normalize_internshala", f"""SELECT CAST(native_id AS VARCHAR) AS source_id, company, CASE WHEN title LIKE '%Intern' THEN title ELSE title || ' Intern' END AS title, {PLACE} AS location,
 'https://internshala.com/internship/' || native_id AS url FROM postings WHERE {VALID}""", "postings")
def s30(t):
    card = """concat('<div class="individual_internship x" internshipid="', native_id, '" data-href="/internship/', native_id, '"><h2><a href="#">', title, '</a></h2><p class="company-name"> ', company, ' </p>',
      CASE WHEN location = '' THEN '' ELSE concat('<div class="locations"><span>', location, '</span></div>') END, '<span class="stipend">10,000</span></div>')"""
    return view(M.normalize_internshala(markup_pages(t, card)))


@query("s31_normalize_freshersworld", f"""SELECT CAST(native_id AS VARCHAR) AS source_id, company, title, {PLACE} AS location, 'https://www.freshersworld.com/jobs/' || native_id AS url,
 '0 - 2 Years' AS experience_text, 'Rs. 3 - 5 LPA' AS salary_text FROM postings WHERE {VALID}""", "postings")
def s31(t):
    card = """concat('<div class="job-container"><span class="job-new-title">', title, ' Jobs Opening in ', company, ' at ', CASE WHEN location = '' THEN 'India' ELSE location END, ' More</span><a href="/jobs/', native_id, '">view</a><span>0 - 2 Years</span><span>Rs. 3 - 5 LPA</span></div>')"""
    return view(M.normalize_freshersworld(markup_pages(t, card)), "experience_text", "salary_text")


@query("s32_normalize_linkedin", f"""SELECT 'urn:' || native_id AS source_id, company, title, {PLACE} AS location, 'https://www.linkedin.com/jobs/view/' || native_id AS url, strftime(posted_date, '%Y-%m-%d') AS posted_date FROM postings WHERE {VALID}""", "postings")
def s32(t):
    card = f"""concat('<li><div class="base-card base-search-card" data-entity-urn="urn:', native_id, '"><a class="base-card__full-link" href="https://www.linkedin.com/jobs/view/', native_id, '?trk=x"></a><h3 class="base-search-card__title">',
      title, '</h3><h4 class="base-search-card__subtitle">', company, '</h4>', CASE WHEN location = '' THEN '' ELSE concat('<span class="job-search-card__location">', location, '</span>') END, '<time datetime="', {DAY}, '">1 day</time></div></li>')"""
    return view(M.normalize_linkedin(markup_pages(t, card)), "posted_date")


@query("s33_import_posting_page", r"""
WITH h AS (SELECT page_id, regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1) AS h1 FROM pages),
c AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(h1, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM h)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Data Engineer' ELSE t END AS title, CASE WHEN page_id % 3 = 0 THEN 'Acme Corp' ELSE 'LinkedIn Poster' END AS company FROM c WHERE page_id % 3 = 0 OR t <> ''""")
def s33(t):
    og = F.when(F.col("page_id") % 3 == 0, F.lit('<meta property="og:title" content="Data Engineer hiring in Pune | LinkedIn"><meta property="og:description" content="Acme Corp hiring Data Engineer: apply">')).otherwise(F.lit(""))
    return M.import_posting_page(t.pages.withColumn("html", F.concat(og, "html"))).select("page_id", "title", "company")


# pages without a heading have their page title, and without both the last part of their URL
@query("s33_import_posting_page_fallbacks", """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Page ' || page_id WHEN 1 THEN 'Data Engineer' ELSE 'Software Engineer (LinkedIn Import)' END AS title, 'LinkedIn Poster' AS company FROM pages""")
def s33_fallbacks(t):
    bare = F.regexp_replace("html", r"(?is)<(h1|title)\b[^>]*>.*?</\1>", "")
    title = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<title>Page "), F.col("page_id").cast("string"), F.lit(" | LinkedIn</title>"))).otherwise(F.lit(""))
    url = F.when(F.col("page_id") % 3 == 1, F.lit("https://x.example.com/jobs/data-engineer/?trk=1")).otherwise(F.lit("https://x.example.com/jobs/123/"))
    return M.import_posting_page(t.pages.withColumns({"html": F.concat(title, bare), "url": url})).select("page_id", "title", "company")


@query("s34_extract_detail_description", r"""
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN repeat('Good job text. ', 9) || 'End' END AS description FROM pages""")
def s34(t):
    block = F.when(F.col("page_id") % 2 == 0, F.lit('<div class="show-more-less-html__markup x">' + "Good <b>job</b>  text. " * 9 + "End</div>")) \
        .otherwise(F.lit('<div class="show-more-less-html__markup">short</div>'))
    return M.extract_detail_description(t.pages.withColumn("html", F.concat("html", block))).select("page_id", "description")


@query("s35_probe_summary", """SELECT ncompany AS name, source AS ats, count(*) AS total_jobs,
  count(*) FILTER (nlocation IN ('bangalore', 'gurugram', 'noida', 'mumbai')) AS india_jobs, count(*) FILTER (ntitle LIKE '%intern' OR ntitle LIKE '%fresher') AS fresher_jobs,
  count(*) FILTER ((ntitle LIKE '%intern' OR ntitle LIKE '%fresher') AND nlocation IN ('bangalore', 'gurugram', 'noida', 'mumbai')) AS fresher_india_jobs FROM pid GROUP BY 1, 2""", "pid")
def s35(t):
    from .filtering import probes
    return probes(t)


@query("s36_parse_scored_reply", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(least(98, greatest(40, event_id % 120)) AS INTEGER) WHEN 1 THEN CAST(least(98, greatest(40, event_id % 120)) AS INTEGER) WHEN 2 THEN 65 ELSE 65 END AS score,
 CASE WHEN event_id % 4 <= 1 THEN 'SQL' ELSE '' END AS skills FROM events""")
def s36(t):
    obj = """concat('{"score": ', event_id % 120, ', "matched_skills": ["SQL"], "reasoning": "fine {ok}"}')"""
    reply = F.expr(f"""CASE event_id % 4 WHEN 0 THEN concat('```json\\n', {obj}, '\\n```') WHEN 1 THEN concat('Here you go: ', {obj}, ' Thanks') WHEN 2 THEN 'no json here' ELSE '{{"reasoning": "no score"}}' END""")
    return J.parse_scored_reply(t.events.withColumn("reply", reply)).select("event_id", "score", F.array_join("matched_skills", "|").alias("skills"))


@query("s37_source_health", """
SELECT event_type AS source, user_id AS run_id, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS jobs_count,
 CASE WHEN max(CASE WHEN event_id % 200 = 1 THEN 'timeout' END) IS NOT NULL THEN 'timeout' WHEN max(200 + CASE WHEN event_id % 50 = 0 THEN 229 ELSE 0 END) = 429 THEN 'quota_exhausted'
  WHEN sum(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END) > 0 THEN 'success' ELSE 'zero_results' END AS status FROM events GROUP BY 1, 2""")
def s37(t):
    log = t.events.select(F.col("event_type").alias("source"), F.col("user_id").alias("run_id"), F.when(F.col("event_id") % 50 == 0, 429).otherwise(200).alias("http_status"),
                          F.when(F.col("event_id") % 3 == 0, 0).otherwise(1).alias("jobs_count"), F.when(F.col("event_id") % 200 == 1, F.lit("Read timeout")).alias("error"))
    return J.source_health(log).select("source", "run_id", "jobs_count", "status")


@query("s38_load_filter_terms", """
SELECT kind, grp AS "group", term, n FROM (SELECT 'target_role' AS kind, 'Role' AS grp, title AS term, count(*) AS n FROM postings GROUP BY 3
 UNION ALL SELECT 'exclude_keywords', NULL, source, count(*) FROM postings GROUP BY 3 UNION ALL SELECT 'target_experience', NULL, '0 years', count(*) FROM postings)""", "postings")
def s38(t):
    body = F.expr("""concat('{"target_role": [{"id": "t", "category_groups": [{"group_name": "Role", "values": ["', title, '"]}]}], "exclude_keywords": ["', source, '", " "], "target_experience": "0 years"}')""")
    return FI.parse_filter_terms(t.postings.select(body.alias("body"))).groupBy("kind", "group", "term").agg(F.count(F.lit(1)).alias("n"))


@query("s39_profile_of", r"""
WITH d AS (SELECT doc_id, text || ' Worked with ' || CASE doc_id % 3 WHEN 0 THEN 'Python, Docker' WHEN 1 THEN 'Agile Scrum' ELSE 'node.js' END || ' for ' || doc_id % 50 || '+ years of experience' AS x FROM documents),
y AS (SELECT doc_id, x, list_filter(list_transform(regexp_extract_all(x, '(?i)(\d+)\+?\s*(?:years?|yrs?)', 1), lambda v: TRY_CAST(v AS INTEGER)), lambda v: v <= 40) AS ys FROM d)
SELECT doc_id, list_max(ys) AS years, regexp_matches(upper(x), '(^|[^\pL\pN_])PYTHON($|[^\pL\pN_])') AS python, regexp_matches(upper(x), '(^|[^\pL\pN_])SCRUM($|[^\pL\pN_])') AS scrum FROM y""")
def s39(t):
    text = F.expr("""concat(text, ' Worked with ', CASE doc_id % 3 WHEN 0 THEN 'Python, Docker' WHEN 1 THEN 'Agile Scrum' ELSE 'node.js' END, ' for ', doc_id % 50, '+ years of experience')""")
    p = FI.profile_of(t.documents.withColumn("raw", text), "raw")
    return p.select("doc_id", "years", F.array_contains("skills", "Python").alias("python"), F.array_contains("skills", "Scrum").alias("scrum"))
