"""Board APIs that answer in JSON: payload tables to postings.

A payload table has company, company_id, career_url and body; every operator
parses the body with an explicit schema, unnests it and keeps valid postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as V
from ..functions import text as T
from .common import as_postings


def _items(raw: DataFrame, schema: str, items) -> DataFrame:
    """One row per posting in the payload; a payload that does not parse has none."""
    parsed = raw.withColumn("__p", F.from_json("body", schema))
    return parsed.withColumn("j", F.explode(items(F.col("__p")))).drop("__p", "body")


def _or(col, fallback) -> Column:
    return F.coalesce(T.blank_to_null(col), fallback if isinstance(fallback, Column) else F.lit(fallback))


def _text_or(html: str, vendor: str, title: str) -> Column:
    return _or(T.html_to_text(html), F.concat(F.lit(f"{vendor} posting: "), title))


def normalize_greenhouse(raw: DataFrame) -> DataFrame:
    """S4"""
    j = _items(raw, "jobs array<struct<id:string,title:string,location:struct<name:string>,absolute_url:string,content:string,updated_at:string>>",
               lambda p: p["jobs"])
    return as_postings(
        j, source_id=F.col("j.id"), company=F.col("company"), title=F.col("j.title"), location=_or("j.location.name", "India"),
        url=_or("j.absolute_url", F.col("career_url")), description=_text_or("j.content", "Greenhouse", "j.title"),
        posted_date=F.col("j.updated_at"), source=F.lit("greenhouse"), extraction_method=F.lit("greenhouse_api"))


def normalize_lever(raw: DataFrame) -> DataFrame:
    """The description with every list section after it."""
    j = _items(raw, "array<struct<id:string,text:string,categories:struct<location:string>,hostedUrl:string,descriptionPlain:string,"
               "description:string,lists:array<struct<text:string,content:string>>>>", lambda p: p)
    sections = F.array_join(F.transform(
        F.filter(F.coalesce("j.lists", F.array().cast("array<struct<text:string,content:string>>")),
                 lambda s: (F.coalesce(s["text"], F.lit("")) != "") | (F.coalesce(s["content"], F.lit("")) != "")),
        lambda s: F.concat(F.lit("\n\n"), F.coalesce(s["text"], F.lit("")), F.lit(":\n"), F.coalesce(s["content"], F.lit("")))), "")
    lead = F.coalesce(T.blank_to_null("j.descriptionPlain"), T.html_to_text("j.description"))
    return as_postings(
        j, source_id=F.col("j.id"), company=F.col("company"), title=F.col("j.text"), location=_or("j.categories.location", "India"),
        url=_or("j.hostedUrl", F.col("career_url")),
        description=_or(F.concat(lead, sections), F.concat(F.lit("Lever posting: "), "j.text")),
        source=F.lit("lever"), extraction_method=F.lit("lever_api"))


def normalize_ashby(raw: DataFrame) -> DataFrame:
    """S6"""
    j = _items(raw, "jobs array<struct<id:string,title:string,locationName:string,jobUrl:string,descriptionHtml:string,description:string,publishedAt:string>>",
               lambda p: p["jobs"])
    html = F.coalesce(F.nullif(F.col("j.descriptionHtml"), F.lit("")), F.col("j.description"))
    return as_postings(
        j, source_id=F.col("j.id"), company=F.col("company"), title=F.col("j.title"), location=_or("j.locationName", "India"),
        url=_or("j.jobUrl", F.col("career_url")), description=_text_or(html, "Ashby", "j.title"),
        posted_date=F.col("j.publishedAt"), source=F.lit("ashby"), extraction_method=F.lit("ashby_api"))


def normalize_smartrecruiters(list_raw: DataFrame, detail_raw: DataFrame) -> DataFrame:
    """Listed postings with their details. ``detail_raw``: posting_id, body."""
    j = _items(list_raw, "content array<struct<id:string,name:string,location:struct<city:string,country:string>,releasedDate:string>>",
               lambda p: p["content"])
    parts = ["companyDescription", "jobDescription", "qualifications", "additionalInformation"]
    sections = ",".join(f"{p}:struct<text:string>" for p in parts)
    detail = detail_raw.select("posting_id", F.from_json("body", f"jobAd struct<sections:struct<{sections}>>").alias("d"))
    text = F.concat_ws("\n\n", *[F.nullif(F.col(f"d.jobAd.sections.{p}.text"), F.lit("")) for p in parts])
    joined = j.withColumn("posting_id", F.col("j.id")).join(detail, "posting_id", "left")
    return as_postings(
        joined, source_id=F.col("j.id"), company=F.col("company"), title=F.col("j.name"),
        location=T.first_non_empty("j.location.city", "j.location.country", F.lit("India")),
        url=F.concat(F.lit("https://jobs.smartrecruiters.com/"), "company_id", F.lit("/"), "j.id"),
        description=_text_or(text, "SmartRecruiters", "j.name"), posted_date=F.col("j.releasedDate"),
        source=F.lit("smartrecruiters"), extraction_method=F.lit("smartrecruiters_api"))


def normalize_workday(list_raw: DataFrame, detail_raw: DataFrame) -> DataFrame:
    """``list_raw`` also has host and site; ``detail_raw``: external_path, body."""
    j = _items(list_raw, "jobPostings array<struct<title:string,locationsText:string,externalPath:string,postedOn:string>>",
               lambda p: p["jobPostings"])
    detail = detail_raw.select("external_path", F.from_json("body", "jobDescription string").alias("d"))
    joined = j.withColumn("external_path", F.col("j.externalPath")).join(detail, "external_path", "left")
    place = _or("j.locationsText", "India")
    return as_postings(
        joined, source_id=F.col("external_path"), company=F.col("company"), title=F.col("j.title"), location=place,
        url=F.concat(F.lit("https://"), "host", F.lit("/en-US/"), "site", F.coalesce("external_path", F.lit(""))),
        description=_or(T.html_to_text("d.jobDescription"), F.concat(
            F.lit("Workday job posting: "), "j.title", F.lit(" ("), place, F.lit(")"))),
        posted_date=F.col("j.postedOn"), source=F.lit("workday"), extraction_method=F.lit("workday_api"))


def _sentence(label: str, value) -> Column:
    v = T.blank_to_null(value)
    return F.when(v.isNotNull(), F.concat(F.lit(f"{label}: "), v, F.lit(".")))


def normalize_oraclehcm(raw: DataFrame) -> DataFrame:
    """Requisitions of every result item. ``raw`` also has host and site."""
    fields = "Id:string,Title:string,PrimaryLocation:string,ShortDescriptionStr:string,Department:string,JobFamily:string,PostedDate:string"
    j = _items(raw, f"items array<struct<requisitionList:array<struct<{fields}>>>>",
               lambda p: F.flatten(F.transform(p["items"], lambda x: F.coalesce(x["requisitionList"], F.array().cast(f"array<struct<{fields}>>")))))
    text = F.concat_ws(" ", T.blank_to_null("j.ShortDescriptionStr"), _sentence("Department", "j.Department"), _sentence("Job family", "j.JobFamily"))
    link = F.concat(F.lit("https://"), "host", F.lit("/hcmUI/CandidateExperience/en/sites/"), "site", F.lit("/job/"), F.nullif(F.col("j.Id"), F.lit("")))
    return as_postings(
        j, source_id=F.col("j.Id"), company=F.col("company"), title=T.strip("j.Title"), location=_or("j.PrimaryLocation", "India"),
        url=F.coalesce(link, "career_url"), description=_or(text, F.concat(F.lit("Oracle HCM posting: "), "j.Title")),
        posted_date=F.col("j.PostedDate"), source=F.lit("oraclehcm"), extraction_method=F.lit("oraclehcm_api"))


def normalize_turbohire(raw: DataFrame) -> DataFrame:
    """The location is a JSON text of addresses inside the JSON; all of them are kept. ``raw`` also has origin."""
    j = _items(raw, "Result array<struct<JobIdObfuscated:string,JobTitle:string,Location:string,Department:string,JobCode:string,PublishedDate:string,UpdatedDate:string>>",
               lambda p: p["Result"])
    names = F.filter(F.transform(F.from_json("j.Location", "array<struct<Address:string>>"), lambda a: a["Address"]),
                     lambda a: F.coalesce(a, F.lit("")) != "")
    nested = F.ltrim(F.coalesce("j.Location", F.lit(""))).startswith("[")
    place = F.when(nested, F.nullif(F.array_join(names, ", "), F.lit(""))).otherwise(T.blank_to_null("j.Location"))
    title = T.strip("j.JobTitle")
    return as_postings(
        j, source_id=F.col("j.JobIdObfuscated"), company=F.col("company"), title=title, location=F.coalesce(place, F.lit("India")),
        url=F.coalesce(F.concat("origin", F.lit("/careerpage/jobdetails/"), F.nullif(F.col("j.JobIdObfuscated"), F.lit(""))), "career_url"),
        description=F.concat_ws(" ", F.concat(title, F.lit(" at "), "company", F.lit(".")), _sentence("Department", "j.Department"), _sentence("Job code", "j.JobCode")),
        posted_date=T.first_non_empty("j.PublishedDate", "j.UpdatedDate"), source=F.lit("turbohire"), extraction_method=F.lit("turbohire_api"))


def normalize_keka(raw: DataFrame) -> DataFrame:
    """A list or an object with data; places are objects or texts, so both are read as VARIANT."""
    body = F.try_parse_json("body")
    parsed = raw.withColumn("__v", F.coalesce(F.try_variant_get(body, "$.data", "array<variant>"), F.try_variant_get(body, "$", "array<variant>")))
    j = parsed.withColumn("v", F.explode("__v")).drop("__v", "body")

    def text(path: str) -> Column:
        return F.try_variant_get("v", path, "string")

    def place(x: Column) -> Column:
        by_name = [F.try_variant_get(x, p, "string") for p in ("$.city", "$.name", "$.locationName")]
        plain = F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
        return F.coalesce(*[F.nullif(c, F.lit("")) for c in by_name], plain, F.lit(""))

    places = F.filter(F.transform(F.try_variant_get("v", "$.jobLocations", "array<variant>"), place), lambda x: x != "")
    skills = F.array_join(F.try_variant_get("v", "$.skillNames", "array<string>"), ", ")
    about = T.html_to_text(F.coalesce(F.nullif(text("$.description"), F.lit("")), text("$.excerpt")))
    exp = T.blank_to_null(text("$.experience"))
    body_text = F.concat_ws(" ", T.blank_to_null(about), F.concat(F.lit("Experience: "), exp), F.concat(F.lit("Skills: "), F.nullif(skills, F.lit(""))))
    title = T.strip(text("$.title"))
    return as_postings(
        j, source_id=text("$.id"), company=F.col("company"), title=title, location=_or(F.array_join(places, ", "), "India"),
        url=F.coalesce(F.concat("career_url", F.nullif(text("$.id"), F.lit("")), F.lit("/")), "career_url"),
        description=_or(body_text, F.concat(F.lit("Keka posting: "), title)), posted_date=text("$.publishedOn"),
        source=F.lit("keka"), extraction_method=F.lit("keka_api"))


# --- job boards --------------------------------------------------------------

def _linked(df: DataFrame, title: Column, url: Column) -> DataFrame:
    """Board rows need a title and a link."""
    return df.where((F.coalesce(T.strip(title), F.lit("")) != "") & (F.coalesce(T.strip(url), F.lit("")) != ""))


def _amount(col: str) -> Column:
    return F.format_number(F.floor(F.col(col).cast("double")), 0)


def normalize_adzuna(raw: DataFrame) -> DataFrame:
    """A salary range only when both ends are given."""
    j = _items(raw, "results array<struct<id:string,title:string,redirect_url:string,company:struct<display_name:string>,"
               "location:struct<display_name:string>,description:string,salary_min:double,salary_max:double,created:string>>", lambda p: p["results"])
    both = (F.coalesce("j.salary_min", F.lit(0.0)) != 0) & (F.coalesce("j.salary_max", F.lit(0.0)) != 0)
    firm, title = _or("j.company.display_name", "Adzuna Listed Company"), T.strip("j.title")
    return as_postings(
        _linked(j, F.col("j.title"), F.col("j.redirect_url")), source_id=F.col("j.id"), company=firm, title=title,
        location=_or("j.location.display_name", "India"), url=T.strip("j.redirect_url"),
        description=_or("j.description", F.concat(title, F.lit(" at "), firm, F.lit("."))), posted_date=F.col("j.created"),
        source=F.lit("adzuna"), extraction_method=F.lit("adzuna_api"), parse_confidence=F.lit(0.90),
        salary_text=F.when(both, F.concat(F.lit("INR "), _amount("j.salary_min"), F.lit(" - "), _amount("j.salary_max"))).otherwise(F.lit("unspecified")),
        experience_text=F.lit("unspecified"))


def normalize_jooble(raw: DataFrame) -> DataFrame:
    """S21"""
    j = _items(raw, "jobs array<struct<id:string,title:string,link:string,company:string,location:string,snippet:string,updated:string,salary:string>>", lambda p: p["jobs"])
    title = T.strip("j.title")
    return as_postings(
        _linked(j, F.col("j.title"), F.col("j.link")), source_id=F.col("j.id"), company=_or("j.company", "Jooble Listed Company"), title=title,
        location=_or("j.location", "India"), url=T.strip("j.link"), description=_or("j.snippet", F.concat(title, F.lit(" (via Jooble)"))),
        posted_date=F.col("j.updated"), source=F.lit("jooble"), extraction_method=F.lit("jooble_api"), parse_confidence=F.lit(0.85),
        salary_text=_or("j.salary", "unspecified"), experience_text=F.lit("unspecified"))


def _remote_board(j: DataFrame, title: str, url: str, firm: str, place: str, date: str, salary: Column, name: str, label: str) -> DataFrame:
    tags = F.array_join("j.tags", ", ")
    company = _or(firm, f"{label} Listed Company")
    about = T.strip(F.concat(F.coalesce(T.strip("j.description"), F.lit("")), F.when(F.coalesce(tags, F.lit("")) != "", F.concat(F.lit(" Tags: "), tags)).otherwise(F.lit(""))))
    open_here = V.eligible_location(place)
    return as_postings(
        _linked(j.where(open_here), F.col(title), F.col(url)), source_id=F.col("j.id"), company=company, title=T.strip(title),
        location=_or(place, "Remote"), url=T.strip(url),
        description=_or(about, F.concat(T.strip(title), F.lit(" opportunity at "), company, F.lit("."))), posted_date=F.col(date),
        source=F.lit(name), extraction_method=F.lit(f"{name}_api"), parse_confidence=F.lit(0.95),
        salary_text=_or(salary, "unspecified"), experience_text=F.lit("unspecified"))


def normalize_remoteok(raw: DataFrame) -> DataFrame:
    """The notice in front has no title and falls out."""
    j = _items(raw, "array<struct<id:string,position:string,url:string,company:string,location:string,tags:array<string>,description:string,"
               "salary_min:bigint,salary_max:bigint,date:string>>", lambda p: p)
    both = (F.coalesce("j.salary_min", F.lit(0)) != 0) & (F.coalesce("j.salary_max", F.lit(0)) != 0)
    pay = F.when(both, F.concat(F.lit("$"), F.col("j.salary_min").cast("string"), F.lit("-$"), F.col("j.salary_max").cast("string")))
    return _remote_board(j, "j.position", "j.url", "j.company", "j.location", "j.date", pay, "remoteok", "RemoteOK")


def normalize_remotive(raw: DataFrame) -> DataFrame:
    """S23"""
    j = _items(raw, "jobs array<struct<id:string,title:string,url:string,company_name:string,candidate_required_location:string,tags:array<string>,"
               "description:string,salary:string,publication_date:string>>", lambda p: p["jobs"])
    return _remote_board(j, "j.title", "j.url", "j.company_name", "j.candidate_required_location", "j.publication_date", F.col("j.salary"), "remotive", "Remotive")


def normalize_indeed(raw: DataFrame) -> DataFrame:
    """S24"""
    j = _items(raw, "results array<struct<jobkey:string,jobtitle:string,company:string,formattedLocation:string,city:string,url:string,snippet:string,date:string>>",
               lambda p: p["results"])
    key = F.coalesce(F.nullif(F.col("j.jobkey"), F.lit("")), "j.jobtitle")
    place, firm = T.first_non_empty("j.formattedLocation", "j.city", F.lit("India")), _or("j.company", "Unknown Company")
    return as_postings(
        j, source_id=key, company=firm, title=F.col("j.jobtitle"), location=place,
        url=_or("j.url", F.concat(F.lit("https://www.indeed.com/viewjob?jk="), key)),
        description=F.concat("j.jobtitle", F.lit(" position at "), firm, F.lit(" ("), place, F.lit("). "), F.coalesce("j.snippet", F.lit(""))),
        posted_date=F.col("j.date"), source=F.lit("indeed"), extraction_method=F.lit("indeed_publisher_api"), parse_confidence=F.lit(0.95))


def normalize_naukri_actor(raw: DataFrame) -> DataFrame:
    """Creation times are epoch milliseconds or naive text."""
    j = _items(raw, "array<struct<jobId:string,title:string,jdURL:string,companyName:string,placeholders:struct<location:string>,location:string,"
               "tagsAndSkills:string,jobDescription:string,experienceText:string,createdDate:string>>", lambda p: p)
    millis = F.when(F.col("j.createdDate").rlike(r"^[0-9]{13,15}$"), F.col("j.createdDate").try_cast("bigint"))
    posted = F.coalesce(F.timestamp_millis(millis), F.try_to_timestamp("j.createdDate", F.lit("yyyy-MM-dd HH:mm:ss")))
    about = T.strip(F.concat(
        F.coalesce(T.strip("j.jobDescription"), F.lit("")),
        F.coalesce(F.concat(F.lit("\n\nSkills: "), F.nullif(F.col("j.tagsAndSkills"), F.lit(""))), F.lit("")),
        F.lit("\n\nExperience: "), _or("j.experienceText", "0 years")))
    return as_postings(
        _linked(j, F.col("j.title"), F.col("j.jdURL")), source_id=F.col("j.jobId"), company=_or("j.companyName", "Unknown"), title=T.strip("j.title"),
        location=T.first_non_empty("j.placeholders.location", "j.location", F.lit("India")), url=F.col("j.jdURL"), description=about,
        posted_date=F.date_format(posted, "yyyy-MM-dd HH:mm:ss"), source=F.lit("naukri_apify"), extraction_method=F.lit("apify_actor"))


def normalize_jobspy(rows: DataFrame) -> DataFrame:
    """Scraper rows (title, job_url, company, location, description, date_posted)."""
    posted = F.when(F.length("date_posted") == 10, F.concat("date_posted", F.lit("T00:00:00+00:00"))).otherwise(F.col("date_posted"))
    key = F.nullif(F.regexp_extract("job_url", r"jk=([^&]*)", 1), F.lit(""))
    return as_postings(
        _linked(rows, F.col("title"), F.col("job_url")), source_id=F.coalesce(key, T.short_hash(F.col("job_url"))), company=_or("company", "Unknown"), title=T.strip("title"),
        location=_or("location", "India"), url=F.col("job_url"), description=_or("description", F.concat("title", F.lit(" - see posting."))),
        posted_date=posted, source=F.lit("indeed"), extraction_method=F.lit("jobspy"))


# --- probes, replies, health -------------------------------------------------

def probe_summary(postings: DataFrame) -> DataFrame:
    """Openings per probed board: total, in India, for freshers, and both.
    ``postings``: name, ats, title, location."""
    fresher, india = V.is_fresher_title("title"), V.is_india("location")
    return postings.groupBy("name", "ats").agg(
        F.count(F.lit(1)).alias("total_jobs"), F.count_if(india).alias("india_jobs"),
        F.count_if(fresher).alias("fresher_jobs"), F.count_if(fresher & india).alias("fresher_india_jobs"))


def parse_scored_reply(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Score, matched_skills and reasoning from a model's answer, however it is wrapped."""
    bare = F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?m)^```(?:json)?\s*", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    parsed = df.withColumn("__r", F.from_json(inner, "score string, matched_skills array<string>, reasoning string"))
    score = F.col("__r.score").try_cast("double")
    return parsed.withColumns({
        "score": F.greatest(F.lit(40), F.least(F.lit(98), F.coalesce(F.floor(score), F.lit(65)))).cast("int"),
        "matched_skills": F.coalesce("__r.matched_skills", F.array().cast("array<string>")),
        "reasoning": F.coalesce(T.blank_to_null("__r.reasoning"), F.lit("Evaluated by model"))}).drop("__r")


def source_health(fetch_log: DataFrame) -> DataFrame:
    """State of each source's run. ``fetch_log``: source, run_id, http_status, jobs_count, error."""
    one = fetch_log.groupBy("source", "run_id").agg(
        F.sum("jobs_count").alias("jobs_count"), F.max("http_status").alias("http_status"),
        F.max(F.lower(F.coalesce("error", F.lit("")))).alias("__error"))
    code = F.col("http_status")
    return one.withColumn("status", (
        F.when(F.col("__error").contains("timeout"), F.lit("timeout"))
        .when(code == 429, F.lit("quota_exhausted")).when(code.isin(401, 403), F.lit("blocked"))
        .when((code >= 400) | (F.col("__error") != ""), F.lit("unavailable"))
        .when(F.col("jobs_count") > 0, F.lit("success")).otherwise(F.lit("zero_results")))).drop("__error")
