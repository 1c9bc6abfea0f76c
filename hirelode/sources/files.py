"""Stores, company lists, filter settings and profiles read from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import skills as S
from ..functions import text as T

STORE_SCHEMA = """id string, company string, title string, location string, url string, canonical_url string, description string,
  posted_date string, first_seen string, first_seen_at string, last_seen string, scan_timestamp string, source string, source_id string,
  req_id string, sources array<string>, source_ids map<string,string>, parse_confidence double, extraction_method string,
  salary_range_inr string, experience_required string, closed boolean,
  match struct<score:double,tier:int,resume_version_hash:string,matched_skills:array<string>,missing_skills:array<string>>"""


def read_store(spark: SparkSession, path: str, schema: str = STORE_SCHEMA) -> DataFrame:
    """Postings of JSON stores ({"jobs": [...]}); a missing or broken store is empty."""
    jobs = T_.StructType([T_.StructField("jobs", T_.ArrayType(T_._parse_datatype_string(schema)))])
    try:
        raw = spark.read.schema(jobs).option("multiLine", True).option("mode", "PERMISSIVE").option("ignoreMissingFiles", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.createDataFrame([], jobs)
    return raw.select(F.inline("jobs"))


def read_companies_csv(spark: SparkSession, path: str) -> DataFrame:
    """Name, career_url, ats_hint under any of their usual headings."""
    raw = spark.read.option("header", True).csv(path)

    def alias(*names: str):
        have = [c for c in names if c in raw.columns]
        return T.first_non_empty(*have) if have else F.lit(None).cast("string")

    return raw.select(alias("name", "Company", "company_name").alias("name"), alias("career_url", "url", "Career URL").alias("career_url"),
                      F.coalesce(alias("ats_hint", "ats"), F.lit("custom")).alias("ats_hint"))


def parse_companies_json(raw: DataFrame, body: str = "body") -> DataFrame:
    """S3: companies from documents that are a list or an object with 'companies'."""
    v = F.try_parse_json(body)
    items = F.coalesce(F.try_variant_get(v, "$.companies", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    exploded = raw.select(F.explode(items).alias("v"))

    def at(name: str):
        return T.strip(F.try_variant_get("v", f"$.{name}", "string"))

    return exploded.select(at("name").alias("name"), at("career_url").alias("career_url"),
                           F.coalesce(at("ats_hint"), F.lit("custom")).alias("ats_hint"))


def read_companies_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_companies_json(spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "body"))


def parse_filter_terms(raw: DataFrame, body: str = "body") -> DataFrame:
    """(kind, group, term) of filter settings: a text, a list of texts, or tiers of groups of values."""
    doc = raw.select(F.try_parse_json(body).alias("d"))
    kinds = ["target_role", "target_location", "target_experience", "exclude_keywords"]
    each = doc.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.try_variant_get("d", f"$.{k}", "variant").alias("v")) for k in kinds])).alias("k")).select("k.*")
    listed = each.withColumn("item", F.explode(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))))
    groups = F.try_variant_get("item", "$.category_groups", "array<variant>")
    plain = listed.where(F.schema_of_variant("item") == "STRING").select(
        "kind", F.lit(None).cast("string").alias("group"), F.try_variant_get("item", "$", "string").alias("term"))
    nested = listed.withColumn("g", F.explode(groups)).select(
        "kind", F.try_variant_get("g", "$.group_name", "string").alias("group"), F.explode(F.try_variant_get("g", "$.values", "array<string>")).alias("term"))
    return plain.union(nested).withColumn("term", T.strip("term")).where("term <> ''")


def load_filter_terms(spark: SparkSession, path: str) -> DataFrame:
    return parse_filter_terms(spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "body"))


# fixed values: skills a profile is searched for
PROFILE_SKILLS = [
    "Python", "Java", "C++", "C#", "JavaScript", "TypeScript", "React", "Angular", "Vue", "Node.js", "Express",
    "Flask", "Django", "FastAPI", "Spring Boot", "SQL", "PostgreSQL", "MySQL", "MongoDB", "Redis", "AWS", "Azure", "GCP",
    "Docker", "Kubernetes", "Git", "Linux", "REST API", "GraphQL", "Microservices", "Machine Learning", "Deep Learning",
    "NLP", "Pandas", "NumPy", "PyTorch", "TensorFlow", "HTML", "CSS", "Tailwind", "Bootstrap", "Agile", "Scrum", "CI/CD",
]


def profile_of(df: DataFrame, text: str) -> DataFrame:
    """Skills, years of experience (at most 40) and content version of profile texts.

    Every skill name ends the match at a word edge, so 'C++' needs a letter right after it.
    """
    wordy = T.any_of([s.upper() for s in PROFILE_SKILLS])
    display = S._skill_map({s.upper(): s for s in PROFILE_SKILLS})
    named = F.regexp_extract_all(F.upper(text), F.lit(rf"(?U)\b(?:{wordy})\b"), 0)
    years = F.filter(F.transform(
        F.regexp_extract_all(text, F.lit(r"(?iU)(\d+)\+?\s*(?:years?|yrs?)\s*(?:of\s*)?(?:experience|exp)?"), 1),
        lambda y: y.try_cast("int")), lambda y: y <= 40)
    return df.withColumns({
        "skills": F.array_sort(F.array_distinct(F.transform(named, lambda s: F.element_at(display, s)))),
        "years": F.array_max(years), "version": T.version_hash(text)})


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    """One profile per text file."""
    files = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("profile"), F.col("value").alias("raw_text"))
    return profile_of(files, "raw_text")
