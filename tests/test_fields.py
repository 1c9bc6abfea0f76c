"""Literal cases of the text, requirement, role and validity rules."""

import pytest
from pyspark.sql import functions as F

from hirelode.functions import fields as V
from hirelode.functions import skills as S
from hirelode.functions import text as T
from hirelode.operators.filters import validity
from hirelode.operators.scoring import Profile, score_local


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize("text,years", [
    ("3-5yrs in backend", 3), ("2+ years with Java", 2), ("minimum of 4 years", 4), ("launched 9 years ago", None),
    ("5 years of company history", None), ("experience required - 3 yrs", 3), ("requires 6 years", 6), ("0 to 2 years", 0)])
def test_experience(spark, text, years):
    assert one(spark, V.min_experience_years(F.lit(text))) == years


@pytest.mark.parametrize("terms,years", [(["0-2 years", "Fresher"], 2), (["Entry-level"], 0), (["anything"], None), (["3 years"], 3)])
def test_experience_ceiling(spark, terms, years):
    assert one(spark, V.max_user_years(F.array(*[F.lit(t) for t in terms]))) == years


@pytest.mark.parametrize("term,title,hit", [
    ("C++", "C++ Developer", True), ("C++", "C Developer", False), ("C", "C Developer", True), ("C", "C++ Developer", False),
    ("C#", "Senior C# Engineer", True), ("C", "C# Engineer", False), ("R", "R Developer", True), ("R", "R&D Engineer", False),
    (".NET", ".NET Developer", True), ("Java", "JavaScript Developer", False), ("Java", "Java Developer", True)])
def test_role_symbols(spark, term, title, hit):
    assert one(spark, S.matches_role(F.lit(title), term)) is hit


@pytest.mark.parametrize("term,place,hit", [
    ("Gurugram", "Gurgaon, India", True), ("Bangalore", "Bengaluru", True), ("NCR", "Noida", True), ("Pune", "Mumbai", False), ("Remote", "Berlin", False)])
def test_location_synonyms(spark, term, place, hit):
    assert one(spark, S.matches_location(F.lit(place), F.lit("remote on Fridays"), term)) is hit


@pytest.mark.parametrize("value,score", [(None, 50), ("82", 82), ("invalid", 50), ("45.6", 45), ("150", 100), ("-20", 0)])
def test_numeric_score(spark, value, score):
    assert one(spark, V.numeric_score(F.lit(value).cast("string"))) == score


@pytest.mark.parametrize("a,b", [
    ("https://X.com/jobs/1?utm_source=a&ref=b", "https://x.com/jobs/1/?session=9#top"), ("x.com/j?b=2&a=1", "https://x.com/j?a=1&b=2&fbclid=z")])
def test_same_canonical_url(spark, a, b):
    assert one(spark, T.normalize_url(F.lit(a))) == one(spark, T.normalize_url(F.lit(b)))


@pytest.mark.parametrize("title,score,category", [
    ("DevOps Engineer", 70, "adjacent_engineering"), ("Technical Support Engineer", 45, "support"), ("Data Scientist", 90, "ai_ml"),
    ("Software Engineer Intern", 95, "core_software"), ("Marketing Manager", 15, "non_technical"), ("Mechanical Engineer", 20, "non_software_engineering"),
    ("QA Engineer", 45, "testing_qa"), ("Barista", 40, "unknown")])
def test_role_classes(spark, title, score, category):
    row = one(spark, S.classify_role(F.lit(title), F.lit("")))
    assert (row["score"], row["category"]) == (score, category)


@pytest.mark.parametrize("title,senior", [("Lead_Engineer", True), ("Engineer-Senior", True), ("Leadership Trainee", False), ("Managerial Intern", False)])
def test_seniority(spark, title, senior):
    assert one(spark, S.seniority(F.lit(title), F.lit("")))["senior"] is senior


@pytest.mark.parametrize("title,place", [
    ("Principal Software EngineerIndia, Telangana, HyderabadPosted 19 days ago", "India, Telangana, Hyderabad"), ("Software Engineer", None)])
def test_glued_title(spark, title, place):
    row = one(spark, T.split_glued_title(F.lit(title)))
    assert row["location"] == place and not row["title"].endswith("India")


@pytest.mark.parametrize("base,href,want", [
    ("https://a.com/x/y", "z", "https://a.com/x/z"), ("https://a.com/x/y", "../z", "https://a.com/z"), ("https://a.com/x", "//b.com/q", "https://b.com/q"),
    ("https://a.com/x", "javascript:void(0)", "https://a.com/x"), ("https://a.com", "jobs", "https://a.com/jobs")])
def test_resolve_url(spark, base, href, want):
    assert one(spark, T.resolve_url(F.lit(href), F.lit(base))) == want


def test_validity(spark):
    rows = [("a", "Software Engineer", "https://x.com/jobs/1", "Pune", None, True), ("a", "AI Summit 2026", "https://x.com/jobs/1", "Pune", None, False),
            ("a", "About Us", "https://x.com/about", "", None, False), ("a", "Software Engineer", "https://blog.x.com/a", "Pune", None, False),
            ("Acme India", "Software Engineer", "https://x.com/jobs/2", "Berlin, Germany", None, False), ("a", "QA", "https://x.com/jobs/2", "Pune", None, False)]
    df = spark.createDataFrame(rows, "company string, title string, url string, location string, posted_date string, ok boolean")
    assert [r["is_valid"] for r in validity(df).collect()] == [r[-1] for r in rows]


def test_skill_confidence(spark):
    df = spark.createDataFrame([("Software Engineer", "Python and Docker"), ("Software Engineer", "nothing"), ("Software Engineer", "Python. " + "x" * 400)],
                               "title string, description string")
    got = {r["description"][:8]: (r["skill_confidence"], r["skill_score"]) for r in score_local(df, Profile(["python", "Docker"], 0)).collect()}
    assert got == {"Python a": ("explicit", 98), "nothing": ("unknown", None), "Python. ": ("inferred", 65)}
