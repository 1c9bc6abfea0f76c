"""Queries in plain SQL over the registered functions and tables."""

from __future__ import annotations

from ..functions.sql import register_functions
from .base import ORACLES, query


def run(t, statement: str, **frames):
    register_functions(t.spark)
    return t.spark.sql(statement, **frames)


@query("sql_identity", """SELECT native_id, canonical_url, ncompany AS company, ntitle AS title, nlocation AS location, req, id,
 token_set AS same_words FROM (SELECT *, 1.0::DOUBLE AS token_set FROM pid)""", "pid")
def identity(t):
    return run(t, """SELECT native_id, normalize_url(url) AS canonical_url, clean_company(company) AS company, clean_title(title) AS title,
        clean_location(location) AS location, posting_req_id(NULL, url) AS req, canonical_id(company, title, location, url) AS id,
        token_set_ratio(title, upper(title)) AS same_words FROM {p}""", p=t.postings)


@query("sql_min_experience_years", ORACLES["p12_min_experience_years"])
def years(t):
    return run(t, "SELECT native_id, min_experience_years(concat_ws(' ', title, '', description)) AS min_years FROM {p}", p=t.postings)


@query("sql_classify_role", ORACLES["c1_classify_role"])
def role(t):
    return run(t, "SELECT native_id, r.score AS role_score, r.category AS role_category FROM (SELECT native_id, classify_role(title, description) AS r FROM {p})", p=t.postings)


@query("sql_token_set_ratio", ORACLES["x1_token_set_ratio"])
def ratio(t):
    return run(t, """SELECT native_id, round(token_set_ratio(title, CASE native_id % 3 WHEN 0 THEN 'Software Engineer' WHEN 1 THEN 'Senior Software Engineer Intern'
        ELSE 'Data Developer' END), 6) AS ratio FROM {p}""", p=t.postings)
