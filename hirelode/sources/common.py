"""The posting projection every source ends in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.filters import valid_only

POSTING_COLUMNS = {
    "source_id": "string", "company": "string", "title": "string", "location": "string",
    "url": "string", "description": "string", "posted_date": "string", "source": "string",
    "extraction_method": "string", "parse_confidence": "double", "salary_text": "string",
    "experience_text": "string",
}


def as_postings(df: DataFrame, valid: bool = True, keep: list[str] = (), **columns: Column) -> DataFrame:
    """Common columns from the given expressions, missing ones null, invalid rows dropped."""
    out = df.select(*keep, *[
        (columns[name] if name in columns else F.lit(None)).cast(kind).alias(name)
        for name, kind in POSTING_COLUMNS.items()])
    return valid_only(out) if valid else out


def fill_defaults(df: DataFrame) -> DataFrame:
    """Company and description are never blank."""
    named = df.withColumn("company", F.coalesce(T.blank_to_null("company"), F.lit("Unknown Company")))
    return named.withColumn("description", F.coalesce(
        T.blank_to_null("description"), F.concat("title", F.lit(" role at "), "company")))
