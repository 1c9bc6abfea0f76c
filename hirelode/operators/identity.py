"""Attaching canonical identity to landed postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def normalize_postings(df: DataFrame) -> DataFrame:
    """Canonical id, normalised columns and default provenance."""
    explicit = [c for c in ("req_id", "requisition_id", "job_code") if _has(df, c)]
    stated = T.first_non_empty(*explicit) if explicit else None
    url = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("url", "canonical_url") if _has(df, c)], F.lit(""))
    source = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("web")) if _has(df, "source") else F.lit("web")
    landed_id = F.coalesce(F.col("native_id").cast("string"), F.col("id")) if _has(df, "native_id") else F.col("id")
    sources = F.array(source)
    if _has(df, "sources"):
        sources = F.when(F.size("sources") > 0, F.col("sources")).otherwise(sources)
    source_ids = F.create_map(source, landed_id.cast("string"))
    if _has(df, "source_ids"):
        source_ids = F.coalesce("source_ids", source_ids)
    parts = df.withColumns({
        "canonical_url": T.normalize_url(url),
        "normalized_company": T.clean_company("company"),
        "normalized_title": T.clean_title("title"),
        "normalized_location": T.clean_location("location"),
        "req_id": T.req_id(stated, url),
    })
    cid = T.identity_of(
        "normalized_company", "normalized_title", "normalized_location", "req_id", "canonical_url",
        source="source" if _has(df, "source") else None,
        source_id="source_id" if _has(df, "source_id") else None)
    return parts.withColumns({
        "id": cid, "canonical_url": F.coalesce(F.nullif(F.col("canonical_url"), F.lit("")), url),
        "sources": sources, "source_ids": source_ids,
    })
