"""Registered queries against DuckDB at the smallest scale, and contracts of the registry."""

import duckdb
import pytest

import __spark_entry__ as entry
from hirelode import catalog
from hirelode.adapters import BASE

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["p1_normalize_url", "p6_canonical_id", "p12_min_experience_years", "x6_extract_skills", "f1_validity", "f4_expand_if_sparse",
          "j8_reconcile", "j11_duplicate_applications", "d1_dedup_exact", "d7_dedup_within", "k3_merge_store", "c4_score_local", "a4_company_stats",
          "a15_yield_by_bucket", "w5_prior_avg_yield", "w6_rpm_window", "w7_failure_backoff", "o7_select_examples", "v4_knn", "e3_ndcg_at_k",
          "s11_normalize_keka", "s32_normalize_linkedin", "t5_yield_stream", "t7_streak_stream"]


def plain(v):
    if isinstance(v, float):
        return round(v, 4)
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_check(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = duck.execute(entry.oracle_sql()[name])
    theirs = [d[0] for d in cur.description]
    order = sorted(df.columns)
    assert order == sorted(theirs)
    a = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(r[theirs.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    assert a == b


@pytest.mark.parametrize("name", ["s25_normalize_rss_whole", "s33_import_posting_page", "s33_import_posting_page_fallbacks"])
def test_landing_queries_give_every_row(spark, duck, name):
    test_query_equals_check(spark, duck, name)
    of = "pages" if name.startswith("s33") else "(SELECT * FROM (%s))" % entry.oracle_sql()["s32_normalize_linkedin"]
    assert entry.queries()[name](spark, FOLDER).count() == duck.execute(f"SELECT count(*) FROM {of}").fetchone()[0]


def test_scan_cycle_reads_every_posting(spark, tables):
    from pyspark.sql import functions as F
    got = {r["id"] for r in entry.queries()["q3_scan_cycle"](spark, FOLDER).collect()}
    stored = tables.store.where("title <> 'Webinar on Cloud' AND first_seen > timestamp '2001-08-02' - interval 1199 day")
    assert {r["id"] for r in stored.collect()} <= got
    from hirelode.operators.identity import normalize_postings
    def ids(host, where):
        copies = tables.postings.where(where).withColumn("url", F.replace("url", F.lit("careers.example.com"), F.lit(host)))
        return {r["id"] for r in normalize_postings(copies).select("id").collect()}
    new, buried = ids("new.example.com", "source = 'web'"), ids("new.example.com", "source = 'web' AND location = 'Berlin, Germany'")
    assert new & got and buried and not buried & got and ids("old.example.com", "source = 'adzuna'") & got


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    queries, checks = catalog.queries(), catalog.oracles()
    assert set(queries) - set(checks) == {"x3_seq_ratio", "j10_near_dup_pairs", "d2_dedup_near", "q3_scan_cycle", "v1_chunk"}


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "company", "title", "location", "score", "first_seen"]


def test_funnel_adds_up(spark):
    row = entry.queries()["a1_funnel"](spark, FOLDER).first().asDict()
    gone = sum(v for k, v in row.items() if k.startswith("dropped_") and k != "dropped_invalid_at_dedup")
    assert row["total_in_store"] == row["duplicates_merged"] + gone + row["awaiting_scoring"] + row["already_applied"] + row["shown"]


def test_chunks(spark):
    from hirelode.operators.chunks import chunk_text, register_sql
    text = "One. " * 300 + "\n" + "word " * 500
    parts = chunk_text(text, 200, 40)
    # a chunk is its units plus the overlap it starts with
    assert all(len(p) <= 200 + 40 for p in parts) and parts[0].startswith("One.") and parts[-1].endswith("word")
    assert chunk_text("  ") == [] and chunk_text(None) == []
    register_sql(spark)
    assert spark.sql("SELECT count(*) AS n FROM chunk_text('a b c', 600, 100)").first()["n"] == 1


def test_global_rank_is_dense(spark):
    from pyspark.sql import functions as F

    from hirelode.session import with_global_rank
    df = spark.range(1000).withColumn("s", F.col("id") % 7)
    got = [(r["s"], r["id"], r["rank"]) for r in with_global_rank(df, F.col("s"), F.col("id")).collect()]
    assert sorted(r[2] for r in got) == list(range(1, 1001))
    assert [r[:2] for r in sorted(got, key=lambda r: r[2])] == sorted(r[:2] for r in got)
