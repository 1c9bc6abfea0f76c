"""Reports and their checking SQL on tables of a few rows."""

import duckdb
from pyspark.sql import functions as F

from hirelode.catalog import oracles
from hirelode.operators import stats as R
from hirelode.streaming import jobs as ST


def test_a_deadline_passes_with_the_time_of_all_events(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:00:00"), (2, 1, "2024-01-02 00:00:00"), (3, 2, "2024-01-05 00:00:00.5"), (4, 3, "2024-01-08 00:00:00.4")]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, user_id BIGINT, ts TIMESTAMP)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?)", rows)
    job = ST.trial_job(ST.Ledger(spark, str(tmp_path)))
    job.publish(spark.createDataFrame(rows, "outcome_id long, trial long, at string").select(
        "outcome_id", F.concat(F.lit("trial "), F.col("trial").cast("string")).alias("trial"), F.col("at").cast("timestamp").alias("at")), 0)
    got = job.view()[0].where("closed_by IS NOT NULL").select("trial", "outcomes", "closed_by").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(oracles()["t9_trial_stream"]).fetchall()) == [("trial 1", 2, "deadline")]


def test_role_stats_end_in_a_recommendation(tables):
    found = {r["role"]: r["recommendation"] for r in R.role_stats(tables.applications, ["Engineer"]).collect()}
    assert found["Engineer"].startswith("You have ") and "success rate for 'Engineer'. Focus on top companies like " in found["Engineer"]
