"""Containment, shared words, store layout and log generations against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from hirelode.operators import joins as J
from hirelode.operators import ranking as O
from hirelode.operators import shared_words as W
from hirelode.operators import sinks as K
from hirelode.streaming.ledger import Ledger


def test_containment_equals_all_pairs(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abc ü") for _ in range(n))      # noqa: E731
    texts = sorted({word(rng.randrange(0, 14)) for _ in range(120)} | {"a" * 300})
    needles = sorted({word(rng.randrange(0, 6)) for _ in range(90)} | {"zzz", "", "a" * 40})
    got = {(r["needle"], r["text"]) for r in J.containment_pairs(
        spark.createDataFrame([(n,) for n in needles + [None]], "needle string"), spark.createDataFrame([(x,) for x in texts + [None]], "text string")).collect()}
    assert got == {(n, t) for n in needles for t in texts if n and t and n in t}


@pytest.mark.parametrize("heavy", [1000, 3, 0])
def test_feedback_overlap_with_frequent_words(spark, monkeypatch, heavy):
    monkeypatch.setattr(W, "HEAVY", heavy)
    rng = random.Random(heavy)
    words = ["engineer", "software", "data", "acme", "globex", "lead", "intern", "qa", "cloud", "rare1", "rare2", "rare3"]
    text = lambda: " ".join(rng.sample(words, rng.randrange(0, 4)))      # noqa: E731
    keys = [(text(), text()) for _ in range(40)]
    log = [(i, rng.choice(["yes", "no"]), text(), text()) for i in range(60)]
    got = {(r["company"], r["title"]): (r["total"], r["positive"]) for r in J.feedback_overlap(
        spark.createDataFrame(keys, "company string, title string"),
        spark.createDataFrame(log, "feedback_id int, action string, job_title string, company string")).collect()}
    want = {}
    for k in set(keys):
        met = [a for _, a, t, c in log if set((t + " " + c).split()) & set(" ".join(k).split())]
        if met:
            want[k] = (len(met), met.count("yes"))
    assert got == want


@pytest.mark.parametrize("heavy", [1000, 2, 0])
def test_examples_with_frequent_words(spark, monkeypatch, heavy):
    monkeypatch.setattr(W, "HEAVY", heavy)
    rng = random.Random(20 + heavy)
    words = ["engineer", "software", "data", "lead", "intern", "qa", "cloud", "rare1", "rare2"]
    text = lambda: " ".join(rng.sample(words, rng.randrange(0, 5)))      # noqa: E731
    titles = sorted({text() for _ in range(30)})
    log = [(i, rng.choice(["yes", "no", "skip"]), text(), "c", text(), i) for i in range(40)]
    got = {(r["title"], r["action"], r["example_rank"]): r["feedback_id"] for r in O.select_examples(
        spark.createDataFrame([(t,) for t in titles], "title string"),
        spark.createDataFrame(log, "feedback_id int, action string, job_title string, company string, reason string, job_match_score int")).collect()}
    want = {}
    for t in titles:
        for action in ("yes", "no"):
            ranked = sorted((-round(len(set(t.split()) & set((j + " " + why).split())) + i * 0.1, 6), i) for i, a, j, _, why, _ in log if a == action)
            want |= {(t, action, n + 1): i for n, (_, i) in enumerate(ranked[:2])}
    assert got == want


def test_store_files_follow_measured_bytes(spark, tmp_path):
    rows = [(i, "x" * 1000, "2024-01-05") for i in range(400)] + [(1000, "x", "2024-02-01"), (1001, "x", None)]
    df = spark.createDataFrame(rows, "native_id long, text string, posted_date string")
    K.write_store(df, str(tmp_path), file_bytes=100_000)
    files = {m: len(list((tmp_path / f"posted_month={m}").glob("*.parquet"))) for m in ("2024-01", "2024-02", "unknown")}
    assert 3 <= files["2024-01"] <= 6 and files["2024-02"] == files["unknown"] == 1
    K.write_store(df.where("native_id = 1000").withColumn("text", F.lit("new")), str(tmp_path))
    again = spark.read.parquet(str(tmp_path))
    assert again.count() == 402 and again.where("native_id = 1000").first()["text"] == "new"
    K.write_store(df.limit(0), str(tmp_path / "none"))


def test_log_generations(spark, tmp_path):
    path, log = str(tmp_path / "log"), lambda a, b: spark.range(a, b).withColumnRenamed("id", "n")      # noqa: E731
    keep = lambda d: K.retain_newest(d, 10, "n", "n")                    # noqa: E731
    K.append_log(log(0, 20), path)
    K.append_log(log(20, 25), path)
    assert K.read_log(spark, path).count() == 25
    K.compact_log(spark, path, keep)
    assert sorted(r["n"] for r in K.read_log(spark, path).collect()) == list(range(15, 25))
    Ledger(spark, path).write("log", 2, log(0, 1))                       # a compaction that fails before its swap
    K.append_log(log(25, 28), path)
    assert K.read_log(spark, path).count() == 13
    K.compact_log(spark, path, keep)
    assert sorted(r["n"] for r in K.read_log(spark, path).collect()) == list(range(18, 28))
