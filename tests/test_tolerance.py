"""Tolerance chains (D7) against a plain walk along each key's times."""

import datetime as dt
import random

import pytest

from hirelode.operators import dedup as D

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def plain(rows, seconds):
    out, last = [], {}
    for k, at, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        if k not in last or last[k] == at or (at - last[k]).total_seconds() >= seconds:
            last[k] = at
            out.append(i)
    return sorted(out)


@pytest.mark.parametrize("bucket,fan", [(32, 64), (1, 2), (2, 3)])
def test_chains_equal_a_plain_walk(spark, monkeypatch, bucket, fan):
    monkeypatch.setattr(D, "BUCKET_TOLERANCES", bucket)
    monkeypatch.setattr(D, "FAN", fan)
    rng = random.Random(bucket)
    rows = []
    for key, n, step in (("dense", 500, 4), ("sparse", 60, 900), (None, 80, 30), ("bursts", 200, 11)):
        at = 0
        for _ in range(n):
            at += rng.randrange(step) + (5000 if key == "bursts" and rng.random() < 0.03 else 0)
            rows.append((key, T0 + dt.timedelta(seconds=at), len(rows)))
    rows += [("dense", None, 9000), ("one", T0, 9001), ("dense", rows[0][1], 9002)]
    df = spark.createDataFrame(rows, "k string, at timestamp, i int")
    got = D.dedup_within(df, ["k"], "at", 60)
    assert got.columns == df.columns and sorted(r["i"] for r in got.collect()) == plain(rows, 60)


def test_empty_and_single(spark):
    df = spark.createDataFrame([("a", T0, 1)], "k string, at timestamp, i int")
    assert D.dedup_within(df, ["k"], "at", 60).count() == 1 and D.dedup_within(df.limit(0), ["k"], "at", 60).count() == 0
