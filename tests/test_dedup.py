"""Near-duplicates, imports and merges against brute force."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from hirelode import rules
from hirelode.operators import near_dup
from hirelode.operators.dedup import dedup_within, deduplicate, near_clusters
from hirelode.operators.filters import import_companies
from hirelode.operators.joins import containment_pairs
from hirelode.operators.near_dup import matching_names

WORDS = ["software", "engineer", "senior", "data", "backend", "developer", "intern", "platform", "lead", "enginer", "softwares", "analyst"]


def match(a, b):
    """Whether the later row a joins a cluster headed by b."""
    if a["company"][:4] != b["company"][:4] or (a["req"] and b["req"] and a["req"] != b["req"]):
        return False
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    if not (a["company"] == b["company"] or ratio(a["company"], b["company"]) > 0.85):
        return False
    if not (a["location"] == b["location"] or ratio(a["location"], b["location"]) > 0.80):
        return False
    ta, tb = set(a["title"].split()), set(b["title"].split())
    if (ta & set(rules.SENIORITY_TOKENS)) != (tb & set(rules.SENIORITY_TOKENS)):
        return False
    both = len(ta & tb)
    return both / max(len(ta), len(tb)) >= 0.75 or ratio(a["title"], b["title"]) >= 0.85 or (both / min(len(ta), len(tb)) >= 0.85 and both >= 2)


def test_near_clusters_equal_first_fit(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        company = rng.choice(["acme widgets", "acme widget", "acme wigdets", "acmeb", "acmebx", "globex corp", "globex corps", "glob", "globe"])
        title = " ".join(rng.sample(WORDS, rng.randint(1, 4)))
        rows.append({"id": f"{i:05d}", "company": company, "title": title, "location": rng.choice(["pune", "punee", "mumbai", "navi mumbai", "remote"]),
                     "req": rng.choice(["", "", "req1", "req2"]), "seen": rng.randint(0, 300)})
    rows.sort(key=lambda r: (r["seen"], r["id"]))
    heads, want = [], {}
    for r in rows:
        head = next((h for h in heads if match(r, h)), None)
        if head is None:
            heads.append(r)
        want[r["id"]] = (head or r)["id"]
    df = spark.createDataFrame([(r["id"], r["company"], r["title"], r["location"], r["req"], r["seen"]) for r in rows],
                               "id string, normalized_company string, normalized_title string, normalized_location string, req_id string, seen int")
    df = df.withColumn("first_seen", F.timestamp_seconds("seen"))
    got = {r["id"]: r["cluster_id"] for r in near_clusters(df).collect()}
    assert got == want
    assert len(heads) < len(rows)
    again = {r["id"]: r["cluster_id"] for r in near_clusters(df.repartition(13)).collect()}
    assert again == want


@pytest.mark.parametrize("rounds, part", [(2, 200_000), (3, 40)])
def test_first_fit_settles_long_chains(spark, monkeypatch, rounds, part):
    monkeypatch.setattr(near_dup, "ROUNDS", rounds)
    monkeypatch.setattr(near_dup, "PART_EDGES", part)
    rng = random.Random(2)
    long = 500 if part > 1000 else 20                                # a chain needs a round for each two keys
    pairs = [(i, i - 1) for i in range(1, long)] + [(1000 + i, 1000 + i - 1) for i in range(1, 15)]
    pairs += [(2000 + max(p), 2000 + min(p)) for p in (rng.sample(range(30), 2) for _ in range(60))]
    earlier, heads, want = {}, set(), {}
    for a, b in pairs:
        earlier.setdefault(a, set()).add(b)
    for key in sorted({x for p in pairs for x in p}):
        found = sorted(earlier.get(key, set()) & heads)
        want |= {key: found[0]} if found else {}
        heads |= set() if found else {key}
    edges = spark.createDataFrame([(f"{a:05d}", f"{b:05d}", a, b) for a, b in pairs], "later string, earlier string, later_ord int, earlier_ord int")
    got = {int(r["member"]): int(r["head"]) for r in near_dup.first_fit(edges).collect()}
    assert got == want


def test_similar_names_lose_nothing(spark):
    rng = random.Random(3)
    base = ["acmewidgets", "acmeworks", "acmeindustrial services", "acme", "acmez"]
    names = set(base)
    for b in base * 12:
        s = list(b)
        for _ in range(rng.randint(1, 3)):
            at = rng.randint(4, len(s))
            if rng.random() < 0.5 and at < len(s):
                del s[at]
            else:
                s.insert(at, rng.choice("abcxyz"))
        names.add("".join(s))
    names = sorted(names)
    df = spark.createDataFrame([("acme", n) for n in names], "block string, s string")
    got = {(r["a"], r["b"]) for r in matching_names(df, 0.85).collect()}
    want = {(a, b) for a in names for b in names if a == b or SequenceMatcher(None, a, b).ratio() > 0.85}
    assert got == want
    got = {(r["a"], r["b"]) for r in matching_names(df, 0.80).collect()}
    assert got == {(a, b) for a in names for b in names if a == b or SequenceMatcher(None, a, b).ratio() > 0.80}


def test_two_sources_become_one(spark):
    rows = [("Microsoft", "Software Engineer", "Bangalore", "https://m.com/jobs/1", "indeed", "x", "2024-01-01", 0.5, 1),
            ("Microsoft India", "Software Engineer", "Bengaluru", "https://careers.m.com/jobs/77", "web", "longer text", "2024-01-02", 0.5, 2)]
    df = spark.createDataFrame(rows, "company string, title string, location string, url string, source string, description string, posted_date string, parse_confidence double, native_id long") \
        .withColumn("first_seen", F.col("posted_date").cast("timestamp"))
    unique, metrics = deduplicate(df)
    row, m = unique.collect(), metrics.first()
    assert len(row) == 1 and row[0]["sources"] == ["indeed", "web"] and row[0]["description"] == "longer text"
    assert (m["total_raw"], m["total_normalized"], m["unique_jobs"], m["duplicates_removed"]) == (2, 2, 1, 1)


def test_import_equals_sequential(spark):
    rng = random.Random(5)
    rows = [(i, f"Firm {rng.randint(0, 20)}", f"https://f{rng.randint(0, 20)}.com") for i in range(200)]
    names, urls, want = {"firm 1"}, {"https://f2.com"}, set()
    for i, n, u in rows:
        if n.lower() not in names and u not in urls:
            want.add(i)
            names.add(n.lower())
            urls.add(u)
    df = spark.createDataFrame(rows, "row_id int, name string, career_url string")
    existing = spark.createDataFrame([("FIRM 1", "https://f2.com")], "name string, career_url string")
    got = {r["row_id"] for r in import_companies(df, existing, "row_id").where("outcome = 'added'").collect()}
    assert got == want


def test_containment(spark):
    needles, texts = ["a", "acme", "acme in", "zz", "corp"], ["acme india", "the corp", "a", "bb"]
    got = {(r["needle"], r["text"]) for r in containment_pairs(
        spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(x,) for x in texts], "text string")).collect()}
    assert got == {(n, x) for n in needles for x in texts if n in x}


def test_dedup_within_chains(spark):
    df = spark.createDataFrame([("k", s) for s in (0, 40, 70, 110, 200)], "k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r["s"] for r in dedup_within(df, ["k"], "ts", 60).collect()) == [0, 70, 200]
