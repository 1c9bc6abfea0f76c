"""What large tables need: little on disk, little shuffled, the same rows."""

import json
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from hirelode.catalog.cycles import deliver
from hirelode.functions import fields as V
from hirelode.operators import filters as P
from hirelode.operators import sinks as K
from hirelode.operators.dedup import deduplicate
from hirelode.operators.identity import normalize_postings
from hirelode.operators.scoring import Profile, score_local
from hirelode.plans.feed import FeedConfig, build_feed
from hirelode.session import set_aside
from hirelode.sources import markup


def bytes_below(path):
    return sum(f.stat().st_size for f in path.rglob("part-*"))


def test_exported_texts_are_packed(spark, tmp_path):
    rows = spark.range(2000).select("id", F.repeat(F.lit("Python and SQL. "), 200).alias("description"), F.lit(None).cast("int").alias("score"))
    K.export_bundle({"curated": rows}, f"file://{tmp_path}")
    assert bytes_below(tmp_path) < 2000 * 200
    back = spark.read.schema(rows.schema).json(f"file://{tmp_path}/curated")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert json.loads(spark.read.text(f"file://{tmp_path}/curated").where("value LIKE '{\"id\":7,%'").first()[0])["id"] == 7


FAR = "Nothing to count in this sentence, and nothing in that one. " * 20


@pytest.mark.parametrize("text,years", [
    (f"{FAR}minimum{' ' * 300}4 years", 4), (f"experience required{' ' * 90}:{' ' * 90}3 yrs {FAR}", 3), (f"8{' ' * 200}to{' ' * 200}9{' ' * 50}+ years", 8),
    (f"7 years of{' industry' * 60} experience. {FAR}", 7), (f"7 years of{' industry' * 60}. {FAR}experience", None), (f"must have {FAR}6 years", None),
    (f"12-15 years. {FAR}2+ years. {FAR}at least of 9 yrs", 2), (f"{FAR}3 {FAR}years", None), ("٣ years experience", None), ("", None), (None, None)])
def test_only_what_is_near_a_number_decides_the_years(spark, text, years):
    assert spark.range(1).select(V.min_experience_years(F.lit(text).cast("string"))).first()[0] == years


def test_long_texts_are_cut_before_the_patterns(spark):
    left = F.regexp_replace(F.lit(f"Minimum 4 years. {FAR * 30}"), F.lit(V._far_from_numbers()), F.lit("$1;"))
    assert spark.range(1).select(left).first()[0] == "Minimum 4 years;"


def test_years_do_not_shuffle_texts(spark):
    rows = spark.createDataFrame([(1, "Dev", "3-5 years"), (1, None, "2+ yrs"), (None, "Dev", None)], "native_id int, title string, description string")
    plan = P.stated_years(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert [r["min_years"] for r in P.stated_years(rows).collect()] == [3, 2, None]


def postings(spark, n=60):
    return spark.range(n).select(
        F.when(F.col("id") % 7 != 6, F.col("id")).alias("native_id"), F.concat(F.lit("https://a.example.com/job/"), (F.col("id") % 20).cast("string")).alias("url"),
        F.when(F.col("id") % 11 != 3, F.concat(F.lit("Firm "), (F.col("id") % 3).cast("string"))).alias("company"), F.lit("Software Engineer").alias("title"), F.lit("Remote").alias("location"),
        F.when(F.col("id") % 5 != 4, F.concat(F.lit("Python and Docker, 2+ years. "), (F.col("id") % 2).cast("string"))).alias("description"),
        F.lit("2024-01-01").alias("posted_date"), F.lit("2024-01-02").cast("timestamp").alias("first_seen"), F.lit("web").alias("source"), F.lit(0.5).alias("parse_confidence"),
        F.lit(70).alias("score"), F.lit(1).alias("tier"), F.lit("v2").alias("profile_version"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_unique_postings_are_set_aside_packed(spark):
    unique, metrics = deduplicate(postings(spark))
    assert "ExistingRDD" not in plan_of(unique)
    names = normalize_postings(postings(spark)).columns
    assert unique.columns[:len(names)] == names
    assert unique.count() == metrics.first()["unique_jobs"] and metrics.first()["total_raw"] == 60


def test_feed_marks_rows_before_their_texts_come(spark):
    ids = normalize_postings(postings(spark)).where("native_id % 4 = 0").select("id", F.lit("applied").alias("status"))
    feed = build_feed(postings(spark), FeedConfig(now="2024-01-31", experience=["0-2 years"]), applied=ids, closed=ids.limit(1))
    plan = feed.flagged._jdf.queryExecution().optimizedPlan().toString()
    # the join that brings the texts is above the joins by id
    joins = [line for line in plan.splitlines() if "Join LeftOuter" in line]
    assert "description_mark" in min(joins, key=lambda line: line.index("Join"))
    assert feed.flagged.columns[0] == "id" and len(set(feed.flagged.columns)) == len(feed.flagged.columns) and "description" in feed.flagged.columns
    assert feed.flagged.where("description IS NOT NULL").count() > 0


def test_void_columns_can_be_set_aside(spark):
    df = spark.range(3).withColumn("nothing", F.lit(None))
    assert sorted(map(tuple, set_aside(df).collect())) == [(0, None), (1, None), (2, None)]


def test_scores_shuffle_no_title_with_its_text(spark):
    scored = score_local(postings(spark), Profile(["Python"], 1))
    assert not re.search(r"hashpartitioning\(title#\d+, description#", plan_of(scored))
    brute = {(r["title"], r["description"]): r["local_score"] for r in score_local(postings(spark).select("title", "description").distinct(), Profile(["Python"], 1)).collect()}
    rows = scored.collect()
    assert len(rows) == 60 and all(brute[r["title"], r["description"]] == r["local_score"] for r in rows)


def test_deliveries_work_a_table_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    df = spark.range(40).select(counted("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 7200).alias("at"))
    folder = SimpleNamespace(spark=spark)
    landed = []
    stream = deliver(folder, df, "at", "event_id", landed.append)
    assert len(landed) == 5 and stream.isStreaming and seen.value <= 80


PAGES = ['<div class="job-card opening"><h3>Engineer</h3><span class="loc">Pune</span><a href="/j">Apply</a></div>', '<LI class=job><b>Dev &amp; Ops</b></LI>',
         '<article class="job posting"><h2>Analyst</h2></article></p><div data-job-id="4" class="aJobCard"><a href="x">Designer</a><br>text', "<script><li class='job'></script>", "", "a < b",
         '<title><div class="job-item"></title>', '<div class="opening" class="job-tile"><tr class="job-row"><strong>Lead</strong>', '<!-- <div class="job"> --><li class="job">x</li>']


def tree(node):
    return node if isinstance(node, str) else (node.tag, node.attrs, [tree(c) for c in node.children])


@pytest.mark.parametrize("page", PAGES)
def test_plain_markup_and_cards_are_read_as_before(page):
    builder = markup._Builder()
    builder.feed(page)
    builder.close()
    assert tree(markup.parse(page)) == tree(builder.root)
    every = {i: markup.select(builder.root, s) for i, s in enumerate(markup.CARD_SELECTORS)}
    assert {i: list(map(tree, n)) for i, n in every.items() if n} == {i: list(map(tree, n)) for i, n in markup._found_cards(markup.parse(page)).items()}


def test_plain_pages_do_not_need_the_slow_parser(monkeypatch):
    monkeypatch.setattr(markup, "_Builder", None)
    assert len(markup._found_cards(markup.parse(PAGES[0]))) == 2
