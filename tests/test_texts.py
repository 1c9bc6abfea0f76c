"""Descriptions travel by their marks, and work on texts is done once for each."""

from pyspark.sql import functions as F

from hirelode.operators import dedup as D
from hirelode.operators import sets as U
from hirelode.operators import sinks as K
from hirelode.operators.texts import bring_texts, leave_texts, once_each

ROWS = [(1, "a", "x", "long text"), (2, "a", "y", None), (3, "b", "x", "long text"), (4, "b", None, ""), (5, None, "x", "other")]


def frame(spark):
    return spark.createDataFrame(ROWS, "native_id long, company string, title string, description string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_leave_and_come_back(spark):
    df = frame(spark)
    rows, texts = leave_texts(df)
    assert "description" not in rows.columns and texts.count() == 3
    back = bring_texts(rows, texts, df.columns)
    assert back.columns == df.columns
    assert sorted(back.collect(), key=lambda r: r["native_id"]) == df.collect()


def test_picked_rows_keep_their_text_but_do_not_carry_it(spark):
    picked = U.first_by(frame(spark), ["company"], ["native_id"])
    assert sorted((r["native_id"], r["description"]) for r in picked.collect()) == [(1, "long text"), (3, "long text"), (5, "other")]
    unread = plan(picked.select("company", "native_id"))
    assert "description, description" not in plan(picked) and "Join" not in unread


def test_merged_clusters_do_not_carry_texts(spark):
    made = spark.sql("""SELECT id AS native_id, 'c' AS id, 'web' AS source, array('web') AS sources, map('web', cast(id AS string)) AS source_ids, 0.5D AS parse_confidence,
        timestamp'2024-01-01' AS first_seen, timestamp'2024-01-01' AS posted_date, repeat('z', cast(id AS int)) AS description FROM range(1, 4)""")
    merged = D.merge_cluster(made)
    assert merged.first()["description"] == "zzz"
    assert "description, description" not in plan(merged)
    assert "Join" not in plan(merged.select("id", "cluster_size"))


def test_merging_the_store_leaves_out_what_nobody_reads(spark):
    store = frame(spark).withColumns({"id": F.col("native_id").cast("string"), "score": F.lit(1), "tier": F.lit(6), "profile_version": F.lit("v1")})
    inc = store.where("native_id > 3").withColumn("title", F.lit("new"))
    merged = K.merge_store(store, inc)
    assert sorted((r["native_id"], r["title"], r["description"]) for r in merged.collect())[3:] == [(4, "new", ""), (5, "new", "other")]
    assert "description" not in plan(merged.select("id", "title")).replace("parse", "").split("Join")[0]


def test_work_on_equal_values_is_done_once(spark):
    done = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            done.add(b.num_rows)
            yield b

    df = frame(spark)
    many = df.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(50))))

    def compute(values):
        passed = values.mapInArrow(seen, values.schema)
        return passed.withColumn("size", F.coalesce(F.length("description"), F.lit(-1)))

    for texts in (None, leave_texts(many)[1]):
        done.value = 0
        rows = many if texts is None else leave_texts(many)[0]
        out = once_each(rows, ["title", "description"], compute, texts)
        assert sorted({(r["native_id"], r["size"]) for r in out.collect()}) == [(1, 9), (2, -1), (3, 9), (4, 0), (5, 5)]
        assert out.count() == 250 and done.value <= 4 * 2


def test_written_store_holds_each_text_once(spark, tmp_path):
    path = str(tmp_path / "store")
    df = frame(spark).withColumn("posted_date", F.timestamp_seconds(F.col("native_id") * 3_000_000))
    K.write_store(df, path)
    K.write_store(df.where("native_id = 5").withColumn("title", F.lit("again")), path)
    assert "description" not in spark.read.parquet(path).columns
    assert spark.read.parquet(f"{path}-texts").count() == 3
    back = {r["native_id"]: (r["title"], r["description"]) for r in K.read_written(spark, path).collect()}
    assert back == {1: ("x", "long text"), 2: ("y", None), 3: ("x", "long text"), 4: (None, ""), 5: ("again", "other")}


def test_ingest_writes_each_text_once(spark, tmp_path, tables):
    from hirelode.operators.scoring import Profile
    from hirelode.streaming import jobs as ST
    job = ST.IngestJob(ST.Ledger(spark, str(tmp_path)), ST.IngestConfig(Profile(["Python"], 1, "v2"), "1999-06-15 00:00:00", 0, hours=24 * 4000))
    landed = tables.postings.where("native_id < 60")
    job.publish(landed.where("native_id < 30"), 0)
    job.publish(landed, 1)
    assert "description" not in spark.read.parquet(f"{tmp_path}/store/version=1").columns
    texts = spark.read.parquet(f"{tmp_path}/texts/batch=*")
    assert texts.count() == texts.distinct().count()
    posted = {(r["native_id"], r["description"]) for r in landed.collect()}
    assert {(r["native_id"], r["description"]) for r in job.table("store").collect()} <= posted
