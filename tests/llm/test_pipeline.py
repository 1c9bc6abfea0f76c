import random

from pyspark.sql import functions as F

import corpus_pipeline
from hirelode.llm import decontaminate, jaccard, mixing, quality, queries

from .helpers import DOCS, awkward, empty

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels, items = spark.read.parquet(f"{FOLDER}/labels.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == docs.columns + ["slot", "shard"]
    score = quality.score(docs, quality.learn(docs, labels), keep=["doc_id"])
    kept = docs.join(score.where(F.col("quality_score") >= quality.ACCEPT).select("doc_id"), "doc_id").select(*docs.columns)
    same = {r["doc_id"] for r in jaccard.join(kept).where("doc_id = component_id").collect()}
    leaky = {r["doc_id"] for r in decontaminate.leaks(docs, items).collect()}
    last = docs.where(F.col("doc_id").isin(sorted(same - leaky)))
    expected = {r["doc_id"]: r["mix_copies"] for r in mixing.mix(last, mixing.prose_share(F.col("text"))).collect() if r["mix_copies"]}
    assert {r["doc_id"]: r["count"] for r in got.groupBy("doc_id").count().collect()} == expected
    assert len(same) < kept.count() < docs.count() and leaky


def test_stages_take_awkward_and_empty_tables(spark):
    for docs in (awkward(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            assert out.columns[:len(docs.columns) - 1] == [c for c in docs.columns if c != "slot"] or out.columns == docs.columns, name
            out.count()


def test_near_copies_go_by_five_words_at_four_fifths(spark):
    rng = random.Random(4)
    texts = {}
    for words, changed in ((500, 11), (200, 4), (1000, 21), (200, 6), (500, 40)):
        text = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        copy = list(text)
        for i in range(changed):                                     # scattered: no two changes share a shingle
            copy[(i + 1) * words // (changed + 1)] = f"x{rng.randrange(10**6)}"
        block = [f"y{rng.randrange(10**6)}" for _ in range(words // 5)]
        for t in (text, copy, text + block, text + block + block):
            texts[len(texts) + 1] = t
    sets = {d: {tuple(t[i:i + 5]) for i in range(len(t) - 4)} for d, t in texts.items()}
    root = {d: d for d in sets}
    for a in sets:
        for b in range(1, a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {d: min(x, y) if r in (x, y) else r for d, r in root.items()}
    docs = spark.createDataFrame([(d, " ".join(t), "en", "a", 0, "x", 1) for d, t in texts.items()], DOCS)
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, FOLDER).collect()}
    assert got == {d for d, r in root.items() if d == r}
    assert len({1, 2, 5, 6, 9, 10} & got) == 3 and len(got) > 5


def test_every_operator_has_a_query():
    assert [f"op{n}_" for n in range(1, 11)] == [next(q for q in sorted(queries.QUERIES) if q.startswith(f"op{n}_"))[:len(f"op{n}_")] for n in range(1, 11)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_stages_bound_their_batches(spark):
    """What is handed to a Python worker at a time is bounded in bytes, so that workers stay small on long texts."""
    import pyarrow as pa

    from hirelode.session import BATCH_BYTES

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    few = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(20)
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.near_duplicate_stage, corpus_pipeline.decontamination_stage):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, few, FOLDER)
        # one more text of at most 20,000 words may follow the last byte counted
        assert docs.select("text").mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 2 * BATCH_BYTES
