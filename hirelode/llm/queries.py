"""One registered query for each corpus operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelode.session import cut_lineage

from . import covering, decontaminate, html_text, jaccard, language, line_dedup, mixing, neighbours, periodic, pii, quality, sharding, whitening
from .common import held_out, table, word_count

QUERIES = {}
ORACLES = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = cut_lineage(table(spark, sf_dir, "documents").select(
        "doc_id", "source", word_count(F.col("text")).alias("words"), mixing.prose_share(F.col("text")).alias("weight")))
    return mixing.mix(docs, F.col("weight"), F.col("words")).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


@register
def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id"))


ORACLES["op7_shard"] = sharding.ORACLE


@register
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, "score", keep=["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= quality.ACCEPT, 1).otherwise(0).cast("int").alias("predicted"))


@register
def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


@register
def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.predict(docs, language.learn(docs), keep=["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@register
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.train(pii.labelled_lines(docs)))


@register
def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@register
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.summary(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join("dropped", ",").alias("dropped"))


@register
def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = whitening.whiten(vectors, whitening.fit(vectors), ["vec_id"])
    return found.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


@register
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find(periodic.plant(table(spark, sf_dir, "documents")), ["doc_id"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = F.col("best")
    return found.select("doc_id", "runs", "collapsed", periodic.strongest("runs").alias("best")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@register
def op13_covering_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covering.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", covering.as_hex("fingerprint").alias("fingerprint"), "component_id")
