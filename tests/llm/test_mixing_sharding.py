from collections import Counter
from math import isclose

from pyspark.sql import functions as F

from hirelode.llm import mixing, sharding

from .helpers import awkward, empty


def targets(sizes: dict, weights=(1, 2, 3), limit=3):
    """The stated rule, step by step."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = [s for s in open_ if share[s] > limit * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: float(limit * sizes[s]) for s in above}


def test_targets_and_budgets(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 13)), "s%d" % (0 if i % 3 else i % 11)) for i in range(3000)] + [(9000 + i, "tiny text", None) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, mixing.prose_share(F.col("text"))).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    expected = targets(sizes)
    taken = Counter()
    for r in got:
        assert r["mix_size"] == len(r["text"].split()) and r["mix_source_size"] == sizes[r["source"]]
        assert isclose(r["mix_target"], expected[r["source"]], rel_tol=1e-9)
        assert r["mix_taken"] == r["mix_copies"] * r["mix_size"] <= 3 * r["mix_size"]
        taken[r["source"]] += r["mix_taken"]
    assert len(got) == len(rows)
    assert all(abs(taken[s] - expected[s]) <= 13 for s in sizes)
    again = mixing.mix(docs.repartition(7), mixing.prose_share(F.col("text"))).collect()
    assert {(r["doc_id"], r["mix_taken"]) for r in again} == {(r["doc_id"], r["mix_taken"]) for r in got}


def test_selection_follows_exponential_keys(spark):
    docs = spark.createDataFrame([(i, "a b", "s") for i in range(400)] + [(i, "a b", "t") for i in range(400, 500)], "doc_id long, text string, source string")
    got = mixing.mix(docs, weights=(1, 1))
    plain = docs.select("doc_id", "source", *mixing._keys(None, None, mixing.SEED)).join(got.select("doc_id", "mix_copies"), "doc_id").collect()
    for source in "st":
        copies = [r["mix_copies"] for r in sorted((r for r in plain if r["source"] == source), key=lambda r: (r["__key"], r["__id"]))]
        assert copies == sorted(copies, reverse=True)           # complete epochs for all, the rest for the first keys


def test_mix_awkward_rows(spark):
    docs = awkward(spark).withColumn("mix_size", F.lit("mine"))
    got = mixing.mix(docs)
    rows = got.collect()
    assert len(rows) == 9 - 1 and got.columns[-5:] == list(mixing.ADDED)
    assert all(r["mix_taken"] == 0 for r in rows if not (r["text"] or "").split())
    repeated = {r["mix_taken"] for r in rows if r["doc_id"] == 1}
    assert len(repeated) == 1
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mixed_rows(docs).columns == [c for c in docs.columns if c != "mix_size"]
    assert mixing.mixed_rows(docs).count() == sum(r["mix_copies"] for r in rows)


def test_slots_are_shared_out_in_turns():
    table = sharding.fill_slots(["a", "b", "c"], 101)
    assert sorted(Counter(table).values()) == [33, 34, 34]
    fewer = sharding.fill_slots(["a", "b"], 101)
    moved = sum(x != y for x, y in zip(table, fewer, strict=True) if x != 2)
    assert moved < 40                                            # slots of the shards that stay mostly stay


def test_bad_shard_tables():
    for names, slots in ((["a", "a"], 7), (["a"], 8), ([], 7)):
        try:
            sharding.fill_slots(names, slots)
        except ValueError:
            continue
        raise AssertionError((names, slots))


def test_shards_of_awkward_rows(spark):
    docs = awkward(spark)
    got = sharding.assign_shards(docs)
    assert got.columns == [c for c in docs.columns if c != "slot"] + ["slot", "shard"] and got.count() == docs.count()
    assert got.where("doc_id = 1").select("shard").distinct().count() == 1
    assert sharding.assign_shards(empty(spark)).count() == 0
    many = sharding.assign_shards(spark.range(32000).withColumnRenamed("id", "doc_id")).groupBy("shard").count().collect()
    assert len(many) == 32 and all(850 < r["count"] < 1150 for r in many)
