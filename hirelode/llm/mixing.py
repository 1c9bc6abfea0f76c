"""Mixing sources to target weights by weighted random selection.

Sources share the total of all sizes by weight; a target stops at ``limit`` times
the size of its source and the excess is shared again by weight until none is
above.  A source then gives complete epochs first (every document that many
times) and fills the rest of its target with documents in the order of
exponential keys ``-ln(u) / w`` (Efraimidis-Spirakis: ``u`` from a hash of id and
seed, ``w`` the quality weight of the document): sizes are prefix-summed in that
order up to the budget, and the one document that fits the remaining gap best
closes it.

Nothing gathers a source in one task: sums by key range find the range in which
the budget ends, twice, and only rows of that narrow range are put in order.  The
decision is one cut per source, so rows are marked without a shuffle of texts
(sources up to a checked number are broadcast).

Defined results: null or empty texts have size 0 and are taken 0 words; a source
of size 0 has target 0; the null source comes last; a null id or weight takes
part with weight 1; rows with equal id and key are decided alike; an empty table
gives no rows; a re-run on the same rows gives the same mix; the added columns
replace columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelode.session import cut_lineage, with_global_rank

from .common import if_small, store_summary, unit_hash, word_count

WEIGHTS = (1, 2, 3)
LIMIT = 3
SEED = 17
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken")
RANGES = 1024  # key ranges of a level; two levels


def _shared(sources: DataFrame, limit: int) -> float:
    """Words for each unit of weight, so that capped targets add up to all words.

    ``sum(least(limit * size, w * share))`` is concave in ``share``: Newton steps
    from below are the rounds of sharing the excess again.
    """
    total = sources.agg(F.sum("size")).first()[0] or 0
    share = 0.0
    while True:
        capped = F.col("size") * limit <= F.col("weight") * F.lit(share)
        row = sources.agg(
            F.sum(F.when(capped, F.col("size") * limit)).alias("full"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            return share
        more = (total - (row["full"] or 0)) / row["open"]
        if more <= share * (1 + 1e-12):
            return share
        share = more


def _ending(sums: DataFrame, part: str) -> DataFrame:
    """Of each source, the first range whose running sum passes what is left, and the sum before it."""
    order = Window.partitionBy("__src").orderBy(part)
    return (
        sums.withColumn("__upto", F.sum("__words").over(order))
        .where(F.col("__upto") > F.col("__left"))
        .groupBy("__src").agg(F.min(F.struct(part, (F.col("__upto") - F.col("__words")).alias("__before"))).alias("__at"))
        .select("__src", F.col(f"__at.{part}").alias(f"{part}_end"), F.col("__at.__before").alias("__before")))


def prose_share(text: Column) -> Column:
    """Quality weight of a text: the square of its share of lower-case letters, spaces and plain punctuation."""
    plain = F.char_length(F.regexp_replace(text, r"[^\p{Ll}\s.,]+", "")) / F.greatest(F.char_length(text), F.lit(1))
    return F.coalesce((F.lit(0.1) + plain) * (F.lit(0.1) + plain), F.lit(1.0))


def plan_mix(docs: DataFrame, doc_weight: Column | None = None, size: Column | None = None, weights: tuple = WEIGHTS,
             limit: int = LIMIT, seed: int = SEED) -> DataFrame:
    """One row per source: size, target, epochs and the cut of its fractional epoch."""
    keyed = docs.select(*_keys(doc_weight, size, seed))
    if size is None:
        keyed = cut_lineage(keyed)                  # the texts are read once
    by_source = store_summary(keyed.groupBy("__src", "__null", "__name").agg(F.sum("__size").alias("size")))
    ranked = with_global_rank(by_source, F.col("__null"), F.col("__name"), F.col("__src"), name="__rank")
    named = store_summary(ranked.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("__rank") - 1) % len(weights) + 1).cast("int"))))
    share = _shared(named, limit)
    goal = store_summary(
        named.withColumn("target", F.least((F.col("size") * limit).cast("double"), F.col("weight") * F.lit(share)))
        .withColumn("epochs", F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0))
        .withColumn("__left", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("size")))
        .select("__src", "size", "target", "epochs", "__left"))
    open_ = if_small(goal.where(F.col("__left") > 0))
    coarse = _ending(
        keyed.groupBy("__src", "__wide").agg(F.sum("__size").alias("__words")).join(open_, "__src"), "__wide")
    coarse = if_small(store_summary(coarse))
    inside = keyed.join(coarse, "__src").where(F.col("__wide") == F.col("__wide_end"))
    fine = _ending(
        inside.groupBy("__src", "__thin").agg(F.sum("__size").alias("__words"), F.first("__before").alias("__base"))
        .join(open_, "__src").withColumn("__left", F.col("__left") - F.col("__base")), "__thin")
    fine = store_summary(coarse.withColumnRenamed("__before", "__base").join(fine, "__src").select(
        "__src", "__thin_end", (F.col("__base") + F.col("__before")).alias("__base")))
    fine = if_small(fine)
    # rows of one thin range, a millionth of the source: short enough to order
    units = (
        keyed.join(fine, "__src").where(F.col("__thin") == F.col("__thin_end"))
        .groupBy("__src", "__key", "__id").agg(F.sum("__size").alias("__words"), F.first("__base").alias("__base"))
        .join(open_, "__src")
        .withColumn("__upto", F.col("__base") + F.sum("__words").over(Window.partitionBy("__src").orderBy("__key", "__id"))))
    last = (
        units.where(F.col("__upto") <= F.col("__left"))
        .groupBy("__src").agg(F.max(F.struct("__key", "__id")).alias("__last"), F.max("__upto").alias("__used")))
    cut = store_summary(
        fine.join(last, "__src", "left").join(open_, "__src")
        .select("__src", "__thin_end", "__last", (F.col("__left") - F.coalesce("__used", "__base")).alias("__gap")))
    filler = (
        keyed.join(if_small(cut), "__src").where(~_chosen() & (F.col("__size") > 0))
        .groupBy("__src", "__gap")
        .agg(F.min(F.struct(F.abs(F.col("__size") - F.col("__gap")).alias("miss"), "__key", "__id")).alias("__best"))
        .where(F.col("__best.miss") < F.col("__gap"))
        .select("__src", F.struct("__best.__key", "__best.__id").alias("__filler")))
    return store_summary(goal.join(cut, "__src", "left").join(filler, "__src", "left").select(
        "__src", F.col("size").alias("__source_size"), F.col("target").alias("__target"), F.col("epochs").alias("__epochs"),
        "__thin_end", "__last", "__filler"))


def _keys(doc_weight: Column | None, size: Column | None, seed: int) -> list[Column]:
    source, doc_id = F.col("source").cast("string"), F.col("doc_id").cast("string")
    weight = F.lit(1.0) if doc_weight is None else F.coalesce(doc_weight.cast("double"), F.lit(1.0))
    key = -F.log(unit_hash(doc_id, F.lit(seed))) / F.greatest(weight, F.lit(1e-6))
    spread = F.least(F.lit(1.0) - F.exp(-key), F.lit(1.0 - 2.0**-30))    # rises with the key, within [0, 1)
    return [
        F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source)).alias("__src"),
        source.isNull().alias("__null"), source.alias("__name"), F.coalesce(doc_id, F.lit("")).alias("__id"),
        (word_count(F.col("text")) if size is None else size.cast("long")).alias("__size"), key.alias("__key"),
        F.floor(spread * RANGES).alias("__wide"), F.floor(spread * (RANGES * RANGES)).alias("__thin")]


def _chosen() -> Column:
    """The row lies before the cut of its source."""
    before = (F.col("__thin") < F.col("__thin_end")) | (
        (F.col("__thin") == F.col("__thin_end")) & (F.struct("__key", "__id") <= F.col("__last")))
    return F.coalesce(before, F.lit(False))


def mix(docs: DataFrame, doc_weight: Column | None = None, size: Column | None = None, weights: tuple = WEIGHTS,
        limit: int = LIMIT, seed: int = SEED) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target``, ``mix_copies`` and ``mix_taken``."""
    plan = plan_mix(docs, doc_weight, size, weights, limit, seed)
    marked = docs.select("*", *_keys(doc_weight, size, seed)).join(if_small(plan), "__src")
    filler = F.coalesce(F.struct("__key", "__id") == F.col("__filler"), F.lit(False))
    copies = F.col("__epochs") + F.when(_chosen() | filler, 1).otherwise(0)
    return marked.select(
        *[c for c in docs.columns if c not in ADDED], F.col("__size").alias("mix_size"), F.col("__source_size").alias("mix_source_size"),
        F.col("__target").alias("mix_target"), copies.cast("long").alias("mix_copies"),
        (copies * F.col("__size")).cast("long").alias("mix_taken"))


def mixed_rows(docs: DataFrame, doc_weight: Column | None = None, **options) -> DataFrame:
    """The mixed corpus itself: every row as often as the mix takes it."""
    taken = mix(docs, doc_weight, **options).where(F.col("mix_copies") > 0)
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select(
        *[c for c in docs.columns if c not in ADDED])
