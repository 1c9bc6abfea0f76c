"""Near-duplicate clustering: first-fit against cluster heads, as sparse joins.

The match rule looks only at (company, title, location, requisition), so rows
are first folded to distinct combinations.  Candidate pairs of names, titles
and locations come from two lossless filters (prefixes of rare words, prefixes of
rare letter grams), never from all pairs of a block.
"""

from __future__ import annotations

from collections import defaultdict
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import rules
from ..session import cut_lineage, set_aside
from .components import components

BLOCK_LETTERS = 4
ROUNDS = 20              # of first fit, before connected parts are settled whole
PART_EDGES = 200_000     # most edges of such a part
COMPANY_RATIO, LOCATION_RATIO, TITLE_RATIO = 0.85, 0.80, 0.85


@F.pandas_udf(DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts."""
    return pd.Series([
        None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)],
        dtype="float64")


def length_bound(a: Column, b: Column) -> Column:
    """Upper bound of seq_ratio from lengths alone."""
    return 2.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))


def letter_bound(a: Column, b: Column) -> Column:
    """Upper bound of seq_ratio from shared letter counts."""
    letters = F.array_union(F.split(a, ""), F.split(b, ""))
    shared = F.aggregate(
        letters, F.lit(0), lambda acc, c: acc + F.when(c == "", 0).otherwise(F.least(
            F.length(a) - F.length(F.replace(a, c, F.lit(""))), F.length(b) - F.length(F.replace(b, c, F.lit(""))))))
    return 2.0 * shared / (F.length(a) + F.length(b))


GRAM = 2           # letters of a gram
SHORT = 6          # texts of so few letters may reach a ratio without sharing a gram; they meet by letters


def _apart(own: Column, other: Column, ratio: float) -> Column:
    """Most letters of a text of length ``own`` without a partner in one of length ``other``.

    At the ratio all unmatched letters are at most (1 - ratio) of both lengths, and the
    lengths tell how they divide over the two texts.
    """
    return F.floor((F.floor((own + other) * (1.0 - ratio) + 1e-9) + own - other) / 2).cast("int")


def _lost(own: Column, other: Column, ratio: float) -> Column:
    """Most different grams of a text that unmatched letters of both can break."""
    return GRAM * _apart(own, other, ratio) + (GRAM - 1) * _apart(other, own, ratio)


def gram_pairs(values: DataFrame, ratio: float) -> DataFrame:
    """Pairs (block, a, b), a <> b, a no longer than b, that can reach the ratio.

    Texts at the ratio keep all but ``_lost`` of their grams, so with the grams of every
    text in one order, rarest of the block first, the rarest gram they keep is among the
    first ``_lost + 1`` of either, at places no further apart than the unmatched letters.
    Only these prefixes meet, in bands of like length.
    """
    reach = (2.0 - ratio) / ratio
    v = values.select("block", "s", F.length("s").alias("n")).where("n > 0")
    places = F.transform(F.sequence(F.lit(1), F.col("n") - GRAM + 1), lambda i: F.struct(F.col("s").substr(i, F.lit(GRAM)).alias("gram"), i.alias("at")))
    grams = v.where(F.col("n") >= GRAM).select("block", "s", "n", F.inline(places)).groupBy("block", "s", "n", "gram").agg(F.collect_list("at").alias("at"))
    often = grams.groupBy("block", "gram").agg(F.count(F.lit(1)).alias("df"))
    ordered = grams.join(often, ["block", "gram"]).groupBy("block", "s", "n").agg(F.array_sort(F.collect_list(F.struct("df", "gram", "at"))).alias("g"))
    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(F.col("n") / reach - 1e-9).cast("int")), F.floor(F.col("n") * reach + 1e-9).cast("int"))
    most = F.array_max(F.transform(lengths, lambda m: _lost(F.col("n"), m, ratio))) + 1
    prefix = ordered.select("block", "s", "n", F.posexplode(F.slice("g", F.lit(1), most)).alias("rank", "p")).select(
        "block", "s", "n", "rank", F.col("p.gram").alias("gram"), F.col("p.at").alias("at"))
    letters = v.where(F.col("n") <= SHORT).select(
        "block", "s", "n", F.lit(-1).alias("rank"), F.explode(F.array_distinct(F.split("s", ""))).alias("gram"), F.array(F.lit(0)).alias("at")).where("gram <> ''")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(reach)) + 1e-9).cast("int")
    entries = set_aside(prefix.unionByName(letters).withColumn("band", band))
    left = entries.select("block", "gram", "band", F.col("s").alias("a"), F.col("n").alias("na"), F.col("rank").alias("ra"), F.col("at").alias("pa"))
    right = entries.withColumn("band", F.explode(F.array("band", F.col("band") - 1))).select(
        "block", "gram", "band", F.col("s").alias("b"), F.col("n").alias("nb"), F.col("rank").alias("rb"), F.col("at").alias("pb"))
    na, nb = F.col("na"), F.col("nb")
    shift = F.greatest(_apart(na, nb, ratio), _apart(nb, na, ratio))
    close = (F.col("ra") < 0) | F.exists("pa", lambda x: F.exists("pb", lambda y: F.abs(x - y) <= shift))
    met = left.join(right, ["block", "gram", "band"]).where((na < nb) | ((na == nb) & (F.col("a") < F.col("b")))).where(
        (_apart(na, nb, ratio) >= 0) & (F.col("ra") <= _lost(na, nb, ratio)) & (F.col("rb") <= _lost(nb, na, ratio)) & ((F.col("ra") < 0) == (F.col("rb") < 0)) & close)
    return met.select("block", "a", "b").distinct()


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("block", "a", "b").unionByName(
        pairs.select("block", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def similar_values(values: DataFrame, ratio: float, inclusive: bool) -> DataFrame:
    """Ordered pairs (block, a, b), a <> b, whose seq_ratio(a, b) passes the ratio."""
    bound = F.least(length_bound(F.col("a"), F.col("b")), letter_bound(F.col("a"), F.col("b")))
    candidates = set_aside(gram_pairs(values, ratio).where(bound >= ratio - 1e-9))
    scored = _both_ways(candidates).withColumn("r", seq_ratio("a", "b"))
    return scored.where(F.col("r") >= ratio if inclusive else F.col("r") > ratio).select("block", "a", "b")


def _seniority(words: Column) -> Column:
    return F.array_sort(F.array_intersect(words, F.array(*[F.lit(w) for w in rules.SENIORITY_TOKENS])))


def seniority_mismatch(a: Column, b: Column) -> Column:
    """U4: the two titles name different seniority words."""
    return _seniority(F.array_distinct(F.split(a, " "))) != _seniority(F.array_distinct(F.split(b, " ")))


def word_pairs(values: DataFrame) -> DataFrame:
    """Title pairs (block, a, b) by shared words: >= 3/4 of the larger set, or
    >= 85 % of the smaller one and at least two words.

    Either rule needs three quarters of the smaller set, so one of its
    rarest ``n - ceil(0.75 n) + 1`` words must occur in the larger one.
    """
    v = values.withColumn("w", F.array_distinct(F.split("s", " "))).withColumn("n", F.size("w"))
    each = v.select("block", "s", "n", F.explode("w").alias("word"))
    counts = each.groupBy("block", "word").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(counts, ["block", "word"]).groupBy("block", "s", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "word"))).alias("by_rarity"))
    probe = ranked.where("n >= 2").select(
        "block", F.col("s").alias("small"), F.col("n").alias("small_n"),
        F.explode(F.slice("by_rarity", F.lit(1), (F.col("n") - F.ceil(F.col("n") * 0.75) + 1).cast("int"))).alias("p")) \
        .select("block", "small", "small_n", F.col("p.word").alias("word"))
    pairs = probe.join(each.select("block", "word", F.col("s").alias("big"), F.col("n").alias("big_n")), ["block", "word"]) \
        .where("big_n >= small_n AND small <> big").select("block", F.col("small").alias("a"), F.col("big").alias("b")).distinct()
    wa, wb = F.array_distinct(F.split("a", " ")), F.array_distinct(F.split("b", " "))
    shared = F.size(F.array_intersect(wa, wb))
    small, large = F.least(F.size(wa), F.size(wb)), F.greatest(F.size(wa), F.size(wb))
    return pairs.where((shared >= 0.75 * large) | ((shared >= 0.85 * small) & (shared >= 2)))


def matching_titles(values: DataFrame, by_letters: bool = True) -> DataFrame:
    """Ordered title pairs that count as the same title, identical ones included.

    Titles that name different seniority words never match, so those words part a block.
    """
    parted = values.withColumn("block", F.concat_ws("\u0001", "block", F.array_join(_seniority(F.array_distinct(F.split("s", " "))), " ")))
    different = _both_ways(word_pairs(parted))
    if by_letters:
        different = different.unionByName(similar_values(parted, TITLE_RATIO, inclusive=True)).distinct()
    return different.withColumn("block", F.substring_index("block", "\u0001", 1)).unionByName(
        values.select("block", F.col("s").alias("a"), F.col("s").alias("b")))


def matching_names(values: DataFrame, ratio: float) -> DataFrame:
    """Ordered pairs of names above the ratio, identical ones included.

    "Both remote" needs no rule of its own: cleaning maps such places to one word.
    """
    same = values.select("block", F.col("s").alias("a"), F.col("s").alias("b"))
    return similar_values(values, ratio, inclusive=False).unionByName(same)


def fold(df: DataFrame) -> DataFrame:
    """Distinct match keys with the first position at which each occurs.

    Rows with equal keys always end in one cluster: what the first of them
    matches, the others match, and no earlier head can appear in between.
    """
    return df.groupBy(
        F.left("normalized_company", F.lit(BLOCK_LETTERS)).alias("block"), F.col("normalized_company").alias("company"),
        F.col("normalized_title").alias("title"), F.col("normalized_location").alias("location"),
        F.coalesce("req_id", F.lit("")).alias("req"),
    ).agg(F.min(F.struct("first_seen", "id")).alias("ord")) \
        .withColumn("key", F.sha2(F.concat_ws("\u0001", "company", "title", "location", "req"), 256))


def near_dup_pairs(df: DataFrame) -> DataFrame:
    """(later, earlier) pairs of folded keys that match.

    The three dictionaries of matching companies, titles and locations are
    built from distinct values; the keys then meet by equality alone.
    """
    return key_pairs(cut_lineage(fold(df)))


def key_pairs(keys: DataFrame, by_letters: bool = True) -> DataFrame:
    """J10 over folded keys; they are read several times and should be materialised.

    Without ``by_letters`` names are equal or not, and titles match by their words alone.
    """
    def values(name: str) -> DataFrame:
        return keys.select("block", F.col(name).alias("s")).distinct()

    def names(name: str, ratio: float) -> DataFrame:
        found = values(name)
        return matching_names(found, ratio) if by_letters else found.select("block", F.col("s").alias("a"), F.col("s").alias("b"))

    # each dictionary is a small table of its own, so no plan holds the work of all three
    companies, places = cut_lineage(names("company", COMPANY_RATIO)), cut_lineage(names("location", LOCATION_RATIO))
    titles = cut_lineage(matching_titles(values("title"), by_letters))
    late = keys.select("block", "company", "title", "location", "req", F.col("key").alias("later"), F.col("ord").alias("later_ord"))
    # a requisition meets itself and the empty one; the empty one meets all
    late = late.withColumn("req_side", F.explode(F.when(
        F.col("req") == "", F.array(F.lit("*"))).otherwise(F.array(F.col("req"), F.lit("")))))
    early = keys.select(
        F.col("block"), F.col("company").alias("company2"), F.col("title").alias("title2"),
        F.col("location").alias("location2"), F.col("key").alias("earlier"), F.col("ord").alias("earlier_ord"),
        F.explode(F.array("req", F.lit("*"))).alias("req_side"))
    return (
        late
        .join(companies.select("block", F.col("a").alias("company"), F.col("b").alias("company2")), ["block", "company"])
        .join(titles.select("block", F.col("a").alias("title"), F.col("b").alias("title2")), ["block", "title"])
        .join(places.select("block", F.col("a").alias("location"), F.col("b").alias("location2")), ["block", "location"])
        .join(early, ["block", "company2", "title2", "location2", "req_side"])
        .where("earlier_ord < later_ord")
        .select("later", "earlier", "later_ord", "earlier_ord"))


def _settle(part: pd.DataFrame) -> pd.DataFrame:
    """The heads among the keys of one connected part: keys in turn, each after all its earlier ones."""
    before, after = defaultdict(list), defaultdict(list)
    for later, earlier in zip(part["later"], part["earlier"]):
        before[later].append(earlier)
        after[earlier].append(later)
    missing = {key: len(found) for key, found in before.items()}
    ready, heads = [key for key in after if key not in before], set()
    while ready:
        key = ready.pop()
        if not any(earlier in heads for earlier in before.get(key, ())):
            heads.add(key)
        for later in after.get(key, ()):
            missing[later] -= 1
            if not missing[later]:
                ready.append(later)
    return pd.DataFrame({"earlier": sorted(heads)}, dtype=object)


def _settle_parts(open_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads of the connected parts of at most ``PART_EDGES`` open edges, edges of the others)."""
    roots = cut_lineage(components(open_edges, "later", "earlier"))
    placed = cut_lineage(open_edges.join(roots.select(F.col("node").alias("later"), "root"), "later"))
    large = cut_lineage(placed.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART_EDGES).select("root"))
    small = placed.join(large, "root", "left_anti")
    return (cut_lineage(small.groupBy("root").applyInPandas(lambda part: _settle(part), "earlier string")),
            cut_lineage(placed.join(large, "root", "left_semi").select("later", "earlier")))


def first_fit(edges: DataFrame) -> DataFrame:
    """(member, head) by first fit: a key is a head when no earlier head matches it.

    Rounds over the undecided edges only; every round is a checkpoint and settles at
    least one key.  Rounds follow the longest chain of keys, so after ``ROUNDS`` of them
    (and twice as many each time after) connected parts of bounded size are settled
    whole; only longer ones need more rounds.
    """
    edges = set_aside(edges)
    open_edges = edges.select("later", "earlier").distinct()
    heads = None
    done, due = 0, ROUNDS
    while not open_edges.isEmpty():
        if done == due:
            new_heads, open_edges = _settle_parts(open_edges)
            heads = new_heads if heads is None else cut_lineage(heads.unionByName(new_heads))
            due *= 2
            continue
        waiting = open_edges.select(F.col("later").alias("earlier")).distinct()
        new_heads = open_edges.select("earlier").distinct().join(waiting, "earlier", "left_anti")
        members = open_edges.join(new_heads, "earlier", "left_semi").select("later").distinct()
        new_heads = cut_lineage(new_heads)
        members = cut_lineage(members)
        heads = new_heads if heads is None else heads.unionByName(new_heads)
        open_edges = cut_lineage(
            open_edges.join(members, "later", "left_anti")
            .join(members.select(F.col("later").alias("earlier")), "earlier", "left_anti")
            .join(new_heads, "earlier", "left_anti"))
        done += 1
        if done % 50 == 0:
            heads = cut_lineage(heads)
    if heads is None:
        return edges.select(F.col("later").alias("member"), F.col("earlier").alias("head")).limit(0)
    # a key whose every earlier partner is a member is a head itself; it has no row here
    known = edges.join(_all_heads(edges, heads), "earlier", "left_semi")
    settled = known.join(_all_heads(edges, heads).select(F.col("earlier").alias("later")), "later", "left_anti")
    return settled.groupBy(F.col("later").alias("member")).agg(F.min_by("earlier", "earlier_ord").alias("head"))


def _all_heads(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """Heads found in the rounds plus keys left without any matching head."""
    touched = edges.join(heads, "earlier", "left_semi").select("later").distinct()
    loose = edges.select("later").distinct().join(touched, "later", "left_anti").select(F.col("later").alias("earlier"))
    return heads.unionByName(loose).distinct()
