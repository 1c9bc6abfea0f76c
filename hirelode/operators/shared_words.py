"""Rows that share words, without joining the words that everybody uses.

A word of more than ``HEAVY`` items is heavy.  Heavy words are never joined item by
item: items with the same heavy words form one group, and groups meet by what they
share.  The other words join by equality; none of them makes more than ``HEAVY`` rows
for an asking row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, cut_lineage

HEAVY = 1000


def heavy_words(items: DataFrame, words: str = "words") -> DataFrame:
    """The words of more than ``HEAVY`` items: at most the number of words over ``HEAVY``."""
    found = cut_lineage(items.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HEAVY).select("word"))
    return F.broadcast(found) if found.count() <= BROADCAST_ROWS else found


def split_words(rows: DataFrame, heavy: DataFrame, key: str, words: str = "words") -> tuple[DataFrame, DataFrame]:
    """(key, mask: the heavy words of each row; key, word: its other words). Keys are unique."""
    each = rows.select(key, F.explode(words).alias("word")).join(heavy.withColumn("heavy", F.lit(True)), "word", "left")
    masks = each.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("heavy"), F.col("word")))).alias("mask"))
    return masks, each.where("heavy IS NULL").select(key, "word")


def meeting_masks(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(mask, other, shared): different masks of either side with a word in common, and how many."""
    a = asked.select("mask").distinct().select("mask", F.explode("mask").alias("word"))
    b = known.select(F.col("mask").alias("other")).distinct().select("other", F.explode("other").alias("word"))
    return a.join(b, "word").groupBy("mask", "other").agg(F.count(F.lit(1)).alias("shared"))


def totals_of_sharing(asked: DataFrame, items: DataFrame, key: str, item: str, sums: list[str], words: str = "words") -> DataFrame:
    """Of every asking row: the sums over the items that share a word with it. Rows without such an item are left out."""
    heavy = heavy_words(items, words)
    asked_masks, asked_light = (cut_lineage(x) for x in split_words(asked, heavy, key, words))
    item_masks, item_light = (cut_lineage(x) for x in split_words(items, heavy, item, words))
    valued = item_masks.join(items.select(item, *sums), item)
    groups = valued.groupBy(F.col("mask").alias("other")).agg(*[F.sum(c).alias(c) for c in sums])
    by_mask = meeting_masks(asked_masks, item_masks).join(groups, "other").groupBy("mask").agg(*[F.sum(c).alias(f"__h_{c}") for c in sums])
    # an item met by a light word counts unless a heavy one has counted it
    pairs = asked_light.join(item_light, "word").select(key, item).distinct()
    other = pairs.join(asked_masks, key).join(valued.withColumnRenamed("mask", "other"), item).where(~F.arrays_overlap("mask", "other"))
    by_word = other.groupBy(key).agg(*[F.sum(c).alias(f"__l_{c}") for c in sums])
    both = asked_masks.join(by_mask, "mask", "left").join(by_word, key, "left")

    def total(c: str) -> Column:
        return (F.coalesce(f"__h_{c}", F.lit(0)) + F.coalesce(f"__l_{c}", F.lit(0))).alias(c)

    met = F.col(f"__h_{sums[0]}").isNotNull() | F.col(f"__l_{sums[0]}").isNotNull()
    return both.where(met).select(key, *[total(c) for c in sums])
