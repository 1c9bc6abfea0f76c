"""Connected components of edge tables, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelode.session import cut_lineage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of an edge; the root is the smallest node of the component.

    Stars in turn: each node hands its larger neighbours to its smallest one, then
    its smaller ones, until every edge points at a root.  Minima are aggregated
    before the shuffle, so a node with very many neighbours is no group of its own;
    each round is checkpointed.
    """
    down = cut_lineage(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        both = down.unionAll(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        down = cut_lineage(
            joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        below = down.select(F.col("u").alias("v"))
        if down.join(below, "v", "left_semi").isEmpty():
            break
    return down.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        down.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
