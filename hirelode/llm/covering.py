"""Near copies by SimHash and covering locality-sensitive hashing.

A text's fingerprint has bit i when more than half of its shingle hashes have it.
Two texts link when their fingerprints differ in at most ``RADIUS`` bits.  Every bit
position gets a vector of ``RADIUS + 1`` bits, not zero; table t (a vector, not zero)
masks the positions whose vector has an odd number of ones in common with t.  Whatever
``RADIUS`` positions differ, some t has an even number in common with all of their
vectors, so the masked fingerprints agree in that table: no link is lost.

Fingerprints are folded to different ones first.  A bucket (table, masked bits) with
two of them is one pair; up to ``CROWD`` are compared pairwise; in a bucket with more,
each fingerprint goes to all points one free bit away and to itself: two within two bits
share such a point, and all that share one are within two bits, so a star links them.
Such a group has at most 65 members, rows grow with the fingerprints, and no bucket
makes all its pairs.  Links make connected components.

Bounds: a task holds one Arrow batch and one piece of ``PIECE`` shingles; the rows of a
fingerprint that many documents have are joined by a broadcast of at most ``HOT`` labels.

Defined results: null texts and texts without words have fingerprint zero, which links
like any other; a text with fewer words than a shingle is one shingle; repeated rows
stay as often as they come; rows without an id get their component's smallest id, which
is null when the component has no id at all; an empty table stays empty; extra columns
are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import if_small, stored
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 2
CROWD = 64
HOT = 200
PIECE = 1 << 16


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The SimHash of one text (UTF-8), as an unsigned number."""
    words = text.lower().split()                    # of bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, PIECE):
        part = words[at:at + PIECE + size - 1]
        shingles = map(b" ".join, zip(*[part[i:] for i in range(size)], strict=False)) if len(words) >= size else [b" ".join(part)]
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, name: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """id and fingerprint (a long holding the 64 bits) of every row."""
    rows = docs.select(F.col(name), F.col(text).cast("string").cast("binary").alias("__text"))

    def compute(batches):
        for b in batches:
            found = np.array([fingerprint(t.as_py() or b"", size) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], [name, "fingerprint"])

    return rows.mapInArrow(compute, StructType([rows.schema[0], StructField("fingerprint", LongType())]))


def masks(radius: int = RADIUS) -> list[int]:
    """The masks of the ``2 ** (radius + 1) - 1`` tables over 64 positions, balanced and reproducible."""
    kinds = (1 << radius + 1) - 1
    vectors = 1 + np.random.default_rng(13).permutation(64) % kinds
    return [sum(1 << i for i in range(64) if int(vectors[i] & t).bit_count() % 2) for t in range(1, kinds + 1)]


def signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def links(different: DataFrame) -> DataFrame:
    """Pairs (a, b) of fingerprints that join all linked ones; ``different`` holds each fingerprint once."""
    tables = masks()
    entries = different.select("fingerprint", F.explode(F.array(*[
        F.struct(F.lit(t).cast("byte").alias("t"), F.col("fingerprint").bitwiseAND(signed(m)).alias("bits")) for t, m in enumerate(tables)])).alias("e")
    ).select("e.t", "e.bits", "fingerprint")
    buckets = stored(entries.groupBy("t", "bits").agg(
        F.count(F.lit(1)).alias("c"), F.min("fingerprint").alias("a"), F.max("fingerprint").alias("b")).where("c > 1"))

    def near(a: str, b: str) -> Column:
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS

    twos = buckets.where("c = 2").select("a", "b").where(near("a", "b"))
    more = stored(entries.join(if_small(buckets.where("c > 2").select("t", "bits", "c")), ["t", "bits"]))
    few = more.where(F.col("c") <= CROWD).select("t", "bits", F.col("fingerprint").alias("a"))
    some = few.join(few.withColumnRenamed("a", "b"), ["t", "bits"]).where("a < b").where(near("a", "b")).select("a", "b")
    free = [F.array(signed(0), *[signed(1 << i) for i in range(64) if not m >> i & 1]) for m in tables]
    flips = F.element_at(F.array(*free), F.col("t").cast("int") + 1)
    stars = (
        more.where(F.col("c") > CROWD)
        .select("fingerprint", F.explode(flips).alias("flip"))
        .select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("centre"))
        .groupBy("centre").agg(F.array_sort(F.collect_set("fingerprint")).alias("all"))       # at most 65: the ball of the centre
        .where(F.size("all") > 1).select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, 65)).alias("b")))
    return twos.unionAll(some).unionAll(stars).distinct()


def near_copies(docs: DataFrame, name: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """id, fingerprint and component_id (smallest id of the component) of every row."""
    rows = stored(fingerprints(docs, name, text, size))
    classes = stored(rows.groupBy("fingerprint").agg(F.min(name).alias("first"), F.count(F.lit(1)).alias("c")))
    roots = components(stored(links(classes.select("fingerprint")))).select(F.col("node").alias("fingerprint"), "root")
    labelled = classes.join(if_small(roots), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = stored(labelled.join(least, "root").select("fingerprint", "c", "component_id"))
    total = labels.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    hot = F.col("c") * HOT > total                  # fewer than HOT fingerprints can have that many rows
    often = F.broadcast(labels.where(hot).select("fingerprint", "component_id"))
    rest = rows.join(F.broadcast(labels.where(hot).select("fingerprint")), "fingerprint", "left_anti")
    return rows.join(often, "fingerprint").select(name, "fingerprint", "component_id").unionAll(
        rest.join(labels.where(~hot), "fingerprint").select(name, "fingerprint", "component_id"))


def one_of_each(docs: DataFrame, name: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose id is the smallest of their component; rows without an id stay."""
    found = near_copies(docs.where(F.col(name).isNotNull()), name, text)
    gone = found.where(F.col(name) != F.col("component_id")).select(name).distinct()
    kept = docs.join(gone, name, "left_anti").select(*docs.columns)
    again = Window.partitionBy(name).orderBy(F.xxhash64(*[c for c, kind in docs.dtypes if not kind.startswith("map")]))
    return kept.where(F.col(name).isNull()).unionAll(
        kept.where(F.col(name).isNotNull()).withColumn("__n", F.row_number().over(again)).where("__n = 1").drop("__n"))


def as_hex(bits) -> Column:
    """The 64 bits as 16 lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
