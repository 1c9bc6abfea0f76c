"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized table
(``offset + j * skip``, both from a hash of its name).  Shards take turns, each
claiming the first free slot of its order, so slots divide evenly (counts differ
by one at most) and removing a shard moves few of the others' slots.  The table
depends on the shard names and the slot count only: its size is bounded by the
``slots`` parameter, it is filled once and broadcast, and a row finds its shard
with one hash and one lookup.  No row is shuffled, so a hot key costs nothing.

Defined results: a null key is the empty text; equal keys share a shard;
an empty table stays empty; columns of the input keep their names, and the added
columns (``slot``, ``shard`` by default) replace clashing ones.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = [f"shard-{i:03d}" for i in range(32)]
SLOTS = 4099  # prime, over 100 slots for each shard


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_slots(shards: list[str], slots: int) -> list[int]:
    """Shard index of every slot."""
    if not _is_prime(slots) or not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("needs distinct shard names and a prime slot count not below their number")
    walks = []
    for name in shards:
        digest = md5(name.encode()).hexdigest()
        walks.append((int(digest[:8], 16) % slots, int(digest[8:16], 16) % (slots - 1) + 1 if slots > 2 else 1))
    owner, step, turn = [-1] * slots, [0] * len(shards), 0
    for _ in range(slots):
        offset, skip = walks[turn]
        while owner[at := (offset + step[turn] * skip) % slots] >= 0:
            step[turn] += 1
        owner[at] = turn
        turn = (turn + 1) % len(shards)
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: the first 48 bits of its MD5, modulo the table size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") % slots


def assign_shards(df: DataFrame, key: str = "doc_id", shards: list[str] = SHARDS, slots: int = SLOTS,
                  slot_name: str = "slot", shard_name: str = "shard") -> DataFrame:
    """``df`` with the slot and the shard number of every row."""
    spark = df.sparkSession
    placed = df.withColumn("__slot", slot_of(F.col(key), slots)).drop(slot_name, shard_name)
    lookup = spark.createDataFrame(
        [(slot, shard) for slot, shard in enumerate(fill_slots(shards, slots))], "__slot long, __shard long")
    # one row for each slot: bounded by the parameter, not by the data
    return (
        placed.join(F.broadcast(lookup), "__slot")
        .withColumnsRenamed({"__slot": slot_name, "__shard": shard_name})
        .select(*[c for c in df.columns if c not in (slot_name, shard_name)], slot_name, shard_name))


# The same placement for another engine: the table is filled one slot a step.
ORACLE = f"""
WITH RECURSIVE shards AS (
  SELECT i, CAST('0x' || substr(md5('shard-' || lpad(CAST(i AS VARCHAR), 3, '0')), 1, 8) AS BIGINT) % {SLOTS} AS start_at,
    CAST('0x' || substr(md5('shard-' || lpad(CAST(i AS VARCHAR), 3, '0')), 9, 8) AS BIGINT) % {SLOTS - 1} + 1 AS skip
  FROM range({len(SHARDS)}) t(i)),
fill AS (
  SELECT 0 AS turn, CAST([] AS BIGINT[]) AS claimed, list_transform(range({SLOTS}), lambda x: false) AS used
  UNION ALL
  SELECT turn + 1, list_append(claimed, slot), list_concat(list_append(used[1:slot], true), used[slot + 2:])
  FROM (
    SELECT turn, claimed, used,
      list_filter(list_transform(range({SLOTS}), lambda j: (s.start_at + j * s.skip) % {SLOTS}), lambda x: NOT used[x + 1])[1] AS slot
    FROM fill JOIN shards s ON s.i = turn % {len(SHARDS)} WHERE turn < {SLOTS})),
lookup AS (
  SELECT unnest(claimed) AS slot, (generate_subscripts(claimed, 1) - 1) % {len(SHARDS)} AS shard FROM fill WHERE turn = {SLOTS})
SELECT d.doc_id, l.slot, CAST(l.shard AS BIGINT) AS shard
FROM documents d JOIN lookup l
  ON l.slot = CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) % {SLOTS}
"""
