"""Exact n-gram Jaccard join: size-banded tiles, bitmap bounds, sorted-array intersection.

A document's set is its distinct ``WORDS``-word shingles (hashed).  Two documents
link when ``100 * |A & B| >= SHARE * |A | B|``; the result is the component of each.

1.  Equal sets form a class; only one of each class goes on.
2.  Two sets that link share one of their first ``n - ceil(SHARE * n) + 1`` tokens
    in any fixed order.  The order puts shingles that a fixed-size sketch shows to be
    frequent last, so passages that many documents share are no index entries; the
    sketch decides speed only, never the result.
3.  The entries of a token are sorted by size and cut into chains wherever two sizes
    in turn cannot link.  Short chains give all their pairs; in longer ones every
    member meets the first and the one before it, which merges most near copies into
    components.  A pair must allow a link by its sizes and by the places of the token:
    at its first common token, what is common cannot exceed what is left of either set.
    Then its bitmaps must allow one.
4.  Long chains that still hold several components are cut into tiles of bounded
    size; tiles of different components meet, their members in size bands, under the
    same tests of sizes, places and bitmaps.  First the likeliest few partners of a
    member are verified; after merging, the chains in which a member had more partners
    than these meet again, for all that are still in different components.
5.  Verification intersects sorted arrays, built again from the texts of candidates
    only: one document of each class, chosen by its id before it is cut into words.

No partner or candidate is dropped; inside a component no further pairs are made.

Defined results: null or wordless texts have an empty set and link with nothing;
texts of fewer words than a shingle are one shingle; rows with a null id keep a null
component; repeated rows fall in one class; hashes are of 58 bits.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelode.session import cut_lineage, shuffles_go_early

from . import grams
from .common import hits, if_small, sift
from .components import components

WORDS = 4
SHARE = 85
CELLS = 1 << 20       # cells of the frequency sketch
BITS, MOST = 1024, 1 << 16      # of a bitmap, by the size of the set
TILE = 1024          # two tiles with the widest bitmaps take 16 MB of a task; a row of a group of k is dealt k / TILE times
LIKELY = 4
CHAIN = 16            # members of a chain whose pairs are all taken at once: 7.5 rows of 32 bytes a member, about one row with a bitmap
HOT = 20              # tokens of more than about 2 ** HOT entries are dealt to several tasks
IDS = 1_000_000        # ids of this many rows at most are broadcast (eight bytes each)
PAIRS = 100_000       # pairs compared at a time in a task
U = np.uint64


def frequent_cells(docs: DataFrame, size: int) -> np.ndarray:
    """Level of every sketch cell: 0, or about log2 of the count where a task saw far more than its mean."""

    def count(batches):
        seen = np.zeros(CELLS, dtype=np.int64)
        for b in batches:
            raw, offsets = grams.text_bytes(b.column("text"))
            for x, y in grams.batch_slices(offsets):
                _, _, value, first = grams.words(raw[offsets[x]:offsets[y]], offsets[x:y + 1] - offsets[x])
                seen += np.bincount((grams.grams(value, first, size)[0] & U(CELLS - 1)).astype(np.int64), minlength=CELLS)
        hot = np.flatnonzero(seen >= max(32, 8 * seen.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(hot), pa.array(seen[hot])], ["cell", "n"])

    # at most CELLS rows, whatever the input
    found = docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    level = np.zeros(CELLS, dtype=np.uint64)
    level[found.column("cell").to_numpy()] = np.floor(np.log2(found.column("n").to_numpy())).astype(np.uint64)
    return level


def token_sets(column: pa.Array, level: np.ndarray, size: int):
    """(first row, last row, sizes, tokens, starts) for slices of the column: sorted distinct tokens of each text."""
    raw, offsets = grams.text_bytes(column)
    for x, y in grams.batch_slices(offsets):
        _, _, value, first = grams.words(raw[offsets[x]:offsets[y]], offsets[x:y + 1] - offsets[x])
        gram, before = grams.grams(value, first, size)
        token = (level[(gram & U(CELLS - 1)).astype(np.int64)] << U(58)) | (gram >> U(6))
        row = np.repeat(np.arange(y - x), np.diff(before))
        order = np.lexsort((token, row))
        token, row = token[order], row[order]
        fresh = np.ones(len(token), dtype=bool)
        fresh[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
        token, row = token[fresh], row[fresh]
        n = np.bincount(row, minlength=y - x)
        yield x, y, n, token, np.concatenate([[0], np.cumsum(n)])


def _keys(n: np.ndarray, token: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of each whole set."""
    with np.errstate(over="ignore"):
        total = np.concatenate([[U(0)], np.cumsum(grams.scramble(token), dtype=np.uint64)])
        return grams.scramble(total[start[1:]] - total[start[:-1]] + n.astype(np.uint64) * U(0x9E3779B97F4A7C15)).view(np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the ranges, and where each begins in the result."""
    before = np.concatenate([[0], np.cumsum(size)])
    return np.arange(before[-1]) - np.repeat(before[:-1], size) + np.repeat(start, size), before


def _lists(values: np.ndarray, start: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(values.view(np.int64)))


def bitmaps(token: np.ndarray, start: np.ndarray) -> list[bytes]:
    """One bit for each hashed token: ``BITS`` of them, or the power of two from twice the set up to ``MOST``."""
    n = np.diff(start)
    width = np.clip(2 ** np.ceil(np.log2(np.maximum(2 * n, 1))), BITS, MOST).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(width)])
    out: list[bytes] = []
    for a in range(0, len(n), 512):                                  # rows at a time, which bounds the memory
        b = min(len(n), a + 512)
        field = np.zeros(int(base[b] - base[a]), dtype=bool)
        bit = grams.scramble(token[start[a]:start[b]]) & np.repeat((width[a:b] - 1).astype(np.uint64), n[a:b])
        field[np.repeat(base[a:b] - base[a], n[a:b]) + bit.astype(np.int64)] = True
        packed = np.packbits(field).tobytes()
        cut = ((base[a:b + 1] - base[a]) // 8).tolist()
        out += [packed[x:y] for x, y in zip(cut, cut[1:], strict=False)]
    return out


def linked(a: np.ndarray, b: np.ndarray, share: int) -> bool:
    """Exact test of two sorted arrays."""
    if 100 * min(len(a), len(b)) < share * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * both >= share * (len(a) + len(b) - both)


def _named(docs: DataFrame, name: str) -> str:
    return docs.select(F.col(name).alias("id")).schema.simpleString()[7:-1].replace(":", " ", 1)


def classes(docs: DataFrame, level, size: int, name: str) -> DataFrame:
    """id, n and key (hash of the set) of every row; key is null for empty sets."""

    def work(batches):
        for b in batches:
            for x, y, n, token, start in token_sets(b.column("text"), level.value, size):
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(x, y - x), pa.array(n.astype(np.int64)), pa.array(_keys(n, token, start), mask=n == 0)], ["id", "n", "key"])

    return docs.select(F.col(name).alias("id"), "text").mapInArrow(work, _named(docs, name) + ", n long, key long")


def members(docs: DataFrame, level, size: int, share: int, name: str) -> DataFrame:
    """One row for each class: key, id (smallest), n, bitmap and index tokens."""

    def work(batches):
        for b in batches:
            for x, y, n, token, start in token_sets(b.column("text"), level.value, size):
                lead = np.where(n > 0, n - (share * n + 99) // 100 + 1, 0)
                pos, before = _ranges(start[:-1], lead)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(x, y - x), pa.array(n.astype(np.int64)), pa.array(_keys(n, token, start), mask=n == 0),
                     pa.array(bitmaps(token, start), pa.binary()), _lists(token[pos], before)], ["id", "n", "key", "bits", "prefix"])

    rows = docs.where(F.col(name).isNotNull()).select(F.col(name).alias("id"), "text").mapInArrow(
        work, _named(docs, name) + ", n long, key long, bits binary, prefix array<long>")
    return rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "bits", "prefix")])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("key"))


def _fits(n: np.ndarray, m: np.ndarray, left_n: np.ndarray, left_m: np.ndarray, share: int) -> np.ndarray:
    """Whether two sets can link whose first common token leaves so many tokens of each, itself included."""
    most = np.minimum(left_n, left_m)
    return (100 * np.minimum(n, m) >= share * np.maximum(n, m)) & (100 * most >= share * (n + m - most))


def _chains(batches, share: int):
    """First candidates, and the members of long chains, from entries in the order (token, salt, n).

    Rows with a null token are pairs (a, b) of sizes na and nb; the others are members a of the
    chain named by the token, of size na, with the token in place nb.  What is carried between
    batches is a short chain, or the first and the last row of a long one.
    """
    kept = None
    for batch in chain(batches, [None]):
        now = None if batch is None else [batch.column(c).to_numpy() for c in ("token", "salt", "key", "n", "pos")]
        if now is not None:
            now.append(np.zeros(len(now[0]), dtype=bool))
            if kept is not None:
                now = [np.concatenate([x, y]) for x, y in zip(kept, now, strict=True)]
        else:
            now = kept
        if now is None or not len(now[0]):
            continue
        token, salt, key, n, pos, old = now
        change = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]) | (100 * n[:-1] < share * n[1:])
        change &= ~(old[1:] & old[:-1])                          # ends of one long chain
        begin = np.concatenate([[0], np.flatnonzero(change) + 1])
        end = np.append(begin[1:], len(token))
        hot = salt[begin] >= 0
        long = (end - begin > CHAIN) | old[begin] | hot
        stop = len(token) if batch is None or long[-1] else int(begin[-1])
        if batch is not None:
            carry = np.unique([begin[-1], len(token) - 1]) if long[-1] else np.arange(begin[-1], len(token))
            kept = [c[carry] for c in now]
            kept[5] = np.full(len(carry), bool(long[-1]))
        run = np.repeat(np.arange(len(begin)), end - begin)[:stop]
        at = np.arange(stop)
        fresh, wide = ~old[:stop], long[run]
        left, right = [], []
        for step in range(1, CHAIN):
            x = at[fresh & (at - step >= begin[run]) & (~wide | (step == 1))]
            left.append(x)
            right.append(x - step)
        x = at[fresh & wide & (at - 1 > begin[run])]
        left.append(x)
        right.append(begin[run[x]])
        x, y = np.concatenate(left), np.concatenate(right)
        fine = _fits(n[x], n[y], n[x] - pos[x], n[y] - pos[y], share)
        x, y = x[fine], y[fine]
        swap = key[x] < key[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        m = at[fresh & wide]
        first = np.where(hot[run[m]], 0, n[begin[run[m]]]).astype(np.uint64)
        with np.errstate(over="ignore"):
            name = grams.scramble(token[m].view(np.uint64) + first * U(0x9E3779B97F4A7C15)).view(np.int64)
        for cut in range(0, len(x), PAIRS):
            i, j = x[cut:cut + PAIRS], y[cut:cut + PAIRS]
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(i), pa.int64()), pa.array(key[i]), pa.array(key[j]), pa.array(n[i]), pa.array(n[j])], ["token", "a", "b", "na", "nb"])
        if len(m):
            yield pa.RecordBatch.from_arrays(
                [pa.array(name), pa.array(key[m]), pa.nulls(len(m), pa.int64()), pa.array(n[m]), pa.array(pos[m])], ["token", "a", "b", "na", "nb"])


class Bitmaps:
    """Bitmaps of several widths, each also folded to half its width to meet the next narrower ones."""

    def __init__(self, rows: list[bytes]):
        size = np.array([len(r) for r in rows])
        self.size, self.tables = size, {}
        for w in np.unique(size):
            own = np.flatnonzero((size == w) | (size == 2 * w))
            place = np.full(len(rows), -1, dtype=np.int64)
            place[own] = np.arange(len(own))
            table = np.zeros((len(own), w), dtype=np.uint8)
            for k, r in enumerate(own):
                x = np.frombuffer(rows[r], np.uint8)
                table[k] = x if len(x) == w else x[:w] | x[w:]
            self.tables[int(w)] = place, table.view(np.uint64)

    def possible(self, x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether rows x and y, of n and m tokens, can link, and the most tokens that they can share."""
        most = np.minimum(n, m).astype(np.int64)
        narrow = np.minimum(self.size[x], self.size[y])
        for w, (place, table) in self.tables.items():
            pairs = np.flatnonzero(narrow == w)
            for a in range(0, len(pairs), max(1, (1 << 25) // w)):
                some = pairs[a:a + max(1, (1 << 25) // w)]
                left, right = table[place[x[some]]], table[place[y[some]]]
                common = np.bitwise_count(left & right).sum(1)
                # a bit of one set that the other lacks stands for a token that the other lacks
                most[some] = np.minimum(n[some] - (np.bitwise_count(left).sum(1) - common), m[some] - (np.bitwise_count(right).sum(1) - common))
        return 100 * most >= share * (n + m - most), most


def _screen(pairs: DataFrame, kept: DataFrame, share: int) -> DataFrame:
    """The pairs (a, b) of sizes na and nb whose bitmaps allow a link."""
    wanted = pairs.sparkSession.sparkContext.broadcast(sift(_ends(pairs)))

    def some(batches):
        for t in batches:
            yield t.filter(pa.array(hits(wanted.value, t.column("key").to_numpy())))

    bits = kept.select("key", "bits").mapInArrow(some, "key long, bits binary")
    rows = (
        pairs.join(bits.select(F.col("key").alias("a"), F.col("bits").alias("xa")), "a")
        .join(bits.select(F.col("key").alias("b"), F.col("bits").alias("xb")), "b").select("a", "b", "na", "nb", "xa", "xb"))

    def look(batches):
        for t in batches:
            k = np.arange(t.num_rows)
            both = Bitmaps(t.column("xa").to_pylist() + t.column("xb").to_pylist())
            fine, _ = both.possible(k, k + t.num_rows, t.column("na").to_numpy(), t.column("nb").to_numpy(), share)
            yield t.select(["a", "b"]).filter(pa.array(fine))

    return cut_lineage(rows.mapInArrow(look, "a long, b long"))


def _verify(pairs: DataFrame, docs: DataFrame, kept: DataFrame, level, size: int, share: int, name: str) -> DataFrame:
    """The pairs (a, b) that link: the arrays of one document of each class are brought to the pairs."""
    ids = kept.join(_ends(pairs), "key", "left_semi").select(F.xxhash64("id").alias("key"))
    wanted = docs.sparkSession.sparkContext.broadcast(sift(ids))

    def arrays(batches):
        for b in batches:
            texts = b.column("text").filter(pa.array(hits(wanted.value, b.column("spot").to_numpy())))
            for _, _, n, token, start in token_sets(texts, level.value, size):
                some = np.flatnonzero(n > 0)
                pos, before = _ranges(start[:-1][some], n[some])
                yield pa.RecordBatch.from_arrays([pa.array(_keys(n, token, start)[some]), _lists(token[pos], before)], ["key", "token"])

    read = docs.where(F.col(name).isNotNull()).select(F.xxhash64(F.col(name)).alias("spot"), "text")
    sets = read.mapInArrow(arrays, "key long, token array<long>").groupBy("key").agg(F.first("token").alias("token"))
    rows = (
        pairs.join(sets.select(F.col("key").alias("a"), F.col("token").alias("ta")), "a")
        .join(sets.select(F.col("key").alias("b"), F.col("token").alias("tb")), "b").select("a", "b", "ta", "tb"))

    def test(batches):
        for t in batches:
            left, right = t.column("ta"), t.column("tb")
            good = [linked(left[i].values.to_numpy().view(np.uint64), right[i].values.to_numpy().view(np.uint64), share) for i in range(t.num_rows)]
            yield t.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return cut_lineage(rows.mapInArrow(test, "a long, b long"))


def _tile_pairs(group: np.ndarray, alone: np.ndarray, side: np.ndarray, key: np.ndarray, n: np.ndarray, pos: np.ndarray, comp: np.ndarray,
                bits: np.ndarray, share: int, likely: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of whole tile pairs (``group`` in runs, side 0 before side 1, sizes in order), and rows that had more.

    A pair remains if its components differ, its sizes and the places of the token allow a link, and so do the bitmaps.
    A tile that meets itself (``alone``) has its rows once, on side 0.
    """
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    end = np.append(begin[1:], len(group))
    run = np.repeat(np.arange(len(begin)), end - begin)
    rights = end - np.bincount(run, weights=side, minlength=len(begin)).astype(np.int64)      # where side 1 begins
    rights = np.where(alone[begin], begin, rights)
    left = np.flatnonzero(side == 0)
    # the size band of each left row among the right rows of its run
    scale = np.int64(1) << 40
    ordered = np.where((side == 1) | alone, run * scale + n, run * scale)
    low = np.searchsorted(ordered, run[left] * scale - (-(share * n[left]) // 100))
    high = np.searchsorted(ordered, run[left] * scale + 100 * n[left] // share, side="right")
    low = np.clip(low, np.where(alone[left], left + 1, rights[run[left]]), end[run[left]])
    high = np.clip(high, low, end[run[left]])
    table, out_a, out_b, more = Bitmaps(bits.tolist()), [], [], [left[:0]]
    at = 0
    upto = np.cumsum(high - low)
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        x = np.repeat(left[at:to], (high - low)[at:to])
        y, _ = _ranges(low[at:to], (high - low)[at:to])
        other = (comp[x] != comp[y]) & _fits(n[x], n[y], n[x] - pos[x], n[y] - pos[y], share)
        x, y = x[other], y[other]
        fine, most = table.possible(x, y, n[x], n[y], share)
        x, y, most = x[fine], y[fine], most[fine]
        if likely is not None and len(x):
            order = np.lexsort((-most, x))
            x, y = x[order], y[order]
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            place = np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))
            more.append(x[place == likely])
            x, y = x[place < likely], y[place < likely]
        out_a.append(key[x])
        out_b.append(key[y])
        at = to
    a, b = np.concatenate(out_a or [key[:0]]), np.concatenate(out_b or [key[:0]])
    return np.maximum(a, b), np.minimum(a, b), np.concatenate(more)


def _tile_batches(batches, share: int, likely: int | None):
    """Cuts sorted batches between tile pairs; the last, maybe unfinished one waits for the next batch.

    Gives candidate pairs (a, b), and rows with only the token of groups where a member has more than ``likely`` partners.
    """
    names = ["token", "i", "j", "side", "key", "n", "pos", "comp"]
    kept = None
    for batch in chain(batches, [None]):
        now = None if batch is None else (
            [batch.column(c).to_numpy() for c in names] + [np.array(batch.column("bits").to_pylist(), dtype=object)])
        if now is not None and kept is not None:
            now = [np.concatenate([a, b]) for a, b in zip(kept, now, strict=True)]
        elif now is None:
            now = kept
        if now is None or not len(now[0]):
            continue
        token, i, j = now[:3]
        change = np.flatnonzero((token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        stop = len(token) if batch is None else int(change[-1]) if len(change) else 0
        kept = [c[stop:] for c in now]
        if stop:
            group = np.zeros(stop, dtype=np.int64)
            group[change[change < stop]] = 1
            a, b, more = _tile_pairs(np.cumsum(group), (i == j)[:stop], *(c[:stop] for c in now[3:]), share, likely)
            again = np.unique(token[more])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "token"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(again), pa.int64()), pa.nulls(len(again), pa.int64()), pa.array(again)], ["a", "b", "token"])


def _label(nodes: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Adds the component of ``key``: its own where no link was found."""
    if comps is None:
        return nodes.withColumn("comp", F.col("key"))
    return nodes.join(comps.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("comp", F.coalesce("root", "key")).drop("root")


def _tiles(entries: DataFrame, kept: DataFrame, comps: DataFrame, share: int, likely: int | None) -> DataFrame:
    """Distinct candidate pairs (a, b) between components inside token groups, and the tokens of groups that have more."""
    rows = cut_lineage(_label(entries, comps))
    per = rows.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
    groups = (
        per.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"), F.count(F.lit(1)).alias("k"))
        .where(F.col("k") > 1)
        .select("token", F.col("top.comp").alias("main"), F.col("top.c").alias("c"), F.col("all"),
                F.ceil(F.col("top.c") / TILE).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("top.c")) / TILE).cast("int").alias("rests")))
    # the largest component of a group never meets itself: its tiles meet those of the rest, and the rest meets itself;
    # a small one has no tiles of its own where that makes fewer rows
    whole = F.ceil(F.col("all") / TILE).cast("int")
    apart = F.col("c") * F.col("rests") + (F.col("all") - F.col("c")) * (F.col("rests") + F.col("mains"))
    plain = 4 * F.col("all") * whole < 3 * apart
    groups = groups.select(
        "token", F.when(~plain, F.col("main")).alias("main"), F.when(plain, 0).otherwise(F.col("mains")).alias("mains"),
        F.when(plain, whole).otherwise(F.col("rests")).alias("rests"))
    placed = (
        rows.join(groups, "token")
        .withColumn("of_main", F.col("comp").eqNullSafe(F.col("main")))
        .withColumn("tile", F.pmod(F.xxhash64("key", "token"), F.when(F.col("of_main"), F.col("mains")).otherwise(F.col("rests"))).cast("int")))
    rests, tile = F.col("rests"), F.col("tile")
    meets = F.when(
        F.col("of_main"), F.transform(F.sequence(F.lit(0), rests - 1), lambda i: F.struct(i.alias("i"), (rests + tile).alias("j"), F.lit(1).alias("side")))
    ).otherwise(F.concat(
        F.transform(F.sequence(tile, rests + F.col("mains") - 1), lambda j: F.struct(tile.alias("i"), j.alias("j"), F.lit(0).alias("side"))),
        F.transform(F.filter(F.sequence(F.lit(0), tile), lambda i: i < tile), lambda i: F.struct(i.alias("i"), tile.alias("j"), F.lit(1).alias("side")))))
    spread = placed.withColumn("meet", F.explode(meets)).select(
        "token", "key", "n", "pos", "comp", F.col("meet.i").alias("i"), F.col("meet.j").alias("j"), F.col("meet.side").alias("side"))
    dealt = spread.join(kept.select("key", "bits"), "key")
    order = ["token", "i", "j", "side", "n"]
    return (
        dealt.select(*order, "key", "pos", "comp", "bits").repartition("token", "i", "j").sortWithinPartitions(*order)
        .mapInArrow(lambda batches: _tile_batches(batches, share, likely), "a long, b long, token long").distinct())


def join(docs: DataFrame, name: str = "doc_id", size: int = WORDS, share: int = SHARE) -> DataFrame:
    """name, n_shingles and component_id (smallest linked ``name``, itself included) of every row."""
    spark = docs.sparkSession
    shuffles_go_early(spark)
    docs = docs.select(name, F.col("text").cast("string").alias("text"))
    level = spark.sparkContext.broadcast(frequent_cells(docs, size))
    every = cut_lineage(classes(docs, level, size, name))
    kept = cut_lineage(members(docs, level, size, share, name))
    # a token's level tells about how many entries it has: those of very frequent ones are dealt to several tasks
    depth = F.shiftrightunsigned("token", 58).cast("int")
    salts = F.expr(f"shiftleft(1L, greatest(shiftrightunsigned(token, 58) - {HOT}, 0L)::int)")
    index = kept.select("key", "n", F.posexplode("prefix").alias("pos", "token")).select(
        "token", F.when(depth > HOT, F.pmod(F.xxhash64("key"), salts)).otherwise(F.lit(-1)).cast("int").alias("salt"), "key", "n", F.col("pos").cast("long").alias("pos"))
    met = cut_lineage(
        index.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "key")
        .mapInArrow(lambda batches: _chains(batches, share), "token long, a long, b long, na long, nb long"))
    done = _screen(cut_lineage(met.where(F.col("token").isNull()).drop("token").distinct()), kept, share)
    links = _verify(done, docs, kept, level, size, share, name)
    comps = cut_lineage(components(links))
    crowded = met.where(F.col("token").isNotNull()).select("token", F.col("a").alias("key"), F.col("na").alias("n"), F.col("nb").alias("pos"))
    for likely in (LIKELY, None):
        tiled = cut_lineage(_tiles(crowded, kept, comps, share, likely))
        pairs = cut_lineage(tiled.where(F.col("token").isNull()).select("a", "b").join(done, ["a", "b"], "left_anti"))
        # a group whose members had no more partners has given all its pairs
        crowded = crowded.join(if_small(tiled.where(F.col("token").isNotNull()).select("token"), IDS), "token", "left_semi")
        if not pairs.isEmpty():
            more = _verify(pairs, docs, kept, level, size, share, name)
            links, done = links.unionAll(more), done.unionAll(pairs)
            if not more.isEmpty():
                comps = cut_lineage(components(links))
    rooted = _label(kept.select("key", "id"), comps)
    least = rooted.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = rooted.join(least, "comp").select("key", "component_id")
    return every.join(named, "key", "left").select(
        F.col("id").alias(name), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, name: str = "doc_id", **options) -> DataFrame:
    """The documents, with all their columns: of every component the one with the smallest id.

    Texts without words and rows without an id stay; of repeated ids one row stays.
    """
    found = cut_lineage(join(docs, name, **options).where(F.col(name).isNotNull()))
    gone = if_small(cut_lineage(found.where(F.col(name) != F.col("component_id")).select(name).distinct()), IDS)
    again = cut_lineage(found.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(name))
    kept = docs.join(gone, name, "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    again = if_small(again, IDS)
    return kept.join(again, name, "left_anti").select(*docs.columns).unionAll(
        kept.join(again, name, "left_semi").select(*docs.columns).dropDuplicates([name]))
