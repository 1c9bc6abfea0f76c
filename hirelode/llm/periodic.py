"""Runs: stretches of words that repeat with a period, found as maximal pairs.

A run is a stretch of consecutive words with smallest period q, at least ``repeats``
periods and ``least`` words long, that no neighbouring word extends.  The suffixes of a
text, in order, with their common prefix lengths make the LCP-interval tree; it is walked
from the leaves up.  Each node keeps the positions below it, in order and in one list for
each left word.  Two positions from different children of a node of length l agree for
exactly l words, and when their left words differ the pair is maximal: with distance d,
the d + l words from the first position on have period d and cannot be extended.  So the
maximal pairs with ``d * (repeats - 1) <= l`` and ``d + l >= least`` are the runs; where
one stretch comes with several distances, the smallest is its period.

Only positions at most ``l / 2`` apart matter.  Those lie in one run, all but its first
position have the same left word, so a look at the nearest position tells whether
anything differs, and pairs are read off the list of one left word: pairs grow with the
sum of the runs' exponents, positions move to the larger list only.

A text can only have a run when ``least * (repeats - 1) / repeats`` words in a row occur
twice in it; texts without such a repeat (by hash, which loses none) skip the tree.

Bounds: a task holds an Arrow batch and the arrays of one text (about 10 numbers a word
and doubling step).  A text is one row and is worked on in one task.

Defined results: null and empty texts have no words, no runs and an empty rest; repeated
rows each get their result; ties cannot occur, as runs are different stretches; an empty
table stays empty; only the named columns are looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import grams

LEAST = 24
REPEATS = 3
RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def suffixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and the common prefix length of each with the next one."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    levels = [rank]
    while n and rank.max() < n - 1:                 # ranks of twice as many words from pairs of ranks
        step = 1 << len(levels) - 1
        key = rank * (n + 1)
        key[:n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
        levels.append(rank)
    order = np.argsort(rank)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(max(0, n - 1), dtype=np.int64)
    for i in range(len(levels) - 1, -1, -1):
        padded = np.append(levels[i], -1)
        same = (padded[np.minimum(a, n)] == padded[np.minimum(b, n)]) & (a < n) & (b < n)
        for x in (a, b, common):
            x[same] += 1 << i
    return order, common


class Node:
    """Positions below a node, in order, and one list for each left word."""

    __slots__ = ("all", "lists")

    def __init__(self, position: int, left: int):
        self.all, self.lists = [position], {left: [position]}

    def take(self, other: Node) -> None:
        for old, new in [(self.all, other.all)] + [(self.lists.setdefault(c, []), x) for c, x in other.lists.items()]:
            if len(new) < 8:
                for p in new:
                    insort(old, p)
            else:
                old += new
                old.sort()


def runs(codes: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a word sequence given as numbers, by start, then period."""
    if repeats < 3:
        raise ValueError("runs of fewer than three periods are not supported")
    found: dict[tuple[int, int], int] = {}
    floor = -(-least * (repeats - 1) // repeats)
    order, common = suffixes(codes)
    left = [-1, *codes[:-1].tolist()]

    def pair(i: int, j: int, length: int) -> None:
        d = j - i
        if d + length >= least:
            found[i, d + length] = min(d, found.get((i, d + length), d))

    def join(x: Node, y: Node, length: int) -> Node:
        """Maximal pairs of two children of a node, and the node of both."""
        small, large = (x, y) if len(x.all) < len(y.all) else (y, x)
        reach = length // (repeats - 1)
        for p in small.all:
            at = bisect_left(large.all, p - reach)
            if at < len(large.all) and large.all[at] < p and left[large.all[at]] != left[p]:
                pair(large.all[at], p, length)
            at = bisect_right(large.all, p)
            if at < len(large.all) and large.all[at] <= p + reach and left[large.all[at]] != left[p]:
                others = large.lists[left[large.all[at]]]
                for q in others[bisect_right(others, p):bisect_right(others, p + reach)]:
                    pair(p, q, length)
        large.take(small)
        return large

    deep = np.flatnonzero(common >= floor)
    for block in np.split(deep, np.flatnonzero(np.diff(deep) > 1) + 1) if len(deep) else []:
        rows, lengths = order[block[0]:block[-1] + 2].tolist(), common[block].tolist()
        open_: list[list] = []                      # [length, node] of the intervals not yet closed
        node = Node(rows[0], left[rows[0]])
        for length, row in zip([*lengths, -1], [*rows[1:], None], strict=True):
            while open_ and open_[-1][0] > length:
                deeper, first = open_.pop()
                node = join(first, node, deeper)
            if row is None:
                break
            if open_ and open_[-1][0] == length:
                open_[-1][1] = join(open_[-1][1], node, length)
            else:
                open_.append([length, node])
            node = Node(row, left[row])
    return sorted((i, size, d) for (i, size), d in found.items())


def repeating(texts: pa.Array, size: int) -> np.ndarray:
    """Numbers of the texts in which some ``size`` words in a row may occur twice."""
    raw, offsets = grams.text_bytes(texts)
    marked = np.zeros(len(texts), dtype=bool)
    for a, b in grams.batch_slices(offsets):
        value, first = grams.words(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])[2:]
        keys, before = grams.grams(value, first, size)
        row = np.repeat(np.arange(a, b), np.diff(before))
        with np.errstate(over="ignore"):
            keys = keys ^ grams.scramble((row + 1).astype(np.uint64))
        order = np.argsort(keys)
        marked[row[order[1:][keys[order[1:]] == keys[order[:-1]]]]] = True
    return np.flatnonzero(marked)


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if not g]


def find(docs: DataFrame, keep: list[str], text: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """The columns ``keep``, and n_words, runs (by start, then period) and collapsed (the words left) of every row."""
    rows = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    floor = -(-least * (repeats - 1) // repeats)

    def look(batches):
        for b in batches:
            texts = b.column(len(keep))
            often = set(repeating(texts, floor).tolist())
            n_words, out, left = [], [], []
            for i, t in enumerate(texts.cast(pa.binary())):
                words = (t.as_py() or b"").split()  # of bytes: the six ASCII spaces only
                found = []
                if i in often:
                    codes: dict[bytes, int] = {}
                    found = runs(np.array([codes.setdefault(w, len(codes)) for w in words]), least, repeats)
                n_words.append(len(words))
                out.append([{"start": s, "length": m, "period": p} for s, m, p in found])
                left.append(b" ".join(collapse(words, found) if found else words))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(n_words, pa.int64()), pa.array(out, RUNS), pa.array(left, pa.binary()).cast(pa.string())],
                [*keep, "n_words", "runs", "collapsed"])

    return rows.mapInArrow(look, StructType([*rows.schema.fields[:-1], *StructType.fromDDL(RESULT).fields]))


def strongest(found) -> Column:
    """The run with most repeats, then smallest start, then period; null where there is none."""
    ranked = F.transform(found, lambda r: F.struct(
        (r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length")))
    best = F.array_max(ranked)
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def plant(docs: DataFrame, name: str = "doc_id", text: str = "text") -> DataFrame:
    """id and text, where every tenth text by the hash of its id repeats a part of itself up to its end."""
    h = F.crc32(F.col(name).cast("string").cast("binary"))
    rows = docs.select(F.col(name), F.col(text).cast("string").alias(text), h.alias("__h"))

    def planted(t: str | None, h: int | None) -> str | None:
        words = t.encode().split() if t and h is not None and h % 10 == 0 else []
        if not words:
            return t
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, n)]).decode()

    def change(batches):
        for b in batches:
            texts = [planted(t, h) for t, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [name, text])

    return rows.mapInArrow(change, StructType(rows.schema.fields[:2]))
