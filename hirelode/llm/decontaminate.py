"""Benchmark decontamination: BM25 search of every training passage in an index of test items.

The items (a test set, not the corpus) form an inverted index with block maxima:
items of like threshold stand in blocks, and every term has its largest impact in
each block that holds it.  Every document is cut into overlapping windows of twice
the longest item, so that an item lies whole in some window.  A window queries the
index in three steps, as in block-max WAND but for a batch of windows at once:
block bounds from the selective terms plus the most that common terms could add;
exact scores only in blocks whose bound reaches their lowest threshold; all items
scoring at least ``SHARE`` of their own full score are retrieved.  Each is then
verified: the share of its 5-word shingles in the window, for its question (the
first half) and its answer (the rest).

Words are runs of ASCII letters, digits and any non-ASCII bytes, in lower case, so
marks and case do not hide a passage.

The index is broadcast in parts of at most ``PART`` items; more items mean more
passes, never a larger broadcast.

Defined results: null and empty texts and items match nothing; repeated item rows
count once; an item of under 5 words must occur as a whole; an empty test set
finds nothing; all columns of the documents are kept by ``clean``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams

PART = 20_000       # items of one broadcast index
SHARE = 0.7         # of an item's full score
TOTAL = 0.8         # shingle overlap of the whole item
EITHER = 0.5        # shingle overlap of question and of answer
SHINGLE = 5
BLOCK = 16
K1, B = 1.2, 0.75
COMMON = 0.25       # terms with no larger impact only enter bounds as a constant


def _expand(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row number and position for all positions of the given ranges."""
    size = ends - starts
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)


class Index:
    """Inverted index of test items with impacts, block maxima and the shingles of both halves."""

    def __init__(self, ids: list, texts: list[str]):
        raw, offsets = grams.text_bytes(pa.array(texts, pa.string()))
        _, _, value, first = grams.words(raw, offsets, grams.MARKS)
        length = np.diff(first)
        used = np.flatnonzero(length > 0)
        self.ids, self.parts = [], []
        self.longest = int(length.max(initial=0))
        if not len(used):
            return
        bags = [np.unique(value[first[i]:first[i + 1]], return_counts=True) for i in used]
        terms, df = np.unique(np.concatenate([b[0] for b in bags]), return_counts=True)
        idf = np.log1p((len(used) - df + 0.5) / (df + 0.5))
        mean = length[used].mean()
        impacts = []
        for (t, tf), n in zip(bags, length[used], strict=True):
            at = np.searchsorted(terms, t)
            impacts.append((at, idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))))
        need = np.array([SHARE * w.sum() for _, w in impacts])
        order = np.argsort(need, kind="stable")
        self.need = need[order]
        self.ids = [ids[used[i]] for i in order]
        term = np.concatenate([impacts[i][0] for i in order])
        weight = np.concatenate([impacts[i][1] for i in order])
        item = np.repeat(np.arange(len(order)), [len(impacts[i][0]) for i in order])
        by = np.lexsort((item, term))
        self.terms, self.item, self.weight = terms, item[by], weight[by]
        self.first = np.searchsorted(term[by], np.arange(len(terms) + 1))
        self.most = np.maximum.reduceat(self.weight, self.first[:-1])
        cell = term[by] * (len(order) // BLOCK + 1) + self.item // BLOCK
        begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        self.block, self.block_most = self.item[begin] // BLOCK, np.maximum.reduceat(self.weight, begin)
        self.block_first = np.searchsorted(term[by][begin], np.arange(len(terms) + 1))
        self.block_need = np.minimum.reduceat(self.need, np.arange(0, len(order), BLOCK))
        for i in order:
            w = value[first[used[i]]:first[used[i] + 1]]
            half = max(SHINGLE, len(w) // 2)
            size = min(SHINGLE, len(w))
            runs = [_runs(part, size) for part in (w[:half], w[half - SHINGLE + 1:] if len(w) > half + 2 else w[:0], w)]
            self.parts.append((size, *[np.unique(r) for r in runs]))

    def search(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """(text number, item id, score, question overlap, answer overlap, overlap) of all verified items."""
        if not self.ids:
            return []
        _, _, value, first = grams.words(raw, offsets, grams.MARKS)
        n_texts, stride = len(offsets) - 1, max(self.longest, SHINGLE)
        at = np.minimum(np.searchsorted(self.terms, value), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == value)
        text = np.searchsorted(first, hit, side="right") - 1
        slots = np.diff(first) // stride + 2                        # windows of each text, and one before its first
        base = np.cumsum(slots) - slots
        window = base[text] + (hit - first[text]) // stride + 1
        n_windows = int(slots.sum()) if n_texts else 0
        pair = np.unique(np.concatenate([window, window - 1]) * np.int64(len(self.terms)) + np.concatenate([at[hit], at[hit]]))
        window, term = pair // len(self.terms), pair % len(self.terms)
        common = self.most[term] <= COMMON
        extra = np.bincount(window[common], weights=self.most[term[common]], minlength=n_windows)
        w, t = window[~common], term[~common]
        row, pos = _expand(self.block_first[t], self.block_first[t + 1])
        blocks = len(self.block_need)
        cell, which = np.unique(w[row] * np.int64(blocks) + self.block[pos], return_inverse=True)
        bound = np.bincount(which, weights=self.block_most[pos], minlength=len(cell)) + extra[cell // blocks]
        live = cell[bound >= self.block_need[cell % blocks]]
        # a block that only common terms could fill has no cell: its bound is the constant alone
        lone = np.flatnonzero(extra >= self.block_need.min())
        if len(lone):
            every = (lone[:, None] * np.int64(blocks) + np.arange(blocks))[extra[lone][:, None] >= self.block_need[None, :]]
            live = np.union1d(live, every)
        if not len(live):
            return []
        keep = np.isin(window, live // blocks)
        w, t = window[keep], term[keep]
        row, pos = _expand(self.first[t], self.first[t + 1])
        inside = np.isin(w[row] * np.int64(blocks) + self.item[pos] // BLOCK, live)
        row, pos = row[inside], pos[inside]
        cell, which = np.unique(w[row] * np.int64(len(self.ids)) + self.item[pos], return_inverse=True)
        score = np.bincount(which, weights=self.weight[pos], minlength=len(cell))
        good = score >= self.need[cell % len(self.ids)] * (1 - 1e-9)
        best: dict[tuple[int, int], tuple] = {}
        seen: dict[tuple[int, int], np.ndarray] = {}
        for c, s in zip(cell[good].tolist(), score[good].tolist(), strict=True):
            slot, i = divmod(c, len(self.ids))
            k = int(np.searchsorted(base, slot, side="right")) - 1
            begin = first[k] + max(0, slot - base[k] - 1) * stride
            end = min(first[k + 1], first[k] + (slot - base[k] + 1) * stride)
            size, *halves = self.parts[i]
            if (slot, size) not in seen:
                seen[slot, size] = np.sort(_runs(value[begin:end], size))
            q, a, total = (_overlap(p, seen[slot, size]) for p in halves)
            if total >= TOTAL and q >= EITHER and (a >= EITHER or not len(halves[1])):
                best[k, i] = max(best.get((k, i), ()), (total, s, q, a))
        return [(k, self.ids[i], s, q, a, total) for (k, i), (total, s, q, a) in sorted(best.items())]


def _runs(w: np.ndarray, size: int) -> np.ndarray:
    return grams.grams(w, np.array([0, len(w)]), size)[0] if len(w) >= size else np.zeros(0, np.uint64)


def _overlap(part: np.ndarray, window: np.ndarray) -> float:
    """Share of the distinct shingles of ``part`` among the sorted ones of ``window``."""
    if not len(part) or not len(window):
        return 0.0
    at = np.minimum(np.searchsorted(window, part), len(window) - 1)
    return float((window[at] == part).mean())


def indexes(items: DataFrame, part: int = PART):
    """Indexes of at most ``part`` items each, built one after another."""
    rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    parts = -(-rows.count() // part)
    for p in range(parts):
        # a part holds about ``part`` items: the bound of the broadcast
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).orderBy("item_id", "text").collect()
        yield Index([r["item_id"] for r in got], [r["text"] for r in got])


def _hits(column: pa.Array, index: Index) -> list[tuple]:
    raw, offsets = grams.text_bytes(column)
    found = []
    for a, b in grams.batch_slices(offsets):
        found += [(a + k, *rest) for k, *rest in index.search(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])]
    return found


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document row and test item that it contains."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, overlap double"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in indexes(items):
        shared = spark.sparkContext.broadcast(index)

        def find(batches, shared=shared):
            for b in batches:
                found = _hits(b.column("text"), shared.value)
                ids = b.column("doc_id")
                columns = [pa.array([ids[f[0]].as_py() for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())]
                columns += [pa.array([f[k] for f in found], pa.float64()) for k in (2, 3, 4, 5)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "overlap"])

        part = rows.mapInArrow(find, schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, with all their columns, that contain no test item."""
    for index in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        at = docs.columns.index("text")

        def keep(batches, shared=shared, at=at):
            for b in batches:
                mask = np.ones(b.num_rows, dtype=bool)
                mask[[f[0] for f in _hits(b.column(at), shared.value)]] = False
                yield b.filter(pa.array(mask))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
