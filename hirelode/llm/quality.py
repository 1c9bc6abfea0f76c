"""Document quality from pairwise ranking.

Preference pairs (a good and a bad labelled document) train a Bradley-Terry model:
the chance that one beats the other is the logistic function of the difference of
their linear scores over text features.  Labelled rows are sampled up to
``per_label`` for each label (by hash of the id), whatever the table size; all
rows are scored by their whole text.  The cut is the quantile, at the share of bad
labels, of the ranks of all learning rows (not of the sample): they are counted in
``BINS`` parts, exact where the quantile falls between parts and even inside one.
The score is a logistic curve that gives ``ACCEPT`` at the cut.

Defined results: null, empty and blank texts have the features of a text without
words and are scored like any other; without labels of both kinds every score is
0.5; repeated labels of a document count once by majority; other columns are kept
unread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import held_out, hits, sampled, sift

ACCEPT = 0.7
PER_LABEL = 3000      # bound of the learning sample, rows for each label
PAIRS = 60_000
BINS = 1 << 16        # parts of the range of ranks, for the quantile over all learning rows
FEATURES = 24

_CLASS = np.full(256, 6, dtype=np.uint8)          # 6: bytes of non-ASCII letters
_CLASS[:128] = 5                                   # 5: other ASCII marks
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9, 11, 12, 13, 10]] = 3
_CLASS[[44, 46, 39, 59, 58, 40, 41, 45, 34, 63]] = 4   # usual punctuation of prose


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` numbers for each text."""
    raw, offsets = grams.text_bytes(column)
    parts = [_features(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in grams.batch_slices(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, FEATURES))


def _features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    kind = _CLASS[raw]
    share = np.zeros((n, 7))
    for k in range(7):
        upto = np.concatenate([[0], np.cumsum(kind == k)])
        share[:, k] = (upto[offsets[1:]] - upto[offsets[:-1]]) / np.maximum(size, 1)
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    lines = lines[offsets[1:]] - lines[offsets[:-1]] + 1.0
    start, end, value, first = grams.words(raw, offsets)
    count = np.diff(first).astype(float)
    row = np.repeat(np.arange(n), np.diff(first))
    safe = np.maximum(count, 1)
    length = (end - start).astype(float)

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=x, minlength=n) / safe

    average = mean(length)
    lone = mean(length == 1)
    marks = np.concatenate([[0], np.cumsum(kind == 5)])
    marked = mean((marks[end] - marks[start]) >= 2)
    bar = mean((length == 1) & (kind[start] == 5)) if len(start) else np.zeros(n)
    again = []
    for lag in (1, 2, 3, 5, 8):                    # words that come again after so many words
        same = np.zeros(len(value))
        if len(value) > lag:
            same[lag:] = (value[lag:] == value[:-lag]) & (row[lag:] == row[:-lag])
        again.append(mean(same))
    order = np.lexsort((value, row))
    distinct = np.ones(len(value))
    if len(value) > 1:
        distinct[1:] = (value[order][1:] != value[order][:-1]) | (row[order][1:] != row[order][:-1])
    variety = np.bincount(row[order], weights=distinct, minlength=n) / safe
    four, before = grams.grams(value, first, 4)
    four_row = np.repeat(np.arange(n), np.diff(before))
    order = np.lexsort((four, four_row))
    fresh = np.ones(len(four))
    if len(four) > 1:
        fresh[1:] = (four[order][1:] != four[order][:-1]) | (four_row[order][1:] != four_row[order][:-1])
    fresh = np.bincount(four_row[order], weights=fresh, minlength=n) / np.maximum(np.diff(before), 1)
    caps = mean(_CLASS[raw[start]] == 1) if len(start) else np.zeros(n)
    return np.column_stack([
        share, np.log1p(count), np.log1p(count / lines), average, lone, marked, bar, *again, variety, fresh,
        caps, share[:, 1] > 0.3, count == 0, variety * np.log1p(count)]).astype(float)


def _train(good: np.ndarray, bad: np.ndarray, bad_share: float) -> dict:
    rng = np.random.default_rng(5)
    both = np.concatenate([good, bad])
    centre, spread = both.mean(0), both.std(0) + 1e-9
    a, b = (good - centre) / spread, (bad - centre) / spread
    gap = np.clip(a[rng.integers(0, len(a), PAIRS)] - b[rng.integers(0, len(b), PAIRS)], -8, 8)
    w, ridge = np.zeros(gap.shape[1]), 1e-3
    for _ in range(12):                            # Newton steps on the mean logistic loss of the differences
        p = 1 / (1 + np.exp(np.clip(gap @ w, -35, 35)))
        grad = -(gap * p[:, None]).mean(0) + ridge * w
        hess = (gap * (p * (1 - p))[:, None]).T @ gap / len(gap) + (ridge + 1e-6) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 3.0 / (np.abs(step).max() + 1e-12))
    ranked_good, ranked_bad = np.sort(a @ w), np.sort(b @ w)
    # the quantile of all scores at the share of bad labels, from the two samples weighed by their true shares
    values = np.concatenate([ranked_good, ranked_bad])
    mass = np.concatenate([np.full(len(a), (1 - bad_share) / len(a)), np.full(len(b), bad_share / len(b))])
    order = np.argsort(values)
    at = int(np.searchsorted(np.cumsum(mass[order]), bad_share + 1e-12))
    at = min(at, len(order) - 1)
    cut = (values[order][max(at - 1, 0)] + values[order][at]) / 2
    return {"w": w, "centre": centre, "spread": spread, "cut": float(cut), "slope": 1.0 / max(1e-6, float(np.std(values)) / 3)}


def learn(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> dict | None:
    """Model from at most ``per_label`` learning rows of each label; None if a label is missing."""
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).alias("__good")))
    shares = {r["__good"]: r["n"] for r in marked.groupBy("__good").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 2:
        return None
    chosen = sampled(marked.where("__good"), per_label, shares[True], "doc_id").unionAll(
        sampled(marked.where("not __good"), per_label, shares[False], "doc_id"))
    # at most 2 * per_label ids: the stated bound of the sample
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("__good"), pa.array(list(features(b.column("text"))), pa.list_(pa.float64()))], ["id", "good", "f"])

    got = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "__good", "text").mapInArrow(measure, "id long, good boolean, f array<double>").toArrow()
    if got.num_rows == 0:
        return None
    x = np.array(got.column("f").to_pylist(), dtype=float)
    order_ = np.lexsort((*x.T[:3], np.array(got.column("id").to_pylist())))
    x, good = x[order_], np.array(got.column("good").to_pylist(), dtype=bool)[order_]
    if good.all() or not good.any():
        return None
    share = shares[False] / (shares[True] + shares[False])
    model = _train(x[good], x[~good], share)
    bins = _bins(docs, marked, model)
    return model | {"cut": _quantile(bins, share)} if len(bins) else model


def _ranks(column: pa.Array, model: dict) -> np.ndarray:
    """The learned rank of every text, before the cut."""
    return np.clip((features(column) - model["centre"]) / model["spread"], -8, 8) @ model["w"]


def _bins(docs: DataFrame, marked: DataFrame, model: dict) -> np.ndarray:
    """count, least and greatest rank of all learning rows in ``BINS`` equal parts of the possible range."""
    reach = 8 * float(np.abs(model["w"]).sum()) + 1e-12
    wanted = docs.sparkSession.sparkContext.broadcast(sift(marked.select(F.xxhash64(F.col("doc_id").cast("long")).alias("key"))))

    def rank(batches):
        for b in batches:
            some = b.filter(pa.array(hits(wanted.value, b.column("spot").to_numpy())))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(_ranks(some.column("text"), model))], ["doc_id", "z"])

    doc_id = F.col("doc_id").cast("long")
    ranked = docs.where(F.col("doc_id").isNotNull()).select(doc_id.alias("doc_id"), F.xxhash64(doc_id).alias("spot"), "text").mapInArrow(
        rank, "doc_id long, z double")
    part = F.floor((F.col("z") + reach) / (2 * reach) * BINS)
    # at most BINS + 1 rows, whatever the input
    got = (
        ranked.join(marked.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
        .groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("low"), F.max("z").alias("high")).orderBy("part").toArrow())
    return np.column_stack([got.column(c).to_numpy().astype(float) for c in ("n", "low", "high")]) if got.num_rows else np.zeros((0, 3))


def _quantile(bins: np.ndarray, share: float) -> float:
    """Middle between the ranks on both sides of the quantile; inside a part by even spacing."""
    total = np.cumsum(bins[:, 0])

    def value(k: int) -> float:
        at = int(np.searchsorted(total, k, side="right"))
        n, low, high = bins[at]
        return float(low + (high - low) * (k - (total[at] - n)) / max(1.0, n - 1))

    k = min(int(np.floor(share * total[-1] + 1e-9)), int(total[-1]) - 1)
    return (value(max(k - 1, 0)) + value(k)) / 2


def _scores(column: pa.Array, model: dict) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model["slope"] * (_ranks(column, model) - model["cut"]) + np.log(ACCEPT / (1 - ACCEPT)), -35, 35)))


def score(docs: DataFrame, model: dict | None, name: str = "quality_score", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) and the score of every whole text."""
    kept = [c for c in (keep if keep is not None else docs.columns) if c != name]
    rows = docs.select(*kept, F.col("text").alias("__text"))
    if model is None:
        return rows.select(*kept, F.lit(0.5).alias(name))
    schema = docs.select(*kept).withColumn(name, F.lit(0.0)).schema

    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(_scores(b.column(b.num_columns - 1), model))], [*kept, name])

    return rows.mapInArrow(measure, schema)


def accepted(docs: DataFrame, model: dict | None) -> DataFrame:
    """The documents, with all their columns, that score ``ACCEPT`` or more; all of them without a model."""
    if model is None:
        return docs
    at = docs.columns.index("text")

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(_scores(b.column(at), model) >= ACCEPT))

    return docs.mapInArrow(keep, docs.schema)
