"""Whitening of embeddings on their leading components, by spectrum slicing.

Vectors become whole numbers; their covariance is a sum of one matrix for each task.
Its leading eigenvalues are found one by one: a symmetric LDL factorisation with
pivoting of ``V - s I`` has as many positive pivots as V has eigenvalues above s
(Sylvester), so bisection on these counts isolates the k-th one; inverse iteration, then
Rayleigh quotient iteration inside the isolated interval converge cubically; two further
counts just below and above the value found certify its number.  Values closer than
rounding are one cluster: their vectors are kept orthogonal to those found before.

The driver holds one d x d matrix for each length d of vectors, nothing that grows with
the rows; tasks hold an Arrow batch and d x d sums.  Sums of the whole numbers are exact.

Defined results: rows whose vector is null or empty, or holds null or non-finite entries
or such as lie beyond ``LARGEST``, are dropped; vectors of different lengths are fitted
and numbered apart; repeated rows count each; components without variance (eigenvalue
within rounding of zero) are not given, so equal vectors or a single one have none; null
ids stay; a deviation too large for a long is null; an empty table stays empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
LARGEST = float(1 << 33)
ALPHA = (1 + 17 ** 0.5) / 8     # balances the growth of single and double pivots
EPS = float(np.finfo(float).eps)


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above ``shift``: positive pivots of LDL with complete pivoting."""
    a = matrix - shift * np.eye(len(matrix))
    count, at = 0, 0

    def swap(i: int, j: int) -> None:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]

    while at < len(a):
        rest = np.abs(a[at:, at:])
        diagonal = rest.diagonal().copy()
        i = int(np.argmax(diagonal))
        np.fill_diagonal(rest, 0)
        r, c = divmod(int(np.argmax(rest)), len(rest))
        if max(diagonal[i], rest[r, c]) == 0:
            break                                   # what is left equals the shift
        if diagonal[i] >= ALPHA * rest[r, c]:
            swap(at, at + i)
            count += bool(a[at, at] > 0)
            column = a[at + 1:, at].copy()
            a[at + 1:, at + 1:] -= np.outer(column, column / a[at, at])
            at += 1
        else:                                       # a pivot of two rows has one eigenvalue of either sign
            r, c = sorted((r, c))
            swap(at, at + r)
            swap(at + 1, at + c)
            count += 1
            columns = a[at + 2:, at:at + 2].copy()
            a[at + 2:, at + 2:] -= columns @ np.linalg.solve(a[at:at + 2, at:at + 2], columns.T)
            at += 2
    return count


def _iterate(matrix: np.ndarray, shift: float, near: np.ndarray, start: np.ndarray, norm: float) -> tuple[float, np.ndarray, float]:
    """Two inverse iterations at ``shift``, then Rayleigh quotient iterations: value, vector, residual."""
    x, eye, best = start, np.eye(len(matrix)), None
    for step in range(16):
        try:
            x = np.linalg.solve(matrix - shift * eye, x)
        except np.linalg.LinAlgError:               # the shift is an eigenvalue to the last bit
            x = np.linalg.solve(matrix - (shift + EPS * norm) * eye, x)
        for _ in range(2 if len(near) else 0):
            x = x - near.T @ (near @ x)
        x = x / np.linalg.norm(x)
        value = float(x @ matrix @ x)
        residual = float(np.linalg.norm(matrix @ x - value * x))
        if best is None or residual < best[2]:
            best = (value, x, residual)
        elif step > 3:
            break                                   # down to rounding
        if step:
            shift = value
    return best


def leading(matrix: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The up to ``k`` largest eigenvalues above rounding, falling, and their unit vectors as rows."""
    d = len(matrix)
    norm = float(np.abs(matrix).sum(1).max()) if d else 0.0
    counts: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = count_above(matrix, shift)
        return counts[shift]

    tiny = 4 * d * EPS * norm
    values, vectors = [], np.zeros((0, d))
    top, bottom = norm * (1 + 1e-12) + tiny, tiny
    random = np.random.default_rng(11)
    while norm > 0 and len(values) < min(k, d) and above(bottom) > len(values):
        number = len(values) + 1
        low = max([s for s, c in counts.items() if c >= number], default=bottom)
        high = min([s for s, c in counts.items() if c < number and s > low], default=top)
        above(high)
        while True:
            alone = above(low) == number and above(high) == number - 1
            if alone or high - low <= tiny:
                near = vectors[[i for i, v in enumerate(values) if abs(v - (low + high) / 2) <= high - low + 1e-6 * norm]]
                value, vector, residual = _iterate(matrix, (low + high) / 2, near, random.normal(size=d), norm)
                margin = 2 * residual + tiny
                if low - margin <= value <= high + margin and above(value - margin) >= number and above(value + margin) < number:
                    break                           # the counts on both sides certify the number
                if high - low <= tiny / 4:
                    raise ArithmeticError(f"eigenvalue {number} is not certified")
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) >= number else (low, middle)
        vector = vector * np.sign(vector[np.argmax(np.abs(vector))])
        values.append(value)
        vectors = np.vstack([vectors, vector])
    return np.array(values), vectors


@dataclass
class Model:
    """What is known of the vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray = None
    vectors: np.ndarray = None
    explained: list[float] = None
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: the whole part goes first, exactly."""
        whole = [s // self.n for s in self.sums]
        part = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])
        return (x - np.array(whole, dtype=np.int64)).astype(float) - part

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors.T / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of the squares of n x - S, in whole numbers throughout."""
        largest = self.n * float(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        if largest * largest * x.shape[1] < 2 ** 62:
            away = self.n * x - np.array(self.sums, dtype=np.int64)
            return np.einsum("ij,ij->i", away, away).tolist()
        away = self.n * x.astype(object) - np.array(self.sums, dtype=object)
        return [s if s < 1 << 63 else None for s in (away * away).sum(1).tolist()]


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False))


def _rows(vectors: DataFrame, keep: list[str], embedding: str) -> DataFrame:
    v = F.col(embedding).cast("array<double>")
    return vectors.select(*keep, v.alias("__v")).where(usable(F.col("__v")))


def _by_length(column: pa.Array):
    """(rows, whole numbers) for each length of vectors in a batch."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        c = flat[starts[rows][:, None] + np.arange(size)]
        yield rows, np.floor(SCALE * c).astype(np.int64) + OFFSET


def _summed(rows: DataFrame, per_batch, kind: str) -> dict[int, np.ndarray]:
    """Sums over all rows of the matrices that ``per_batch`` gives, one for each length; each task hands on one for each length."""
    def task(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in _by_length(b.column(b.num_columns - 1)):
                total[x.shape[1]] = total.get(x.shape[1], 0) + per_batch(x)
        for size, m in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(m), size)), pa.array(np.arange(len(m))), pa.array(m.tolist(), pa.list_(pa.int64() if kind == "long" else pa.float64()))],
                ["size", "i", "row"])

    parts = rows.mapInArrow(task, f"size long, i long, row array<{kind}>")
    exact = "decimal(38,0)" if kind == "long" else "double"
    found = parts.select("size", "i", F.posexplode("row").alias("j", "x")).groupBy("size", "i", "j").agg(F.sum(F.col("x").cast(exact)).alias("x")).toArrow()
    size, i, j = (found.column(c).to_numpy() for c in ("size", "i", "j"))
    x = np.array(found.column("x").to_pylist(), dtype=object if kind == "long" else float)
    out = {}
    for s in np.unique(size):
        own = size == s
        out[int(s)] = np.zeros((i[own].max() + 1, j[own].max() + 1), dtype=x.dtype)
        out[int(s)][i[own], j[own]] = x[own]
    return out


def fit(vectors: DataFrame, k: int = COMPONENTS, embedding: str = "embedding") -> dict[int, Model]:
    """The model of each length of vectors, fitted on every row."""
    rows = _rows(vectors, [], embedding)
    first = _summed(rows, lambda x: np.vstack([np.full(x.shape[1], len(x)), x.sum(0)]), "long")
    models = {size: Model(int(m[0, 0]), [int(s) for s in m[1]]) for size, m in first.items()}

    def scatter(x):
        z = models[x.shape[1]].centred(x)
        return z.T @ z

    for size, m in _summed(rows, scatter, "double").items():
        own = models[size]
        cov = (m + m.T) / (2 * own.n)
        own.values, own.vectors = leading(cov, k)
        own.explained = [float(v) / float(np.trace(cov)) for v in own.values]

    def moments(x):
        w = models[x.shape[1]].whiten(x)
        w = np.hstack([w, np.ones((len(w), 1))])
        return w.T @ w                              # the last row holds the sums

    for size, m in _summed(rows, moments, "double").items():
        own, mean = models[size], m[-1, :-1] / m[-1, -1]
        off = m[:-1, :-1] / own.n - np.outer(mean, mean) - np.eye(len(mean))
        own.identity_error = float(np.abs(off).max(initial=0))
    return models


def whiten(vectors: DataFrame, models: dict[int, Model], keep: list[str], embedding: str = "embedding") -> DataFrame:
    """``keep``, n, deviation, and the arrays whitened and explained of every usable row whose length has a model."""
    rows = _rows(vectors, keep, embedding)
    result = "n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    names = [*keep, "n", "deviation", "whitened", "explained", "identity_error"]

    def task(batches):
        for b in batches:
            for at, x in _by_length(b.column(len(keep))):
                own = models.get(x.shape[1])
                if own is None:
                    continue
                kept = b.select(list(range(len(keep)))).take(pa.array(at))
                floats = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(np.full(len(x), own.n)), pa.array(own.deviation(x), pa.int64()), pa.array(own.whiten(x).tolist(), floats),
                     pa.array([own.explained] * len(x), floats), pa.array(np.full(len(x), own.identity_error))], names)

    return rows.mapInArrow(task, StructType([*rows.schema.fields[:-1], *StructType.fromDDL(result).fields]))
