"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors are projected to ``M`` dimensions by a Gaussian (2-stable) matrix, so the
squared projected distance over the squared true distance follows a chi-square law
with ``M`` degrees of freedom.  A kd-tree over the projections cuts the table into
cells; each stored part of a cell has a kd-tree of its own.  A query takes leaves in
the order of their projected distance and verifies their vectors exactly, until a
vector nearer than the tenth found so far would have a projection that near with
chance ``SURE`` at least - then it stops.  The same test decides between cells: a
query first searches its own cell, then only the cells the test does not rule out.

Bounds: the cell tree is fitted on at most ``SAMPLE`` vectors and has at most
``CELLS`` cells; a cell is stored in parts of about ``PART`` vectors, so equal or
crowded vectors only make more parts; queries of a cell are split likewise.  Of
equal vectors only the ids that can appear in an answer (k + 1 smallest) are
stored.  Every row is indexed or equal to an indexed one with smaller ids.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, rows without an id, and vectors whose length is not the most common
one take no part; repeated rows of an id count once (of different vectors the first
by hash); with fewer candidates all are returned; ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelode.session import cut_lineage

from .common import sampled

M = 8               # projected dimensions, even
SURE = 0.99
SAMPLE = 20_000
CELLS = 1024
PART = 8192
QUERY_PART = 2048
LEAF = 64


def chi_square_quantile(p: float, m: int = M) -> float:
    """The value below which a chi-square number with ``m`` (even) degrees of freedom lies with chance ``p``."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        term = total = 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - exp(-x / 2) * total < p else (low, x)
    return high


class Tree:
    """kd-tree by median cuts on the widest dimension; leaves are numbered ranges of ``order``."""

    def __init__(self, points: np.ndarray, leaf: int, most: int = 1 << 30):
        self.order = np.arange(len(points))
        self.dim, self.cut, self.kids, self.range = [], [], [], []
        self.low, self.high = [], []
        leaves = 1
        self._add(points, 0, len(points))
        open_ = [(-len(points), 0)]
        while open_ and leaves < most:
            size, node = heapq.heappop(open_)
            a, b = self.range[node]
            own = points[self.order[a:b]]
            if b - a <= leaf:
                continue
            d = int(np.argmax(self.high[node] - self.low[node]))
            if not self.high[node][d] > self.low[node][d]:
                continue                                    # equal points stay together
            cut = float(np.median(own[:, d]))
            left = own[:, d] <= cut
            if left.all():
                left = own[:, d] < cut
                cut = float(own[left, d].max())
            self.order[a:b] = np.concatenate([self.order[a:b][left], self.order[a:b][~left]])
            mid = a + int(left.sum())
            self.dim[node], self.cut[node] = d, cut
            self.kids[node] = (self._add(points, a, mid), self._add(points, mid, b))
            leaves += 1
            for kid in self.kids[node]:
                x, y = self.range[kid]
                heapq.heappush(open_, (x - y, kid))
        self.leaves = [n for n, kids in enumerate(self.kids) if kids is None]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _add(self, points: np.ndarray, a: int, b: int) -> int:
        own = points[self.order[a:b]]
        self.dim.append(-1)
        self.cut.append(0.0)
        self.kids.append(None)
        self.range.append((a, b))
        self.low.append(own.min(0) if len(own) else np.zeros(points.shape[1]))
        self.high.append(own.max(0) if len(own) else np.zeros(points.shape[1]))
        return len(self.dim) - 1

    def place(self, points: np.ndarray) -> np.ndarray:
        """Number of the leaf of every point."""
        number = {n: i for i, n in enumerate(self.leaves)}
        out = np.zeros(len(points), dtype=np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if self.kids[node] is None:
                out[rows] = number[node]
                continue
            left = points[rows, self.dim[node]] <= self.cut[node]
            todo += [(self.kids[node][0], rows[left]), (self.kids[node][1], rows[~left])]
        return out


def projection(size: int, m: int = M) -> np.ndarray:
    return np.random.default_rng(size).normal(size=(size, m))


def nearest(query: np.ndarray, own: np.ndarray, bound: float, own_id: int, tree: Tree, ids: np.ndarray, vectors: np.ndarray,
            k: int, limit: float) -> list[tuple[float, int]]:
    """The k nearest (distance, id) found in one tree, given a k-th distance already known."""
    gap = np.maximum(0, np.maximum(tree.low[tree.leaves] - own, own - tree.high[tree.leaves]))
    reach = np.einsum("ij,ij->i", gap, gap)
    best: list[tuple[float, int]] = []
    for i in np.argsort(reach, kind="stable"):
        if reach[i] > limit * bound * bound:
            break
        a, b = tree.range[tree.leaves[i]]
        rows = tree.order[a:b]
        away = vectors[rows] - query
        d = np.sqrt(np.einsum("ij,ij->i", away, away))
        near = d <= bound
        best += [(x, y) for x, y in zip(d[near].tolist(), ids[rows[near]].tolist(), strict=True) if y != own_id]
        if len(best) >= k:
            best = sorted(best)[:k]
            bound = min(bound, best[-1][0])
    return sorted(best)[:k]


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, is_query: Column, k: int = 10, sure: float = SURE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest vectors found for every row with ``is_query``."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & _usable(F.col("v")))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if common is None:
        return spark.createDataFrame([], result)
    size = common["n"]
    table = cut_lineage(
        rows.where(F.size("v") == size).groupBy("id").agg(F.min_by("v", F.struct(F.xxhash64("v"), "v")).alias("v"), F.max("asks").alias("asks")))
    smallest = Window.partitionBy(F.xxhash64("v"), F.hash("v")).orderBy("id")
    base = table.select("id", "v", F.row_number().over(smallest).alias("n")).where(F.col("n") <= k + 1).select("id", "v")
    matrix = projection(size)
    # the stated bound of the sample
    total = table.count()
    sample = np.array(sampled(table, SAMPLE, total, "id").select("v").toArrow().column("v").to_pylist()).reshape(-1, size)
    cells = Tree(sample @ matrix, LEAF, max(1, min(CELLS, total // PART + 1)))
    place = f"id long, v array<double>, cell int, {', '.join(f'p{i} double' for i in range(M))}"
    names = ["id", "v", "cell", *[f"p{i}" for i in range(M)]]

    def project(batches):
        for b in batches:
            v = b.column("v")
            p = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) @ matrix
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), v, pa.array(cells.place(p).astype(np.int32)), *[pa.array(np.ascontiguousarray(p[:, i])) for i in range(M)]], names)

    stored = cut_lineage(base.mapInArrow(project, place))
    asking = cut_lineage(table.where("asks").select("id", "v").mapInArrow(project, place))
    # one row for each cell, at most CELLS
    about = {r["cell"]: r for r in stored.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), *[f(f"p{i}").alias(f"{f.__name__}{i}") for f in (F.min, F.max) for i in range(M)]).collect()}
    queries_in = {r["cell"]: r["count"] for r in asking.groupBy("cell").count().collect()}
    known = sorted(about)
    parts = {c: -(-about[c]["n"] // PART) for c in known}
    low = np.array([[about[c][f"min{i}"] for i in range(M)] for c in known])
    high = np.array([[about[c][f"max{i}"] for i in range(M)] for c in known])
    limit = chi_square_quantile(sure)

    def count_of(column: str, counts: dict) -> Column:
        steps = [x for c, n in counts.items() if n > 1 for x in (F.lit(c), F.lit(int(n)))]
        return F.coalesce(F.element_at(F.create_map(*steps), F.col(column)), F.lit(1)) if steps else F.lit(1)

    def visit(pairs: DataFrame, n_queries: dict) -> DataFrame:
        """Search of (query, cell) pairs: both sides dealt by cell, part of the cell and part of its queries."""
        qparts = {c: -(-n // QUERY_PART) for c, n in n_queries.items()}
        left = (
            pairs.withColumn("qpart", F.pmod(F.xxhash64("id"), count_of("cell", qparts)).cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), count_of("cell", parts) - 1))))
        right = (
            stored.withColumn("part", F.pmod(F.xxhash64("id"), count_of("cell", parts)).cast("int"))
            .withColumn("qpart", F.explode(F.sequence(F.lit(0), count_of("cell", qparts) - 1))))

        def look(q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(q) and len(s):
                coords = [f"p{i}" for i in range(M)]
                ids, found = s["id"].to_numpy(), np.stack(s["v"].to_numpy())
                tree = Tree(s[coords].to_numpy(), LEAF)
                for qid, v, own, bound in zip(q["id"], q["v"], q[coords].to_numpy(), q["bound"], strict=True):
                    out += [(qid, i, d) for d, i in nearest(np.asarray(v), own, bound, qid, tree, ids, found, k, limit)]
            return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

        keys = ["cell", "part", "qpart"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(look, "query_id long, vec_id long, score double")

    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    first = cut_lineage(visit(asking.withColumn("bound", F.lit(float("inf"))), queries_in))
    ranked = first.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    kth = ranked.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).alias("bound"))
    bounded = asking.join(kth, asking["id"] == kth["query_id"], "left").select(
        *names, F.coalesce("bound", F.lit(float("inf"))).alias("bound"))

    def spread(batches):
        """A row for each further cell that the stopping test does not rule out."""
        cell_of = np.array(known)
        for b in batches:
            p = np.stack([b.column(f"p{i}").to_numpy() for i in range(M)], axis=1)
            bound, own = b.column("bound").to_numpy(), b.column("cell").to_numpy()
            for a in range(0, len(p), 256):
                gap = np.maximum(0, np.maximum(low[None] - p[a:a + 256, None], p[a:a + 256, None] - high[None]))
                reach = np.einsum("ijk,ijk->ij", gap, gap)
                with np.errstate(invalid="ignore"):
                    row, cell = np.nonzero((reach <= limit * (bound[a:a + 256] ** 2)[:, None]) & (cell_of[None] != own[a:a + 256, None]))
                part = b.take(pa.array(row + a))
                yield part.set_column(names.index("cell"), "cell", pa.array(cell_of[cell].astype(np.int32)))

    further = cut_lineage(bounded.mapInArrow(spread, f"{place}, bound double"))
    asked = {r["cell"]: r["count"] for r in further.groupBy("cell").count().collect()}
    both = first.unionAll(visit(further, asked)) if asked else first
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
