import numpy as np
import pytest

from hirelode.llm import whitening


def plain(rows, k=8):
    """Everything from numpy's own eigenvalues, with whole numbers for the sums."""
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(0)
    z = (n * x - sums).astype(float) / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-values)[:k]
    return n, ((n * x - sums) ** 2).sum(1), z @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum()


@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_counts_equal_the_eigenvalues(d):
    rng = np.random.default_rng(d)
    for _ in range(20):
        m = rng.normal(size=(d, d)).round(1)
        m = m + m.T
        values = np.linalg.eigvalsh(m)
        for shift in [*rng.normal(size=5) * 3, 0.05]:
            if np.abs(values - shift).min() > 1e-9:
                assert whitening.count_above(m, shift) == (values > shift).sum()
    assert whitening.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1      # only a double pivot will do


def test_leading_values_with_clusters_and_gaps():
    rng = np.random.default_rng(3)
    base = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    for spectrum in ([9, 7, 7, 7, 3, 3, 1, 0.5] + [0.1] * 22, [1e6, 1e3, 1, 1e-3] + [0] * 26, [5 + i * 1e-9 for i in range(30)], [4] * 30, [2] + [0] * 29):
        m = (base * np.array(spectrum, dtype=float)) @ base.T
        m = (m + m.T) / 2
        values, vectors = whitening.leading(m, 8)
        true = np.sort(spectrum)[::-1][:8]
        true = true[true > 4 * 30 * whitening.EPS * np.abs(m).sum(1).max()]
        assert len(values) == len(true) and np.allclose(values, true, rtol=1e-7, atol=1e-12 * max(spectrum))
        assert np.allclose(vectors @ vectors.T, np.eye(len(values)), atol=1e-9)
        assert np.abs(m @ vectors.T - vectors.T * values).max() <= 1e-8 * max(spectrum)
    assert len(whitening.leading(np.zeros((4, 4)))[0]) == 0


def result(spark, rows, name="embedding"):
    table = spark.createDataFrame(rows, f"vec_id long, {name} array<double>, n string, whitened string")
    found = whitening.whiten(table, whitening.fit(table, embedding=name), ["vec_id"], name)
    return {r["vec_id"]: r for r in found.collect()}


def test_equals_plain_whitening(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)))]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]                # one vector very often
    got = result(spark, [(*r, "x", None) for r in rows])
    n, deviation, whitened, explained = plain(rows)
    assert len(got) == len(rows)
    mine = np.array([got[i]["whitened"] for i, _ in rows])
    signs = np.sign((mine * whitened).sum(0))
    assert np.abs(mine - whitened * signs).max() < 1e-8
    for at, (i, _) in enumerate(rows):
        assert got[i]["n"] == n and got[i]["deviation"] == deviation[at] and got[i]["identity_error"] < 1e-9
        assert np.allclose(got[i]["explained"], explained, rtol=1e-9)


def test_awkward_vectors(spark):
    none = float("nan")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0]), (3, None), (4, []), (5, [none, 1.0]), (6, [None, 1.0]), (7, [float("-inf"), 1.0]),
            (8, [1e300, 1.0]), (None, [0.0, 0.0]), (9, [1.0, 2.0, 3.0]), (10, [0.0, 0.5, 3.0])]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, n string, size string")
    found = whitening.whiten(table, whitening.fit(table), ["vec_id"]).collect()
    ids = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n"], len(r["whitened"])) for r in found)
    assert ids == [(False, 1, 4, 2), (False, 2, 4, 2), (False, 2, 4, 2), (False, 9, 2, 1), (False, 10, 2, 1), (True, 0, 4, 2)]
    same = table.where("vec_id = 2")
    assert [r["whitened"] for r in whitening.whiten(same, whitening.fit(same), ["vec_id"]).collect()] == [[], []]
    none = table.where("false")
    assert whitening.fit(none) == {} and whitening.whiten(none, {}, ["vec_id"]).count() == 0


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(i * 10 ** 8 + 1), float(-i)]) for i in range(50)]
    got = result(spark, [(*r, None, None) for r in rows])
    n, deviation = plain(rows, 2)[:2]
    assert [got[i]["deviation"] for i in range(50)] == [d if d < 1 << 63 else None for d in deviation]


def test_query(spark):
    from hirelode.llm import queries
    rows = queries.QUERIES["op11_whiten"](spark, "/root/testdata/sf0.01").collect()
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    n, deviation, whitened, explained = plain([tuple(r) for r in table])
    at = {r["vec_id"]: i for i, r in enumerate(table)}
    assert len(rows) == 8 * len(table) and {r["component"] for r in rows} == set(range(1, 9))
    mine = np.zeros(whitened.shape)
    for r in rows:
        i = at[r["vec_id"]]
        mine[i, r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[i] and abs(r["explained"] / explained[r["component"] - 1] - 1) < 1e-9 and r["identity_error"] < 1e-9
    assert np.abs(mine - whitened * np.sign((mine * whitened).sum(0))).max() < 1e-7
