import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from hirelode.llm import periodic

from .helpers import LONG, awkward, empty


def plain_runs(words, least=24, repeats=3):
    """Every period tried on every stretch."""
    n, found = len(words), {}
    for d in range(1, n // repeats + 1):
        i = 0
        while i + d < n:
            if words[i] != words[i + d]:
                i += 1
                continue
            j = i
            while j + d < n and words[j] == words[j + d]:
                j += 1
            if j - i + d >= max(least, repeats * d):
                found.setdefault((i, j - i + d), d)         # the first period is the smallest
            i = j
    return sorted((s, m, p) for (s, m), p in found.items())


def sequences():
    rng = random.Random(4)
    for n in (0, 1, 5, 23, 24, 25, 60):
        yield ["a"] * n
    for case in range(250):
        size, out = rng.choice([1, 2, 2, 3, 5, 30]), []
        while len(out) < rng.randrange(10, 160):
            if rng.random() < 0.6:
                part = [rng.randrange(size) for _ in range(rng.randrange(1, 12))]
                out += (part * rng.randrange(1, 12))[:rng.randrange(1, 90)]
            else:
                out += [rng.randrange(size) for _ in range(rng.randrange(1, 12))]
        yield [str(x) for x in out]
    a, b = ["0"], ["0", "1"]
    while len(b) < 400:                                     # Fibonacci words have many runs, here of few repeats
        a, b = b, b + a
    yield b
    yield (["p", "q"] * 20 + ["r"]) * 6                     # runs inside a run


@pytest.mark.parametrize("least,repeats", [(24, 3), (6, 3), (3, 3), (10, 4)])
def test_runs_equal_brute_force(least, repeats):
    total = 0
    for words in sequences():
        codes = np.unique(words, return_inverse=True)[1] if words else np.zeros(0, np.int64)
        got = periodic.runs(codes, least, repeats)
        assert got == plain_runs(words, least, repeats), words
        total += len(got)
    assert total > 60


def test_suffixes():
    for words in sequences():
        codes = np.array([hash(w) for w in words], dtype=np.int64)
        order, common = periodic.suffixes(codes)
        ranks = np.unique(codes, return_inverse=True)[1].tolist()
        true = sorted(range(len(ranks)), key=lambda i: ranks[i:])
        assert order.tolist() == true
        for a, b, c in zip(true, true[1:], common.tolist(), strict=False):
            assert ranks[a:a + c] == ranks[b:b + c] and ranks[a + c:a + c + 1] != ranks[b + c:b + c + 1]


def test_long_text_of_one_word_and_many_left_words():
    codes = np.zeros(20_000, dtype=np.int64)
    assert periodic.runs(codes) == [(0, 20_000, 1)]
    passage = list(range(20))
    many = [x for i in range(3000) for x in (100 + i, *passage)]        # one passage after 3000 different words
    assert periodic.runs(np.array(many)) == []


def test_texts_without_repeats_are_told_apart():
    texts = ["a b c " * 30, "x y z", None, "", " ".join(map(str, range(500))), " ".join(map(str, range(16))) + " q " + " ".join(map(str, range(16)))]
    assert periodic.repeating(pa.array(texts), 16).tolist() == [0, 5]


def digests(words):
    found = plain_runs(words)
    gone = {i for s, m, p in found for i in range(s + p, s + m)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(((-m / p, s, p, m) for s, m, p in found), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(found), *((best[1], best[3], best[2], 1000 * best[3] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(left))


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words and doc_id is not None:
        n, g = len(words), h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return [w.decode() for w in words]


def test_query_on_small_documents(spark, tmp_path):
    from hirelode.llm import queries
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400").select("doc_id", "text")
    rows = docs.collect() + [(5000 + i, "spam  eggs\n" * 20 + "end\x0bstop") for i in range(3)] + [(6000, None), (6001, ""), (6002, "one"), (None, "a " * 30)]
    rows = [r for r in map(tuple, rows) if len((r[1] or "").split()) < 3000]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        assert got[doc_id] == digests(planted(doc_id, text)), doc_id
    assert sum(r[0] > 0 for r in got.values()) > 20


def test_awkward_documents(spark):
    docs = awkward(spark).withColumnRenamed("slot", "runs")
    rows = periodic.find(docs, ["doc_id", "lang"]).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["runs"] == [] and by[2]["collapsed"] == "" and by[2]["n_words"] == 0 and by[4]["n_words"] == 0
    assert [tuple(r) for r in by[5]["runs"]] == [(0, len(LONG.split()), 3)] and by[5]["collapsed"] == "lorem ipsum dolor"
    assert periodic.find(empty(spark), ["doc_id"]).count() == 0 and periodic.plant(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        periodic.runs(np.zeros(9, np.int64), 6, 2)
