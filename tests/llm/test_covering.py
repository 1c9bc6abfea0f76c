import random
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from hirelode.llm import covering

from .helpers import awkward, empty
from .test_pairs import union


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids = list(prints)
    return union(ids, [(a, b) for a, b in combinations(ids, 2) if (prints[a] ^ prints[b]).bit_count() <= 2])


def test_hash_is_the_one_of_the_engine(spark):
    one = spark.createDataFrame([("żółw the quick",)], "t string").select(F.xxhash64("t")).first()[0]
    assert one % (1 << 64) == xxhash.xxh64_intdigest("żółw the quick".encode(), 42)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_every_difference(radius):
    tables = covering.masks(radius)
    assert len(tables) == 2 ** (radius + 1) - 1
    for size in range(1, radius + 1):
        for bits in combinations(range(64) if radius < 3 else range(0, 64, 3), size):
            assert any(not any(m >> i & 1 for i in bits) for m in tables)
    assert all(24 <= m.bit_count() <= 44 for m in tables)


def test_links_lose_no_component(spark, monkeypatch):
    monkeypatch.setattr(covering, "CROWD", 6)
    rng = random.Random(8)
    prints = set()
    for _ in range(40):                                     # chains, stars and crowds of near fingerprints
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 12])):
            prints.add(x)
            for i in rng.sample(range(64), rng.randrange(4)):
                x ^= 1 << i
    centre = rng.getrandbits(64)
    prints |= {centre ^ 1 << i ^ 1 << j for i in range(12) for j in range(i)}       # one bucket with many members
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    found = covering.links(spark.createDataFrame([(x,) for x in signed], "fingerprint long")).collect()
    pairs = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in found]
    assert all(0 < (a ^ b).bit_count() <= 2 for a, b in pairs)
    assert union(prints, pairs) == plain_components(dict(zip(prints, prints, strict=True)))
    assert len(pairs) < 12 * len(prints)


def test_near_copies_equal_all_pairs(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(30):
        base = [rng.choice(words) for _ in range(400)]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(400)] = rng.choice(words)
            rows.append((1000 - len(rows), " ".join(copy)))
    rows += [(2000 + i, rows[0][1].upper()) for i in range(300)]        # a third of all rows and more is one text
    rows += [(5, None), (6, ""), (7, "  "), (8, "One two"), (9, "one TWO")]
    got = {r["doc_id"]: r for r in covering.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {d: plain_fingerprint(t) for d, t in rows}
    assert {d: r["fingerprint"] % (1 << 64) for d, r in got.items()} == prints
    expected = plain_components(prints)
    assert {d: r["component_id"] for d, r in got.items()} == expected
    assert len(set(expected.values())) < len({*prints.values()})       # different fingerprints did link


def test_awkward_documents(spark):
    docs = awkward(spark).withColumn("fingerprint", F.lit("mine")).withColumn("component_id", F.lit(None).cast("long"))
    rows = covering.near_copies(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["fingerprint"], r["component_id"]))
    assert by[2] == by[3] == by[4] == [(0, 2)] and len(by[1]) == 2 and by[None][0][1] is None
    kept = covering.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "5", "6", "None"]
    assert covering.near_copies(empty(spark)).count() == 0 and covering.one_of_each(empty(spark)).count() == 0


def test_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(5000))
    whole = covering.fingerprint(text.encode())
    monkeypatch.setattr(covering, "PIECE", 64)
    assert covering.fingerprint(text.encode()) == whole == plain_fingerprint(text)


def test_query(spark):
    from hirelode.llm import queries
    rows = queries.QUERIES["op13_covering_copies"](spark, "/root/testdata/sf0.01").collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {d: f"{x:016x}" for d, x in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == plain_components(prints)
