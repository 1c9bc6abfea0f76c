import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from hirelode.llm import jaccard, line_dedup
from hirelode.llm.components import components

from .helpers import awkward, empty


def union(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [x for x in links if x[0] != x[1]]
    assert got == union({n for x in real for n in x}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, size=4):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def plain_join(docs):
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(d for d in sets if sets[d])
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    root = union(sets, links)
    return {d: (len(sets[d]), root[d]) for d in sets}


def chained_copies(rng, n, start, words=60):
    """Copies of copies: neighbours in the chain link, far ones do not; the first of them is copied often."""
    text = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = [(start, " ".join(text))]
    for i in range(1, n):
        text = list(text)
        if i % 3:
            text[rng.randrange(words)] = f"w{rng.randrange(400)}"
        out.append((start + i, " ".join(text)))
    return out


@pytest.mark.parametrize("tile, chain, hot, batch", [(512, 6, 20, 10_000), (8, 6, 20, 10_000), (8, 2, 4, 7), (512, 3, 20, 5)])
def test_join_equals_all_pairs(spark, monkeypatch, tile, chain, hot, batch):
    """Tiles, chains cut between batches and tokens dealt to several tasks do not change the result."""
    for name, value in (("TILE", tile), ("CHAIN", chain), ("HOT", hot)):
        monkeypatch.setattr(jaccard, name, value)
    chains = jaccard._chains
    monkeypatch.setattr(jaccard, "_chains", lambda batches, share: chains((b.slice(i, batch) for b in batches for i in range(0, b.num_rows, batch)), share))
    rng = random.Random(5)
    shared = " ".join(f"p{i}" for i in range(50))                 # a passage of many documents
    docs = chained_copies(rng, 90, 1000) + chained_copies(rng, 40, 2000, 20) + [
        (3000 + i, shared + " " + " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(12)))) for i in range(70)]
    docs += [(4000 + i, " ".join(f"q{rng.randrange(6)}" for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    rng.shuffle(docs)
    got = jaccard.join(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == plain_join(docs)


def tile_batch(members):
    """One group of one tile: (key, comp) of sets of 100 tokens that differ in at most four."""
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 57, 96, dtype=np.uint64)
    sets = [np.sort(np.concatenate([common, rng.integers(0, 1 << 57, 4, dtype=np.uint64)])) for _ in members]
    bits = jaccard.bitmaps(np.concatenate(sets), np.arange(0, 100 * len(sets) + 1, 100))
    k = len(members)
    same = lambda v: pa.array([v] * k, pa.int64())
    return pa.RecordBatch.from_arrays(
        [same(7), same(0), same(0), same(0), same(100), pa.array([m[0] for m in members]), same(0), pa.array([m[1] for m in members]), pa.array(bits)],
        ["token", "i", "j", "side", "n", "key", "pos", "comp", "bits"])


def test_tile_meets_itself_from_one_copy_of_its_rows():
    """All pairs of different components come from rows on one side; a group with more than the likely partners says so."""
    members = [(10 + i, i // 2) for i in range(8)]
    pairs = {(a, b) for a, x in members for b, y in members if a > b and x != y}

    def given(likely):
        rows = [r for b in jaccard._tile_batches([tile_batch(members)], 85, likely) for r in b.to_pylist()]
        return {(r["a"], r["b"]) for r in rows if r["token"] is None}, {r["token"] for r in rows if r["token"] is not None}

    assert given(None) == (pairs, set()) and given(7) == (pairs, set())
    some, again = given(2)
    assert some < pairs and again == {7}


def test_tiles_are_dealt_once(spark):
    """A member of a group of one tile is one row."""
    entries = spark.createDataFrame([(1, k, 100, 0) for k in range(20)], "token long, key long, n long, pos long")
    kept = spark.createDataFrame([(k, bytes(128)) for k in range(20)], "key long, bits binary")
    seen = []
    dealt = type(entries).sortWithinPartitions

    def watch(df, *order):
        seen.append(df.count())
        return dealt(df, *order)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(entries), "sortWithinPartitions", watch)
        jaccard._tiles(entries, kept, None, 85, 4)
    assert seen == [20]                                          # of 20 components; 58 with copies for the other side and for a tile of one


def test_shuffle_files_go_with_their_action(spark):
    """Finished steps leave no pile of shuffle files, without waiting for the driver's garbage collection.

    A task that still runs when its action ends may write a file after that; without the setting dozens stay.
    """
    def files():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {blocks.apply(i).getName() for i in range(blocks.size()) if blocks.apply(i).getName().endswith(".data")}

    before = files()
    jaccard.join(spark.createDataFrame([(i, f"some words {i % 7} of a text") for i in range(50)], "doc_id long, text string"))
    wait = time.time() + 20
    while len(files() - before) > 3 and time.time() < wait:      # they go in the background
        time.sleep(0.2)
    assert len(files() - before) <= 3


def test_join_awkward_rows(spark):
    docs = awkward(spark, (9, "ONE", "en", "a", 3, "x", 1), (10, "", "en", "a", 0, "x", 1))
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect()}
    assert got == {(1, 10, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 3, 5), (None, 3, None), (6, 1, 6), (9, 1, 6), (10, 0, 10)}
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 10]
    assert jaccard.join(empty(spark)).count() == 0 and jaccard.one_of_each(empty(spark)).count() == 0


def normal(line):
    return re.sub(r"[^a-z0-9\x80-\U0010ffff]+", " ", line.lower()).strip(" ")


def simhash(text):
    words = text.split(" ")
    count = [0] * 63
    for w in words:
        v = xxhash.xxh64_intdigest(w.encode(), 42)
        for i in range(63):
            count[i] += v >> i & 1
    return sum(1 << i for i in range(63) if 2 * count[i] > len(words))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_dropped(docs):
    places = {}
    for d, t in docs:
        for i, line in enumerate((t or "").split("\n")):
            if normal(line):
                places.setdefault(normal(line), set()).add((d, i))
    names = sorted(places)
    hashes = [simhash(n) for n in names]
    links = []
    for i, a in enumerate(names):
        for j in range(i):
            x, y = a.split(" "), names[j].split(" ")
            if bin(hashes[i] ^ hashes[j]).count("1") <= 3 and distance(x, y) <= int(max(len(x), len(y)) * 0.2 + 1e-9):
                links.append((a, names[j]))
    root = union(names, links)
    groups = {}
    for n in names:
        groups.setdefault(root[n], set()).update(places[n])
    return {x for g in groups.values() for x in sorted(g)[1:]}, len(links)


def test_line_dedup_equals_all_pairs(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [" ".join(word() for _ in range(120)) for _ in range(4)]
    docs = []
    for d in range(60):
        lines = [f"single line {d} " + " ".join(f"x{rng.randrange(50)}" for _ in range(5))]
        for b in base[:1 + d % 4]:
            w = b.split()
            if d % 2:
                w[rng.randrange(120)] = word()
            lines.append(" ".join(w).upper() if d % 5 == 0 else " ".join(w) + "!!")
        docs.append((d, "\n".join([*lines, "", "Page 12 of 30", "same words in other order" if d % 2 else "order other in words same"])))
    expected, n_links = plain_dropped(docs)
    got = line_dedup.summary(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {(r["doc_id"], i) for r in got for i in r["dropped"]} == expected
    assert n_links > 100 and len(expected) > 100 and len(got) == len(docs)


def test_line_texts_are_read_for_tried_pairs_only(spark, monkeypatch):
    """Lines that only fill a crowded bucket, with nobody near, have their texts left alone."""
    monkeypatch.setattr(line_dedup, "_buckets", lambda: F.array(F.lit(1).cast("long")))      # one bucket for all
    read, fetch, conf = [], line_dedup._texts, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    monkeypatch.setattr(line_dedup, "_texts", lambda *a: read.append(fetch(*a)) or read[-1])
    copy = " ".join(f"copy{i}" for i in range(200))
    docs = [(i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(30)] + [(100, copy), (101, copy + " more")]
    expected, _ = plain_dropped(docs)
    spark.conf.unset(conf)
    got = {(r["id"], r["line_no"]) for r in line_dedup.dropped_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == expected and len(got) == 1 and max(r.count() for r in read) == 2
    assert spark.conf.get(conf) == "true"                         # finished steps keep no shuffle files


def test_line_dedup_awkward_rows(spark):
    text = "Keep this line once.\n\n!!!\nKEEP this   line once\nno id here at all, none"
    docs = awkward(spark, (11, text, "en", "a", 3, "x", 1), (12, "keep this line once", "en", "a", 3, "x", 1))
    rows = {r["doc_id"]: r for r in line_dedup.summary(docs).collect()}
    assert rows[11]["dropped"] == [3] and rows[11]["n_lines"] == 5 and rows[12]["dropped"] == [0]
    assert rows[2]["n_lines"] == 0 and rows[3]["dropped"] == [] and rows[1]["dropped"] == []
    cleaned = line_dedup.clean(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in cleaned.collect()}
    assert texts[11] == "Keep this line once.\n\n!!!\nno id here at all, none" and texts[12] == "" and texts[2] is None
    assert line_dedup.summary(empty(spark)).count() == 0 and line_dedup.clean(empty(spark)).count() == 0


def test_line_hashes_have_all_bits(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g\nMixed CASE 42")], "doc_id long, text string")
    got = {r["line_no"]: r["hash"] for r in line_dedup._hashed(docs, "doc_id").collect()}
    assert got == {0: simhash("a b c d e f g"), 1: simhash("mixed case 42")}


def test_line_hashes_of_long_lines_and_repeated_rows(spark):
    """Counters of nine bits hold a part of a line; neither more words nor rows that come again spill into the next counter."""
    rng = random.Random(4)
    lines = [" ".join(f"w{rng.randrange(9)}" for _ in range(n)) for n in (40, 255, 256, 257, 511, 512, 3000)]
    docs = spark.createDataFrame([(1, "\n".join(lines))] * 30, "doc_id long, text string")
    got = {(r["line_no"], r["size"], r["hash"]) for r in line_dedup._hashed(docs, "doc_id").collect()}
    assert got == {(i, len(t.split()), simhash(t)) for i, t in enumerate(lines)}


def test_lines_alone_in_their_buckets_go(spark):
    """Of lines far apart none is left to compare, however many there are; near ones all meet."""
    rng = random.Random(6)
    far = [(i, rng.getrandbits(63), 40) for i in range(20_000)]
    near = [(30_000 + i, far[i][1] ^ sum(1 << b for b in rng.sample(range(63), 1 + i % 3)), 40) for i in range(300)]
    keyed = spark.createDataFrame(far + near, "key long, hash long, size int")
    crowded = line_dedup._crowded(keyed)
    assert crowded.select("key").distinct().count() < 700           # 600 of them near
    pairs, _ = line_dedup._met(crowded)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(30_000 + i, i) for i in range(300)}


@pytest.mark.parametrize("crowd", [1, 4])
def test_line_dedup_of_large_buckets(spark, monkeypatch, crowd):
    """Stars and pairs across components find what all pairs find."""
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    rng = random.Random(9)
    base = [f"c{i}" for i in range(200)]
    docs = [(0, " ".join(base))]
    for d in range(1, 40):
        w = list(docs[d // 2][1].split(" "))
        w[rng.randrange(200)] = f"d{rng.randrange(50)}"
        docs.append((d, " ".join(w)))
    expected, n_links = plain_dropped(docs)
    got = {(r["id"], r["line_no"]) for r in line_dedup.dropped_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == expected and n_links > 60
