import itertools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hirelode.llm import grams, language, pii, quality
from hirelode.llm.common import held_out

from .helpers import awkward, empty

FOLDER = "/root/testdata/sf0.001"


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    texts = ["Hello wörld  again", None, "", "x", "hello WÖRLD again " * 3, "a\tb\nc\x0bd"]
    def all_hashes():
        raw, offsets = grams.text_bytes(pa.array(texts))
        _, _, value, first = grams.words(raw, offsets)
        return [value[first[i]:first[i + 1]].tolist() for i in range(len(texts))]
    whole = all_hashes()
    assert [len(h) for h in whole] == [3, 0, 0, 1, 9, 4]
    assert whole[0][0] == whole[4][0] and whole[0][1] != whole[4][1]      # only A-Z are folded
    for piece in (1, 2, 5, 11):
        monkeypatch.setattr(grams, "PIECE", piece)
        assert all_hashes() == whole


def test_quality_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.learn(docs, labels)
    got = quality.score(docs, model, keep=["doc_id"]).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    right = sum((r["quality_score"] >= quality.ACCEPT) == (r["quality"] == 1) for r in got)
    assert len(got) > 50 and right / len(got) > 0.95
    assert all(0 <= r["quality_score"] <= 1 for r in got)


def test_quality_pair_loss_is_at_its_least():
    """The weights against small changes, by the mean pair loss written out."""
    rng = np.random.default_rng(9)
    good, bad = rng.normal(0.4, 1, (60, 3)), rng.normal(-0.4, 1, (50, 3))
    model = quality._train(good, bad, 0.5)
    a, b = ((x - model["centre"]) / model["spread"] for x in (good, bad))
    draw = np.random.default_rng(5)
    i, j = draw.integers(0, 60, quality.PAIRS), draw.integers(0, 50, quality.PAIRS)

    def loss(w):
        beats = np.array([np.log1p(np.exp(-float(np.dot(np.clip(a[x] - b[y], -8, 8), w)))) for x, y in zip(i[:], j[:], strict=True)])
        return beats.mean() + 0.5e-3 * float(w @ w)

    least = loss(model["w"])
    for k in range(3):
        for step in (-0.02, 0.02):
            moved = model["w"].copy()
            moved[k] += step
            assert loss(moved) > least


def test_quality_cut_is_the_quantile_of_all_learning_rows(spark):
    """With a sample far smaller than the learning rows; ties at the cut included."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = docs.unionAll(docs.limit(40))
    model = quality.learn(docs, labels, per_label=30)
    bad = {r["doc_id"]: r["quality"] < 0.5 for r in labels.where(~held_out(F.col("doc_id"))).collect()}
    texts = [r["text"] for r in docs.collect() if r["doc_id"] in bad]
    ranks = np.sort(quality._ranks(pa.array(texts), model))
    k = int(np.floor(sum(bad.values()) / len(bad) * len(ranks) + 1e-9))
    width = 16 * np.abs(model["w"]).sum() / quality.BINS
    assert len(ranks) > 60 and abs(model["cut"] - (ranks[k - 1] + ranks[k]) / 2) <= width
    few = np.array([[3, 0.0, 1.0], [1, 5.0, 5.0], [4, 7.0, 7.0]])
    assert [quality._quantile(few, s) for s in (0.0, 1 / 8, 3 / 8, 4 / 8, 1.0)] == [0.0, 0.25, 3.0, 6.0, 7.0]


def test_quality_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (3, 0), (6, None), (None, 1), (5, 0)], "doc_id long, quality int")
    docs = awkward(spark).withColumn("quality_score", F.lit("mine"))
    model = quality.learn(docs, labels)
    got = quality.score(docs, model)
    assert got.columns == [c for c in docs.columns if c != "quality_score"] + ["quality_score"] and got.count() == docs.count()
    blank = {round(r["quality_score"], 9) for r in got.where("text is null or trim(text) = ''").collect()}
    assert len(blank) <= 2
    assert quality.learn(docs, labels.where("false")) is None and quality.learn(empty(spark), labels) is None
    assert {r["quality_score"] for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.score(empty(spark), model).count() == 0 and quality.accepted(empty(spark), model).count() == 0
    assert quality.accepted(docs, None).count() == docs.count()
    assert quality.accepted(docs, model).count() == got.where(F.col("quality_score") >= quality.ACCEPT).count()


def test_code_lengths_equal_the_recursion():
    size, order = 4, 2
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 3, size**3) * (rng.random(size**3) < 0.3)
    cube = counts.reshape(size, size, size)

    def bits(context, s):
        seen = cube
        for _ in range(order - len(context)):
            seen = seen.sum(0)
        for c in context:
            seen = seen[c]
        n, q = seen.sum(), (seen > 0).sum()
        shorter = bits(context[1:], s) if context else np.log2(size)
        if n == 0:
            return shorter
        return -np.log2(seen[s] / (n + q)) if seen[s] else -np.log2(q / (n + q)) + shorter

    table = language._code_lengths(counts.astype(float), size, order).reshape(size, size, size)
    for a, b, s in itertools.product(range(size), repeat=3):
        assert abs(table[a, b, s] - bits((a, b), s)) < 1e-4


def test_contexts_do_not_depend_on_pieces(monkeypatch):
    own = np.zeros(256, np.uint8)
    own[97:100] = [3, 4, 5]
    texts = [b"abcab", b"", b"cc", b"a", b"bcabcabcabccba"]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    expected = []
    for t in texts:
        s = [0] * 3 + [int(own[x]) for x in t]
        expected += [((s[i - 3] * 6 + s[i - 2]) * 6 + s[i - 1]) * 6 + s[i] for i in range(3, len(s))]
    for piece in (1 << 20, 7, 1):
        monkeypatch.setattr(grams, "PIECE", piece)
        assert np.concatenate([c for _, c in language._codes(raw, offsets, own, 6, 3)]).tolist() == expected


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = language.predict(docs, language.learn(docs, per_lang=60)).where(held_out(F.col("doc_id")) & F.col("lang").isNotNull()).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97


def test_sparse_trees_equal_the_whole_table():
    rng = np.random.default_rng(2)
    size, order = 5, 2
    counts = np.where(rng.random(size ** 3) < 0.3, rng.integers(1, 9, size ** 3), 0)
    code = np.flatnonzero(counts)
    got = language._bits(language._tree(code, counts[code], size, order), np.arange(size ** 3), size)
    assert np.allclose(got, language._code_lengths(counts.astype(float), size, order), atol=1e-4)


def test_order_and_alphabet_do_not_depend_on_the_number_of_languages(spark):
    rng = random.Random(6)
    scripts = {lang: (97, 26) for lang in ("de", "en", "es", "fr")} | {lang: (0x430, 32) for lang in ("bg", "ru", "uk")} | {
        "ja": (0x4E00, 4000), "zh": (0x4E00, 4000)}
    words = {lang: ["".join(chr(start + rng.randrange(n)) for _ in range(rng.randrange(2, 6))) for _ in range(150)] for lang, (start, n) in scripts.items()}
    rows = [(d, " ".join(rng.choices(words[lang], k=12)), lang) for d, lang in enumerate(sorted(scripts) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs)
    assert len(model["langs"]) == 9 and model["order"] == language.ORDER == 3
    assert len(set(model["own"][0x80:])) == 128                     # no byte of a letter shares its symbol
    got = language.predict(docs, model).where(held_out(F.col("doc_id"))).collect()
    assert len(got) > 50 and all(r["lang"] == r["lang_pred"] for r in got)


def test_language_awkward_rows(spark):
    docs = awkward(spark, (7, "123 456 !!", "en", "a", 3, "x", 1))
    model = language.learn(docs)
    got = language.predict(docs, model)
    assert got.count() == docs.count() and got.columns[-2:] == ["lang_pred", "score"]
    for r in got.collect():
        assert 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
    assert language.learn(empty(spark)) is None
    assert {r["lang_pred"] for r in language.predict(docs, None).collect()} == {"und"}
    assert language.predict(empty(spark), model).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return (
        [("email", *m.span()) for m in EMAIL.finditer(t)]
        + [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        + [("card", *m.span()) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        + [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15])


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    for _ in range(20000):
        t = "".join(rng.choice("a1@..-+ %0 é(9") for _ in range(rng.randrange(40)))
        assert pii.base_spans(t) == plain_spans(t)


def test_decoding_equals_enumeration():
    rng = np.random.default_rng(0)
    k = len(pii.LABELS)
    e, length, move = rng.normal(size=(3, 4, k)), np.array([4, 2, 3]), rng.normal(size=(k, k)) + pii.ALLOWED
    path, (marginal, _, _) = pii.viterbi(e, length, move), pii._marginals(e, length, move)
    for i in range(3):
        score = {s: e[i, 0, s[0]] + pii.START[s[0]] + sum(e[i, t, s[t]] + move[s[t - 1], s[t]] for t in range(1, length[i]))
                 for s in itertools.product(range(k), repeat=int(length[i]))}
        assert max(score, key=score.get) == tuple(path[i, :length[i]])
        total = np.logaddexp.reduce(list(score.values()))
        for t, label in itertools.product(range(length[i]), range(k)):
            part = np.logaddexp.reduce([v for s, v in score.items() if s[t] == label])
            assert abs(np.exp(part - total) - np.exp(marginal[i, t, label])) < 1e-9


def test_field_learns_from_labelled_lines():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 8)))
    def line():
        made = [f"{word()}@{word()}.com", ".".join(str(rng.randrange(256)) for _ in range(4)), f"+{rng.randrange(1, 99)} ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}",
                str(rng.randrange(10, 5000))]
        return " ".join([word(), word(), rng.choice(made), word(), rng.choice(made), word()])
    lines = [line() for _ in range(500)]
    model = pii.train([(t, pii.base_spans(t)) for t in lines[:350]])
    tagger = pii.Tagger(model)
    found = tagger.added(lines[350:], [[] for _ in lines[350:]])
    gold = [set(pii.base_spans(t)) for t in lines[350:]]
    hit = sum(len(g & set(f)) for g, f in zip(gold, found, strict=True))
    # only sure spans are added, so few are wrong
    assert hit / sum(map(len, gold)) > 0.6 and hit / max(1, sum(map(len, found))) > 0.95
    obscured = "write to bob@home.org, or call 0151 555 7788"        # base spans stay, none is doubled
    assert tagger.added([obscured], [pii.base_spans(obscured)])[0] == [] or all(k != "email" for k, _, _ in tagger.added([obscured], [pii.base_spans(obscured)])[0])


def test_pii_awkward_rows(spark):
    docs = awkward(spark, (8, "é mail a@b.co and 10.0.0.1\n4539 1488 0343 6467", "en", "a", 3, "x", 1))
    model = pii.train(pii.labelled_lines(docs))
    rows = pii.find(docs, model).collect()
    assert len(rows) == docs.count()
    last = next(r for r in rows if r["doc_id"] == 8)
    assert (last["n_email"], last["n_ip"], last["n_card"], last["n_phone"]) == (1, 1, 1, 0)
    assert last["spans"].startswith("email:7:13,ip:18:26,card:27:46")
    assert all(r["spans"] == "" and r["base_sha256"].startswith("e3b0c442") for r in rows if r["doc_id"] in (2, 3, 4))
    assert pii.train([]) is None and pii.find(empty(spark), None).count() == 0
    assert pii.find(docs, None).count() == docs.count()
