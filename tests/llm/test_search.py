import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelode.llm import decontaminate, html_text, neighbours

from .helpers import awkward, empty


def test_chi_square_quantile():
    # published values for 8 degrees of freedom
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.507) < 1e-3 and abs(neighbours.chi_square_quantile(0.99, 8) - 20.090) < 1e-3


def test_tree_leaves_hold_all_points_once():
    points = np.random.default_rng(2).normal(size=(1000, 4)).round(1)
    points[:300] = points[0]                                        # many equal points
    tree = neighbours.Tree(points, 16)
    rows = np.concatenate([tree.order[slice(*tree.range[n])] for n in tree.leaves])
    assert sorted(rows.tolist()) == list(range(1000))
    assert (tree.place(points[rows]) == np.repeat(np.arange(len(tree.leaves)), [tree.range[n][1] - tree.range[n][0] for n in tree.leaves])).all()


def plain_nearest(rows, k=10):
    ids = np.array([r[0] for r in rows])
    vectors = np.array([r[1] for r in rows])
    out = {}
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        out[int(q)] = [(int(ids[i]), float(d[i])) for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return out


@pytest.mark.parametrize("part", [8192, 150])
def test_recall_against_all_pairs(spark, monkeypatch, part):
    for name in ("PART", "QUERY_PART"):
        monkeypatch.setattr(neighbours, name, part if name == "PART" else 5)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=24) * 0.4]) for i in range(1500)]
    for i in range(700, 1100):
        rows[i] = (i, rows[700][1])                                 # one very common vector
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    expected = plain_nearest(rows)
    assert set(got) == set(expected) and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits / (10 * len(expected)) >= 0.9
    assert [i for i, _ in got[800]] == [i for i, _ in expected[800]]     # ties go to the smaller id
    true = dict((q, dict(v)) for q, v in expected.items())
    assert all(abs(true[q][i] - d) < 1e-12 for q, v in got.items() for i, d in v if i in true[q])


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
            (100, [3.0, 0.0]), (100, [3.0, 0.0]), (None, [1.0, 0.0]), (7, []), (8, [1.0, 2.0, 3.0]), (200, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("mine"))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.search(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 100, 2.0), (100, 1, 0, 2.0), (100, 2, 1, 5 ** 0.5)]
    assert neighbours.search(table.where("false"), F.lit(True)).count() == 0
    assert neighbours.search(table.where("vec_id = 0"), F.lit(True)).count() == 0


def words(text):
    return re.findall(r"[a-z0-9\u0080-￿]+", text.lower())


def test_leaks_equal_the_plain_overlap(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    where, size = {}, {}
    for r in items.collect():
        w = words(r["text"])
        runs = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
        size[r["item_id"]] = len(runs)
        for x in runs:
            where.setdefault(x, set()).add(r["item_id"])
    expected = set()
    for r in docs.collect():
        w, count = words(r["text"]), {}
        for x in {tuple(w[i:i + 5]) for i in range(len(w) - 4)}:
            for i in where.get(x, ()):
                count[i] = count.get(i, 0) + 1
        expected |= {(r["doc_id"], i) for i, n in count.items() if n / size[i] >= 0.8}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}
    assert got == expected and got
    kept = {r["doc_id"] for r in decontaminate.clean(docs, items).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {d for d, _ in expected}


def test_leaks_awkward_rows(spark, monkeypatch):
    question = "What is the tallest mountain of the northern range near the old river town called today by local people"
    items = spark.createDataFrame([(1, question), (1, question), (2, None), (3, ""), (None, "x y z"), (4, "tiny item"), (5, "four five six seven eight nine")], "item_id long, text string")
    docs = awkward(spark, (20, "intro. " + question.upper().replace(" ", "!! ") + " outro", "en", "a", 1, "x", 1),
                   (21, question[:50], "en", "a", 1, "x", 1), (22, "a TINY item here", "en", "a", 1, "x", 1), (23, "tiny nothing item", "en", "a", 1, "x", 1),
                   (24, "word " * 5000 + question, "en", "a", 1, "x", 1))
    for part in (20_000, 1):
        monkeypatch.setattr(decontaminate, "PART", part)
        assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()} == {(20, 1), (22, 4), (24, 1)}
        cleaned = decontaminate.clean(docs, items)
        assert cleaned.columns == docs.columns and cleaned.count() == docs.count() - 3
    assert decontaminate.leaks(empty(spark), items).count() == 0
    assert decontaminate.leaks(docs, items.where("false")).count() == 0 and decontaminate.clean(docs, items.where("false")).count() == docs.count()


def test_longest_common_lines():
    rng = np.random.default_rng(6)
    def longest(a, b):
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        return table[-1, -1]
    for _ in range(500):
        a, b = rng.integers(0, 5, rng.integers(0, 12)).tolist(), rng.integers(0, 5, rng.integers(0, 12)).tolist()
        found = html_text.shared_lines(a, b)
        rest = iter(b)
        assert len(found) == longest(a, b) and all(a[i] in rest for i in sorted(found))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page header"><header>Site</header>
<nav><ul><li><a>Home</a><li>About</ul></nav><div class="cookie-notice">We use cookies</div><script>var t="</p><article>";</script>
<article><header><h1>Title &amp; more</h1></header><p>One&nbsp;&#8212; <b>two</b>
three<p>Four<div class="ad">Buy</div><aside>Side</aside><form><p>Mail</p></form><!-- hidden <p>x</p> --><ul><li>a<li>b</ul>
<section id="comments"><article class="comment">First!</article></section></article><footer>Foot</footer></body>"""


def test_page_structure():
    assert html_text.main_text(PAGE, None) == "Title & more\n\nOne — two three\n\nFour\n\na\n\nb"
    assert html_text.main_text(None, None) == "" and html_text.main_text("", [1]) == "" and html_text.main_text("<p", None) == "<p"
    assert html_text.main_text("<article><p>cut off <b>here", None) == "cut off here"
    assert html_text.main_text("plain text", None) == "plain text"


def test_page_differencing(spark):
    def page(text, host="h.example.com"):
        return f"<body><div>Welcome to {host}</div><div><p>{text}</p></div><div>All rights</div></body>"
    rows = [(1, "https://h.example.com/a/1?x=1", page("first story")), (2, "http://H.example.com/a/2#t", page("second story")),
            (3, "https://h.example.com/b/9", page("third story")), (4, "https://alone.example.com/", page("lonely", "alone.example.com")),
            (5, None, None), (6, "", ""), (7, "not a url", "<p>loose</p>"), (1, "https://h.example.com/a/1?x=1", page("first story"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("main_text", F.lit("mine"))
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "html", "main_text"]
    text = {}
    for r in got.collect():
        text.setdefault(r["page_id"], []).append(r["main_text"])
    assert text == {1: ["first story"] * 2, 2: ["second story"], 3: ["third story"],
                    4: ["Welcome to alone.example.com\n\nlonely\n\nAll rights"], 5: [""], 6: [""], 7: ["loose"]}
    assert html_text.extract(pages.where("false")).count() == 0


def test_nearest_path_is_found_in_whole_paths(spark):
    """The neighbour with the longer common path decides, also where the first 64 characters are equal."""
    head = "https://h.example.com/" + "x" * 90
    rows = [(1, head + "/a", "<div>menu one</div><div>first</div>"), (2, head + "/b1", "<div>menu two</div><div>second</div>"),
            (3, head + "/b2", "<div>menu two</div><div>third</div>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["main_text"] for r in got}[2] == "second"


def test_pages_equal_their_articles(spark):
    import html
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_text.extract(pages).collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", body))
        assert r["main_text"] == "\n\n".join(b for b in blocks if b)


def test_differencing_decides_containers_too(spark, monkeypatch):
    """Of the containers of a page those with a line of its own are the article; its shared sentences stay."""
    def page(text, ad):
        return f"<main><p>Read also</p><p>Ten offers</p></main><p>{ad}</p><article><h1>{text}</h1><p>As every day.</p><article>Part</article></article>"
    rows = [(1, "http://h/a/1", page("first", "x")), (2, "http://h/a/2", page("second", "y")), (3, "http://h/b/1", page("third", "z")),
            (4, "http://copy/1", page("same", "x")), (5, "http://copy/2", page("same", "y")), (6, "http://alone/", page("lonely", "x"))]
    rest = "\n\nAs every day.\n\nPart"
    whole = "Read also\n\nTen offers\n\n"
    want = {1: "first" + rest, 2: "second" + rest, 3: "third" + rest, 4: whole + "same" + rest, 5: whole + "same" + rest, 6: whole + "lonely" + rest}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for listed in (html_text.LISTED, -1):          # with the taken lines broadcast, and shuffled
        monkeypatch.setattr(html_text, "LISTED", listed)
        assert {r["page_id"]: r["main_text"] for r in html_text.extract(pages).collect()} == want
