"""Source queries: payloads are made in place, pages are read once."""

from hirelode.catalog.landing import ID, payloads
from hirelode.sources import markup as M


def test_payloads_do_not_shuffle_descriptions(tables):
    raw = payloads(tables, f"{ID}, 'title', title, 'content', description", '{"jobs":{}}')
    assert "Aggregate [company" not in raw._jdf.queryExecution().optimizedPlan().toString()
    assert raw.count() == tables.postings.count()
    assert raw.first()["body"].startswith('{"jobs":[{"id":"')


def test_pages_are_read_once_and_keep_their_first_selector(spark):
    body = '<div class="job-card"><h3>Data Engineer</h3><a href="/job/1">x</a></div><div class="opening"><h2>Java Developer</h2><a href="/job/2">y</a></div>'
    pages = spark.createDataFrame([("p1", "acme", "https://a.example.com/jobs", body), ("p2", "acme", "https://a.example.com/jobs", "<p>none</p>")],
                                  "page_id string, company string, career_url string, body string")
    found = M.extract_cards_heuristic(pages)
    assert [(r["page_id"], r["title"]) for r in found.collect()] == [("p1", "Java Developer")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_selectors_are_read_once():
    dom = M.parse('<ul><li class="job x"><a href="/1">one</a></li><li class="job">two</li></ul>')
    assert [n.text() for n in M.select(dom, "ul li.job, a[href]")] == ["one", "one", "two"]
    assert M.first(dom, "li.job").text() == "one" and M.first(dom, None) is None
    assert M._chains("ul li.job, a[href]") is M._chains("ul li.job, a[href]")
