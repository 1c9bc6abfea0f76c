"""Postings in HTML and XML: regular markup by pattern, cards by a small DOM reader."""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .common import as_postings
from .json_api import _linked, _or

# --- a small DOM -------------------------------------------------------------

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def strings(self):
        for child in self.children:
            if isinstance(child, Node):
                yield from child.strings()
            elif child.strip():
                yield child.strip()

    def text(self, sep=""):
        return sep.join(self.strings())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


# markup without entities, comments or other special forms: text, a start tag in lower case with quoted attributes, an end tag
_PLAIN = re.compile(r'([^<&]+)|<([a-z][a-z0-9]*)((?:[ \t\n]+[a-z][a-z0-9_-]*="[^"&<>]*")*)[ \t\n]*>|</([a-z][a-z0-9]*)>')
_PLAIN_ATTR = re.compile(r'([a-z][a-z0-9_-]*)="([^"]*)"')
# elements whose content the parser reads in another way
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext", "svg", "math"}


def _parse_plain(html: str) -> Node | None:
    """The tree of plain markup, as the parser would build it; None where anything else occurs."""
    root = at = Node("", {}, None)
    end = 0
    for m in _PLAIN.finditer(html):
        if m.start() != end:
            return None
        end = m.end()
        data, tag, attrs, closed = m.groups()
        if data is not None:
            at.children.append(data)
        elif tag is not None:
            if tag in _RAW:
                return None
            node = Node(tag, dict(_PLAIN_ATTR.findall(attrs)) if attrs else {}, at)
            at.children.append(node)
            if tag not in VOID:
                at = node
        else:
            node = at
            while node.parent is not None and node.tag != closed:
                node = node.parent
            if node.parent is not None:
                at = node.parent
    return root if end == len(html) else None


def parse(html: str) -> Node:
    plain = _parse_plain(html or "")
    if plain is not None:
        return plain
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


_ATTR = re.compile(r"\[([\w-]+)(?:([*^$]?)=['\"]?([^'\"\]]*)['\"]?)?\]")


def _simple(selector: str):
    tag = re.match(r"[\w-]*", selector).group(0)
    classes = re.findall(r"\.([\w-]+)", _ATTR.sub("", selector))
    attrs = _ATTR.findall(selector)

    def test(n: Node) -> bool:
        if tag and n.tag != tag:
            return False
        if classes:
            have = n.attrs.get("class", "").split()
            if any(c not in have for c in classes):
                return False
        for name, how, value in attrs:
            got = n.attrs.get(name)
            if got is None:
                return False
            whole = "=" + value if not how else None
            if value and not ((how == "*" and value in got) or (how == "^" and got.startswith(value))
                              or (how == "$" and got.endswith(value)) or (whole and got == value)):
                return False
        return True

    return test


@lru_cache(maxsize=10_000)
def _chains(selectors: str) -> list[list]:
    """Tests of comma-separated selectors; each text is read once in a worker."""
    return [[_simple(p) for p in s.split()] for s in selectors.split(",") if s.strip()]


def _matches(n: Node, chain) -> bool:
    if not chain[-1](n):
        return False
    up = n.parent
    for test in reversed(chain[:-1]):
        while up is not None and not test(up):
            up = up.parent
        if up is None:
            return False
        up = up.parent
    return True


def select(node: Node, selectors: str) -> list[Node]:
    """Nodes below ``node`` matching any of the comma-separated selectors, in document order."""
    chains = _chains(selectors)
    return [n for n in node.walk() if any(_matches(n, c) for c in chains)]


def first(node: Node, selectors: str | None) -> Node | None:
    if not selectors:
        return None
    chains = _chains(selectors)
    return next((n for n in node.walk() if any(_matches(n, c) for c in chains)), None)


# --- card readers ------------------------------------------------------------

CARD_SCHEMA = ("company string, career_url string, ordinal int, position int, title string, location string, href string, "
               "body string, firm string, posted string, pay string, ref string")


def _cards(pages: DataFrame, read) -> DataFrame:
    """Rows of every page's cards; ``read(html, row)`` yields dicts."""
    columns = [c.split()[0] for c in CARD_SCHEMA.split(", ")]
    kinds = pa.schema([(c, pa.int32() if c in ("ordinal", "position") else pa.string()) for c in columns])

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                for card in read(parse(row["body"]), row):
                    rows.append({"company": row.get("company"), "career_url": row.get("career_url"), "ordinal": 0, **card})
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return pages.mapInArrow(run, CARD_SCHEMA)


def extract_with_patterns(pages: DataFrame, patterns: DataFrame) -> DataFrame:
    """Cards by each company's stored selectors.
    ``pages``: company, company_id, career_url, body; ``patterns``: company_id and four selectors."""

    def read(dom, row):
        for i, card in enumerate(select(dom, row["job_card_selector"])):
            title, place = first(card, row["title_selector"]), first(card, row["location_selector"])
            link = first(card, row["apply_link_selector"])
            link = link if link is not None else (card if card.tag == "a" else None)
            if title is not None and title.text():
                yield {"position": i, "title": title.text(), "location": place.text() if place is not None else None,
                       "href": link.attrs.get("href") if link is not None else None, "body": card.text(" ")}

    cards = _cards(pages.join(patterns, "company_id").where("job_card_selector <> ''"), read)
    split = cards.withColumn("s", T.split_glued_title("title"))
    return as_postings(
        split, company=F.col("company"), title=F.col("s.title"), location=F.coalesce(T.blank_to_null("location"), "s.location", F.lit("Unknown")),
        url=T.resolve_url("href", "career_url"), description=F.col("body"), extraction_method=F.lit("stored_pattern"), source=F.lit("web"))


# fixed values: card selectors tried in this order
CARD_SELECTORS = [
    ".opening", ".posting", "[data-qa='job-card']", ".job-card", ".job-item", ".job-listing", ".position-card",
    ".career-card", ".job-tile", ".job_card", "tr.job-row", "div.job-post", "li.job", "article.job", ".jobs-list-item",
    "[data-automation-id='jobPosting']", "[data-automation-id='jobTitle']", ".role-card", ".opening-card",
    ".css-19v252", "[data-ui-id='job-card']", "div[data-job-id]", "[class*='jobCard']", "[class*='JobCard']",
]


def _card_index() -> tuple[dict[str, list], list]:
    """(card selectors by their first class, the others), each with its place in the order and its test.
    Every one of them asks for a class or another attribute and looks at one node only."""
    by_class, others = {}, []
    for ordinal, selector in enumerate(CARD_SELECTORS):
        name = re.search(r"\.([\w-]+)", _ATTR.sub("", selector))
        (by_class.setdefault(name.group(1), []) if name else others).append((ordinal, _simple(selector)))
    return by_class, others


_BY_CLASS, _BY_ATTR = _card_index()
_ATTR_NAMES = {name for s in CARD_SELECTORS for name, _, _ in _ATTR.findall(s) if name != "class"}


def _found_cards(dom: Node) -> dict[int, list[Node]]:
    """What ``select`` finds for each card selector, in one walk."""
    found: dict[int, list[Node]] = {}
    for n in dom.walk():
        if not n.attrs:
            continue
        classes = n.attrs.get("class", "")
        ways = [way for name in dict.fromkeys(classes.split()) for way in _BY_CLASS.get(name, ())]
        if "obCard" in classes or not _ATTR_NAMES.isdisjoint(n.attrs):
            ways += _BY_ATTR
        for ordinal, test in ways:
            if test(n):
                found.setdefault(ordinal, []).append(n)
    return found


_PLACE_CLASS = re.compile(r"loc|city|place|region|country", re.I)


def extract_cards_heuristic(pages: DataFrame) -> DataFrame:
    """The first card selector with a valid posting wins, per page. ``pages``: page_id, company, career_url, body."""

    def read(dom, row):
        for ordinal, cards in sorted(_found_cards(dom).items()):
            for i, card in enumerate(cards):
                head = first(card, "h1, h2, h3, h4, a, strong")
                title = head.text() if head is not None else ""
                if not 3 <= len(title) <= 120:
                    continue
                place = next((n for n in card.walk() if _PLACE_CLASS.search(n.attrs.get("class", ""))), None)
                link = card if card.tag == "a" else first(card, "a[href]")
                yield {"ordinal": ordinal, "position": i, "title": title, "location": place.text() if place is not None else None,
                       "href": link.attrs.get("href") if link is not None else None, "body": card.text(" "), "ref": str(row["page_id"])}

    cards = _cards(pages, read)
    made = as_postings(
        cards, keep=["ref", "ordinal"], company=F.col("company"), title=F.col("title"), location=_or("location", "India"),
        url=T.resolve_url("href", "career_url"), description=F.col("body"), extraction_method=F.lit("heuristic"), source=F.lit("web"))
    # a window over the cards of one page: the pages are read once, not once for the winner and once for its rows
    best = F.min("ordinal").over(Window.partitionBy("ref"))
    return made.withColumn("__win", best).where("ordinal = __win").drop("__win", "ordinal").withColumnRenamed("ref", "page_id")


ANCHOR_WORDS = r"engineer|developer|intern|manager|analyst|designer|consultant|associate|specialist|lead|architect|sde|swe"


def _anchors(html) -> Column:
    """Array of struct(href, text) of the links in a page."""
    pattern = r"(?is)<a\b[^>]*?\bhref=[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    whole = F.regexp_extract_all(html, F.lit(pattern), 0)
    return F.transform(whole, lambda a: F.struct(
        F.regexp_extract(a, pattern, 1).alias("href"), T.html_to_text(F.regexp_extract(a, pattern, 2)).alias("text")))


def extract_anchor_jobs(pages: DataFrame) -> DataFrame:
    """Links whose text has a job word, first of each text per page. ``pages``: page_id, url, html."""
    links = pages.select("page_id", "url", F.posexplode(_anchors("html")).alias("position", "a"))
    jobs = links.select("page_id", "url", "position", F.col("a.href").alias("href"), F.col("a.text").alias("text")).where(
        F.length("text").between(4, 100) & F.col("text").rlike(T.bounded(ANCHOR_WORDS, "iU")))
    kept = jobs.groupBy("page_id", "text").agg(F.min_by(F.struct("href", "url", "position"), "position").alias("r"))
    return kept.select("page_id", F.col("text").alias("title"), T.resolve_url("r.href", "r.url").alias("url"), F.lit("India").alias("location"))


def discover_ats_tokens(pages: DataFrame) -> DataFrame:
    """Board names of four vendors linked from a page."""
    def found(*patterns: str) -> Column:
        return F.coalesce(*[F.nullif(F.regexp_extract("html", p + "([a-zA-Z0-9_-]+)", 1), F.lit("")) for p in patterns])

    return pages.withColumns({
        "greenhouse": found(r"boards\.greenhouse\.io/embed/job_board\?for=", r"boards\.greenhouse\.io/"),
        "lever": found(r"jobs\.lever\.co/"), "ashby": found(r"ashbyhq\.com/"), "smartrecruiters": found(r"smartrecruiters\.com/")})


# fixed values: hosts and names of boards with an API
ATS_HOSTS = [("myworkdayjobs.com", "workday"), ("greenhouse.io", "greenhouse"), ("lever.co", "lever"), ("ashbyhq.com", "ashby")]
API_ATS = ["workday", "greenhouse", "lever", "ashby", "smartrecruiters", "keka", "turbohire", "oraclehcm", "successfactors"]
API_HOSTS = ["myworkdayjobs.com", "greenhouse.io", "lever.co", "ashbyhq.com", "smartrecruiters.com", ".keka.com", "turbohire.co", ".fa.oraclecloud.com"]


def classify_ats(companies: DataFrame) -> DataFrame:
    """Board vendor by final URL, and the lane a scan takes."""
    url = F.lower(F.coalesce("career_url", F.lit("")))
    vendor = F.lit(None).cast("string")
    for host, name in reversed(ATS_HOSTS):
        vendor = F.when(url.contains(host), F.lit(name)).otherwise(vendor)
    api = F.lower(F.coalesce("ats", F.lit(""))).isin(API_ATS) | T.has_any(url, API_HOSTS)
    return companies.withColumns({"detected_ats": vendor, "lane": F.when(api, F.lit("api")).otherwise(F.lit("browser"))})


# fixed values: path parts that are not board names
PATH_WORDS = ["v0", "postings", "careers", "embed", "c", "boards", "job_board", "job-board", "job", "jobs"]


def board_token(url, company_id) -> Column:
    """Board name from for=, else the first telling path part, else the company id."""
    clean = F.regexp_replace(F.coalesce(T._c(url), F.lit("")), "/+$", "")
    given = F.nullif(F.regexp_extract(clean, "for=([^&]+)", 1), F.lit(""))
    path = F.regexp_extract(clean, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    part = F.get(F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.isin(PATH_WORDS)), F.lit(0))
    named = F.coalesce(given, part)
    own = F.trim(F.replace(F.replace(F.lower(T._c(company_id)), F.lit("-india"), F.lit("")), F.lit("_india"), F.lit("")))
    return F.when(named.isNull() | named.isin("jobs", "careers", "job", "career", "board", "boards", "embed", "c"), own).otherwise(named)


# --- listings by pattern -----------------------------------------------------

def normalize_successfactors(raw: DataFrame) -> DataFrame:
    """Title links and place cells paired by position, repeated links dropped.
    ``raw``: company, base, body."""
    row = r'(?s)<a[^>]*class="jobTitle-link"[^>]*href="([^"]+)"[^>]*>([^<]+)</a>'
    links = F.transform(F.regexp_extract_all("body", F.lit(row), 0), lambda a: F.struct(
        F.regexp_extract(a, row, 1).alias("href"), F.regexp_extract(a, row, 2).alias("title")))
    places = F.filter(
        F.transform(F.regexp_extract_all("body", F.lit(r'class="jobLocation[^"]*"[^>]*>\s*([^<]+?)\s*<'), 1), T.strip),
        lambda p: (p != "") & (F.lower(p) != "location"))
    # a link is new when none before it has its href; its place has the rank of the new link
    hrefs = F.array_distinct(F.transform(links, lambda x: x["href"]))
    new = F.transform(hrefs, lambda h, i: F.struct(
        h.alias("href"), F.get(F.filter(links, lambda x: x["href"] == h), F.lit(0))["title"].alias("title"),
        F.coalesce(F.get(places, i), F.lit("India")).alias("place")))
    j = raw.withColumn("j", F.explode(new))
    title = T.strip("j.title")
    return as_postings(
        j, source_id=F.col("j.href"), company=F.col("company"), title=title, location=F.col("j.place"),
        url=F.when(F.col("j.href").startswith("http"), F.col("j.href")).otherwise(F.concat("base", "j.href")),
        description=F.concat(title, F.lit(" at "), "company", F.lit(" - "), "j.place", F.lit(". See posting for details.")),
        source=F.lit("successfactors"), extraction_method=F.lit("successfactors_api"))


def extract_json_ld(pages: DataFrame) -> DataFrame:
    """Schema.org JobPosting objects: single, listed or in a graph. ``pages``: company, career_url, body."""
    blocks = F.regexp_extract_all("body", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    doc = pages.withColumn("x", F.explode(blocks)).withColumn("d", F.try_parse_json("x"))
    listed = F.coalesce(F.try_variant_get("d", "$", "array<variant>"), F.try_variant_get("d", "$['@graph']", "array<variant>"), F.array("d"))
    j = doc.withColumn("v", F.explode(listed)).where(F.try_variant_get("v", "$['@type']", "string") == "JobPosting")

    def at(path: str) -> Column:
        return T.blank_to_null(F.try_variant_get("v", path, "string"))

    place = F.coalesce(*[at(f"$.jobLocation.address.{f}") for f in ("addressLocality", "addressRegion", "addressCountry")],
                       F.when(~F.coalesce(at("$.jobLocation.address"), F.lit("{")).startswith("{"), at("$.jobLocation.address")),
                       *[at(f"$.jobLocation[0].address.{f}") for f in ("addressLocality", "addressCountry")], F.lit("India"))
    title = F.coalesce(at("$.title"), at("$.name"))
    link = F.coalesce(at("$.url"), at("$.sameAs"), at("$.directApplyUrl"), F.lit(""))
    return as_postings(
        j.where(F.length(title) >= 3), company=F.col("company"), title=title, location=place, url=T.resolve_url(link, "career_url"),
        description=F.coalesce(at("$.description"), title), posted_date=at("$.datePosted"), extraction_method=F.lit("json_ld"), source=F.lit("web"))


def normalize_rss(raw: DataFrame) -> DataFrame:
    """Feed items whose title is 'role - company' or 'role at company'."""
    schema = "channel struct<item:array<struct<title:string,link:string,description:string,pubDate:string,guid:string>>>"
    j = raw.withColumn("p", F.from_xml(F.col("body"), schema)).withColumn("j", F.explode("p.channel.item")).drop("p", "body")
    dash, at = F.split("j.title", " - "), F.split("j.title", " at ")
    title = F.when(F.col("j.title").contains(" - "), F.get(dash, F.lit(0))).when(F.col("j.title").contains(" at "), F.get(at, F.lit(0))).otherwise(F.col("j.title"))
    firm = F.when(F.col("j.title").contains(" - "), F.get(dash, F.lit(1))).when(F.col("j.title").contains(" at "), F.get(at, F.lit(1))).otherwise(F.lit("Naukri Listed Partner"))
    place = F.col("location") if "location" in raw.columns else F.lit("India")
    return as_postings(
        _linked(j, F.col("j.title"), F.col("j.link")), source_id=F.col("j.guid"), company=T.strip(firm), title=T.strip(title), location=place,
        url=T.strip("j.link"), description=_or("j.description", F.concat(T.strip(title), F.lit(" opportunity at "), T.strip(firm), F.lit("."))),
        posted_date=F.col("j.pubDate"), source=F.lit("naukri"), extraction_method=F.lit("naukri_rss_feed"), parse_confidence=F.lit(0.90))


_NEXT = r'(?s)<script id="__NEXT_DATA__" type="application/json">(.*?)</script>'


def _next_data(raw: DataFrame) -> DataFrame:
    return raw.withColumn("n", F.nullif(F.regexp_extract("body", _NEXT, 1), F.lit("")))


def normalize_cutshort(raw: DataFrame) -> DataFrame:
    """The page's embedded data; the query named jobListData holds the postings."""
    jobs = ("array<struct<_id:string,headline:string,publicUrl:string,companyDetails:struct<name:string,sanitizedDescription:string>,locations:array<string>,"
            "remoteType:string,allSkills:array<string>,expRange:struct<min:int,max:int>,salaryRangeText:string>>")
    query = f"array<struct<queryKey:array<string>,state:struct<data:struct<data:struct<pageData:struct<jobs:{jobs}>>>>>>"
    q = _next_data(raw).withColumn("q", F.from_json(F.get_json_object("n", "$.props.pageProps.dehydratedState.queries"), query))
    found = F.filter("q", lambda x: F.get(x["queryKey"], F.lit(0)) == "jobListData")
    j = q.withColumn("j", F.explode(F.get(found, F.lit(0))["state"]["data"]["data"]["pageData"]["jobs"])).drop("q", "n", "body")
    firm, title = _or("j.companyDetails.name", "Cutshort Listed Company"), T.strip("j.headline")
    skills = F.array_join("j.allSkills", ", ")
    about = T.strip(F.concat(F.coalesce(T.strip("j.companyDetails.sanitizedDescription"), F.lit("")),
                             F.coalesce(F.concat(F.lit(" Skills: "), F.nullif(skills, F.lit(""))), F.lit(""))))
    years = F.concat(F.col("j.expRange.min").cast("string"), F.lit("-"), F.coalesce(F.col("j.expRange.max").cast("string"), F.lit("None")), F.lit(" years"))
    return as_postings(
        _linked(j, F.col("j.headline"), F.col("j.publicUrl")), source_id=F.col("j._id"), company=firm, title=title,
        location=T.first_non_empty(F.array_join("j.locations", ", "), "j.remoteType", F.lit("India")), url=T.strip("j.publicUrl"),
        description=_or(about, F.concat(title, F.lit(" opportunity at "), firm, F.lit("."))), source=F.lit("cutshort"),
        extraction_method=F.lit("cutshort_next_data"), parse_confidence=F.lit(0.90), salary_text=_or("j.salaryRangeText", "unspecified"),
        experience_text=F.coalesce(years, F.lit("unspecified")))


def normalize_shine(raw: DataFrame) -> DataFrame:
    """Embedded search results; the link is made of slugs."""
    results = "array<struct<id:string,jJT:string,jCName:string,jLoc:array<string>,jExp:string,jSal:string,jInd:string,jPDate:string>>"
    j = _next_data(raw).withColumn("j", F.explode(F.from_json(
        F.get_json_object("n", "$.props.pageProps.initialState.jsrp.searchresult.data.results"), results))).drop("n", "body")
    title, firm = T.strip("j.jJT"), _or("j.jCName", "Shine Listed Company")
    site = F.lit("https://www.shine.com")
    return as_postings(
        j.where(F.coalesce(title, F.lit("")) != ""), source_id=F.col("j.id"), company=firm, title=title,
        location=_or(F.array_join(F.filter("j.jLoc", lambda x: F.coalesce(x, F.lit("")) != ""), ", "), "India"),
        url=F.when(F.coalesce("j.id", F.lit("")) != "", F.concat_ws("/", site, F.lit("jobs"), T.dash_slug(title), T.dash_slug(firm), "j.id")).otherwise(site),
        description=F.concat_ws(" ", F.concat(title, F.lit(" at "), firm, F.lit(".")),
                                F.concat(F.lit("Experience: "), T.blank_to_null("j.jExp"), F.lit(".")), F.concat(F.lit("Industry: "), T.blank_to_null("j.jInd"), F.lit("."))),
        posted_date=F.col("j.jPDate"), source=F.lit("shine"), extraction_method=F.lit("shine_next_data"), parse_confidence=F.lit(0.90),
        salary_text=_or("j.jSal", "unspecified"), experience_text=_or("j.jExp", "unspecified"))


def normalize_internshala(raw: DataFrame) -> DataFrame:
    """Internship cards."""

    def read(dom, row):
        for i, card in enumerate(select(dom, "div.individual_internship")):
            head = first(card, "a.job-title-href") or first(card, "h2 a")
            firm = first(card, "p.company-name")
            if head is None or firm is None:
                continue
            place, pay = first(card, ".locations span"), first(card, "span.stipend")
            yield {"position": i, "title": head.text(), "firm": firm.text(), "href": card.attrs.get("data-href") or head.attrs.get("href") or "",
                   "location": place.text(" ") if place is not None else "India", "pay": pay.text() if pay is not None else "unspecified",
                   "ref": card.attrs.get("internshipid") or card.attrs.get("id") or ""}

    c = _cards(raw, read).where("title <> '' AND href <> ''")
    title = F.when(F.lower("title").contains("intern"), F.col("title")).otherwise(F.concat("title", F.lit(" Intern")))
    return as_postings(
        c, source_id=F.col("ref"), company=F.col("firm"), title=title, location=F.col("location"),
        url=F.when(F.col("href").startswith("/"), F.concat(F.lit("https://internshala.com"), "href")).otherwise(F.col("href")),
        description=F.concat("title", F.lit(" internship at "), "firm", F.lit(". Stipend: "), "pay", F.lit(". 0 years experience - internship role.")),
        source=F.lit("internshala"), extraction_method=F.lit("internshala_html"), parse_confidence=F.lit(0.90), salary_text=F.col("pay"),
        experience_text=F.lit("0 years"))


def normalize_freshersworld(raw: DataFrame) -> DataFrame:
    """Cards titled 'role Jobs Opening in company at place'."""

    def read(dom, row):
        for i, card in enumerate(select(dom, "div.job-container")):
            head, link = first(card, ".job-new-title, h3, h2"), first(card, "a[href]")
            if head is not None and link is not None and head.text(" "):
                yield {"position": i, "title": head.text(" "), "href": link.attrs.get("href", ""), "body": card.text(" | ")}

    shape = r"(?is)^(.*?)\s+Jobs?\s+Opening\s+in\s+(.*?)\s+at\s+(.*)$"
    c = _cards(raw, read).withColumn("full", F.col("title").rlike(shape))

    def part(i: int, fallback: Column) -> Column:
        return F.when(F.col("full"), T.strip(F.regexp_extract("title", shape, i))).otherwise(fallback)

    place = F.regexp_replace(F.regexp_replace(part(3, F.lit("India")), r"(?s)\s+(?:Less|More)\b.*$", ""), r"^[ |,]+|[ |,]+$", "")
    named = c.withColumns({"role": part(1, F.col("title")), "firm": part(2, F.lit("Freshersworld Listed Company")), "place": _or(place, "India")}) \
        .withColumn("firm", F.when(F.lower("firm").startswith("a client of"), F.lit("Freshersworld (undisclosed employer)")).otherwise(F.col("firm"))) \
        .withColumn("years", _or(F.regexp_extract("body", r"(?i)(\d+(?:\.\d+)?\s*(?:-|to)?\s*(?:\d+(?:\.\d+)?)?\s*Years?)", 1), "unspecified"))
    pay = F.when(F.col("body").contains("Salary not disclosed"), F.lit(None)).otherwise(
        F.regexp_extract("body", r"(?i)((?:₹|Rs\.?)\s?[\d,.]+\s?(?:-|to)?\s?[\d,.]*\s?(?:LPA|Lakh|/month|per month)?)", 1))
    return as_postings(
        named, source_id=F.element_at(F.split(F.regexp_replace("href", "/+$", ""), "/"), -1), company=F.col("firm"), title=F.col("role"), location=F.col("place"),
        url=F.when(F.col("href").startswith("/"), F.concat(F.lit("https://www.freshersworld.com"), "href")).otherwise(F.col("href")),
        description=F.concat("role", F.lit(" at "), "firm", F.lit(", "), "place", F.lit(". Experience: "), "years", F.lit(". (Freshersworld listing)")),
        source=F.lit("freshersworld"), extraction_method=F.lit("freshersworld_html"), parse_confidence=F.lit(0.85),
        salary_text=_or(pay, "unspecified"), experience_text=F.col("years"))


def normalize_linkedin(raw: DataFrame) -> DataFrame:
    """Public listing cards; the link loses its query."""

    def read(dom, row):
        for i, card in enumerate(select(dom, "div.base-search-card, div.base-card")):
            title, link = first(card, ".base-search-card__title"), first(card, "a.base-card__full-link")
            if title is None or link is None:
                continue
            firm, place, day = first(card, ".base-search-card__subtitle"), first(card, ".job-search-card__location"), first(card, ".job-search-card__listdate, time")
            yield {"position": i, "title": title.text(), "href": link.attrs.get("href", "").split("?")[0],
                   "firm": firm.text() if firm is not None else "LinkedIn Listed Company", "location": place.text() if place is not None else "India",
                   "posted": day.attrs.get("datetime") if day is not None else None, "ref": card.attrs.get("data-entity-urn", "")}

    c = _cards(raw, read).where("title <> '' AND href <> ''")
    return as_postings(
        c, source_id=F.col("ref"), company=F.col("firm"), title=F.col("title"), location=F.col("location"), url=F.col("href"),
        description=F.concat("title", F.lit(" at "), "firm", F.lit(" (via LinkedIn public listing). See posting for details.")),
        posted_date=F.col("posted"), source=F.lit("linkedin"), extraction_method=F.lit("linkedin_guest_html"), parse_confidence=F.lit(0.85),
        salary_text=F.lit("unspecified"), experience_text=F.lit("unspecified"))


def import_posting_page(pages: DataFrame) -> DataFrame:
    """One posting from its own page: shared-card tags, heading, page title, else the URL."""
    def meta(name: str) -> Column:
        return F.nullif(F.regexp_extract("html", rf"(?is)<meta[^>]*property=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1), F.lit(""))

    def tag(name: str) -> Column:
        return F.nullif(T.html_to_text(F.regexp_extract("html", rf"(?is)<{name}\b[^>]*>(.*?)</{name}>", 1)), F.lit(""))

    slug = F.element_at(F.split(F.regexp_replace(F.regexp_replace("url", r"\?.*$", ""), "/+$", ""), "/"), -1)
    from_url = F.when(slug.rlike(r"^\d*$"), F.lit("Software Engineer (LinkedIn Import)")).otherwise(F.initcap(F.replace(slug, F.lit("-"), F.lit(" "))))
    stated = F.coalesce(T.unescape(meta("og:title")), tag("h1"), tag("title"))
    title = F.regexp_replace(F.regexp_replace(stated, r"(?i)\s*\|\s*LinkedIn.*$", ""), r"(?i) hiring .*$", "")
    about = T.unescape(meta("og:description"))
    firm = F.nullif(T.strip(F.regexp_extract(F.coalesce(about, F.lit("")), r"(?i)^\s*([^\n:]+)\s+hiring", 1)), F.lit(""))
    body = F.nullif(T.html_to_text(F.regexp_extract("html", r"(?is)<(?:div|section)[^>]*class=\"[^\"]*(?:description__text|show-more-less-html)[^\"]*\"[^>]*>(.*?)</(?:div|section)>", 1)), F.lit(""))
    named = F.coalesce(F.nullif(title, F.lit("")), from_url)
    company = F.coalesce(firm, F.lit("LinkedIn Poster"))
    return pages.withColumns({"title": named, "company": company, "description": F.coalesce(
        body, about, F.concat(F.lit("User imported LinkedIn job from "), "url", F.lit(". Title: "), named, F.lit(". Company: "), company, F.lit(".")))})


def extract_detail_description(pages: DataFrame) -> DataFrame:
    """Text of the posting's description block; null when it is missing or too short."""
    block = F.regexp_extract("html", r'(?s)<div class="show-more-less-html__markup[^"]*">(.*?)</div>', 1)
    text = T.squeeze(F.regexp_replace(block, "<[^>]+>", " "))
    return pages.withColumn("description", F.when(F.length(text) > 100, text))
