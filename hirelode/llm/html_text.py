"""Main text of raw pages: page differencing guided by page structure.

Every page is cut into text lines (one for each block element).  Pages of a host
are put in URL-path order; a page is compared with the nearer of its two
neighbours (longer common path, then the one before) by the longest common
subsequence of their lines, and shared lines are deleted.  Differencing alone
errs both ways here: menus and adverts that differ from page to page would stay,
and sentences that articles share would go.  So structure guides it.  Lines of
menus, headers, footers, sidebars, notices, adverts, forms and reader comments go.
Differencing then decides every page by its lines of its own: an ``article`` or
``main`` that has one is the article and stays whole, one without any is
repeated on the nearest page and goes, and on pages without such containers the
lines of its own are the text.  A page whose lines are all shared is a copy of its
neighbour and keeps them.

Only hashes of lines and their places (a few bytes a line) are exchanged between
pages; pages are ranked over the whole table, so a host with a third of the pages is
no group.  What comes back to a page is the list of lines that differencing takes
from it: pages that lose none have no row there, and up to ``LISTED`` of these
numbers are broadcast, so whole pages are shuffled only when there are more.

Defined results: null or empty html gives an empty text; a null or malformed url
belongs to the host ``''``; repeated rows each give a row; truncated pages and
unclosed elements end with the page; references are decoded; white space inside a
block, no-break spaces included, becomes one space.
"""

from __future__ import annotations

import html
import re
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelode.session import cut_lineage, with_global_rank

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>|[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "video", "audio", "title", "xmp"}
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "input", "label", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
          "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav",
          "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
CLOSED_BY = {"li": {"li"}, "dt": {"dd", "dt"}, "dd": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOT_IN_P = BLOCKS - {"li", "dd", "dt", "caption", "tr", "tbody", "thead", "tfoot", "summary", "figcaption", "body", "html"}
SCOPES = {"article", "main", "section", "div", "table", "ul", "ol", "dl", "body", "blockquote", "nav", "aside", "header", "footer", "form", "td", "th"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
# Parts of class names and ids that name what is not the article.
NAMED = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie",
         "cookies", "consent", "gdpr", "notice", "notification", "sidebar", "side", "aside", "comment", "comments", "commentlist", "disqus", "reply",
         "replies", "respond", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "topbar", "toolbar", "masthead", "footer",
         "header", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "popup",
         "modal", "overlay", "widget", "pagination", "pager", "copyright", "skip", "search"}
INSIDE, LOOSE, OUTSIDE = 2, 1, 0     # lines of the first article or main have INSIDE, of the next one INSIDE + 1, and so on
LISTED = 1_000_000                   # most line numbers in a broadcast


def _excluded(name: str, attributes: str, in_article: bool) -> bool:
    if name in DROPPED or (name == "header" and not in_article):
        return True
    if not attributes or name in ("body", "html"):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ROLES):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key in ("class", "id") and name not in ("article", "main", "h1") and not NAMED.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
        if key in ("class", "id") and name in ("article", "main") and not {"comment", "comments", "reply"}.isdisjoint(re.split(r"[^a-z0-9]+", value)):
            return True
    return False


def page_lines(page: str) -> list[tuple[str, int]]:
    """Lines of a page in order, each with where it stands.

    OUTSIDE: boilerplate; LOOSE: in no container; from INSIDE on: the number of the outermost article or main.
    """
    lines: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool]] = []      # name, excluded, article
    out = within = containers = 0
    part: list[str] = []

    def flush() -> None:
        if part:
            text = " ".join("".join(part).split())
            if text:
                lines.append((text, OUTSIDE if out else INSIDE + containers - 1 if within else LOOSE))
            part.clear()

    def pop_to(depth: int) -> None:
        nonlocal out, within
        while len(stack) > depth:
            _, excluded, article = stack.pop()
            out -= excluded
            within -= article

    def close_above(names: set) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                pop_to(k)
                return
            if stack[k][0] in SCOPES:
                return

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            text = m[0]
            if text[0] != "<":
                part.append(html.unescape(text))
            elif len(text) == 1:
                part.append("<")
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCKS:
                flush()
            elif name in ("td", "th"):
                part.append(" ")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    flush() if out or stack[k][1] or stack[k][2] else None
                    pop_to(k)
                    break
                if stack[k][0] in ("article", "main", "body") and name not in ("html", "body", "main", "article"):
                    break
            continue
        if name == "br":
            part.append(" ")
            continue
        if name in BLOCKS:
            flush()
        elif name in ("td", "th"):
            part.append(" ")
        if name in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if name in VOID:
            continue
        if name in NOT_IN_P:
            close_above({"p"})
        if name in CLOSED_BY:
            close_above(CLOSED_BY[name])
        excluded = _excluded(name, m[3], within > 0)
        if excluded:
            flush()
        article = name in ("article", "main")
        containers += article and not within
        stack.append((name, excluded, article))
        out += excluded
        within += article
    flush()
    return lines


def line_hashes(lines: list[tuple[str, int]]) -> list[int]:
    return [crc32(t.encode("utf-8", "surrogatepass")) << 16 | len(t) & 0xFFFF for t, _ in lines]


def shared_lines(own: list[int], other: list[int]) -> set[int]:
    """Positions of ``own`` on a longest common subsequence with ``other`` (bit-parallel, exact)."""
    where: dict[int, int] = {}
    for i, h in enumerate(own):
        where[h] = where.get(h, 0) | 1 << i
    full = (1 << len(own)) - 1
    rows = [full]
    for h in other:
        v, hit = rows[-1], where.get(h, 0)
        u = v & hit
        rows.append(((v + u) | (v - u)) & full)
    found, i, j = set(), len(own), len(other)
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif not rows[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            found.add(i)
    return found


def decided(where: list[int], shared: set[int]) -> list[int]:
    """Positions of the lines that are the main text, given those shared with the nearest page."""
    containers = {w for w in where if w >= INSIDE}
    if containers:
        articles = {w for i, w in enumerate(where) if w >= INSIDE and i not in shared} or containers
        return [i for i, w in enumerate(where) if w in articles]
    loose = [i for i, w in enumerate(where) if w == LOOSE]
    return [i for i in loose if i not in shared] or loose


def taken(where: list[int], own: list[int], other: list[int] | None) -> list[int]:
    """Positions of the lines that differencing takes from what structure alone would keep."""
    stay = set(decided(where, shared_lines(own, other) if other else set()))
    return [i for i in decided(where, set()) if i not in stay]


def text_without(page: str | None, gone: list[int] | None) -> str:
    lines, lost = page_lines(page or ""), set(gone or ())
    return "\n\n".join(lines[i][0] for i in decided([w for _, w in lines], set()) if i not in lost)


def main_text(page: str | None, other: list[int] | None) -> str:
    """Main text of a page beside the line hashes of the nearest page."""
    lines = page_lines(page or "")
    return text_without(page, taken([w for _, w in lines], line_hashes(lines), list(other) if other is not None else None))


def _address() -> list:
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[?#].*$", "")
    return [F.lower(F.regexp_extract(rest, r"^([^/]*)", 1)).alias("__host"), F.regexp_extract(rest, r"^[^/]*(.*)$", 1).alias("__path")]


def extract(pages: DataFrame, name: str = "main_text") -> DataFrame:
    """``pages`` (page_id, url, html and any other columns) with the main text of every page."""
    key = F.xxhash64("page_id", "url", "html")
    schema = "__key long, __host string, __path string, __lines array<long>, __where array<int>"

    def hashes(batches):
        for b in batches:
            found = [(line_hashes(lines), [w for _, w in lines]) for lines in (page_lines(x or "") for x in b.column("html").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array([h for h, _ in found], pa.list_(pa.int64())), pa.array([w for _, w in found], pa.list_(pa.int32()))],
                ["__key", "__host", "__path", "__lines", "__where"])

    narrow = pages.select(key.alias("__key"), *_address(), F.col("html").cast("string").alias("html")).mapInArrow(hashes, schema)
    ranked = cut_lineage(with_global_rank(
        narrow.groupBy("__key").agg(*[F.first(c).alias(c) for c in ("__host", "__path", "__lines", "__where")]),
        F.col("__host"), F.col("__path"), F.col("__key"), name="__rank"))
    side = {s: ranked.select((F.col("__rank") + step).alias("__rank"), F.col("__host").alias(f"__{s}_host"),
                             F.col("__path").alias(f"__{s}_path"), F.col("__lines").alias(f"__{s}_lines")) for s, step in (("before", 1), ("after", -1))}

    def nearness(s: str):
        # length of the common beginning of whole paths, by steps of halving size
        own, other = F.col("__path"), F.col(f"__{s}_path")
        common = F.aggregate(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), F.lit(0), lambda known, step: F.when(
            (step <= F.least(F.length(own), F.length(other)) - known)
            & (F.substring(own, F.lit(1), known + step) == F.substring(other, F.lit(1), known + step)), known + step).otherwise(known))
        return F.when(F.col(f"__{s}_host") == F.col("__host"), common).otherwise(-1)

    paired = (
        ranked.join(side["before"], "__rank", "left").join(side["after"], "__rank", "left")
        .select("__key", "__lines", "__where", F.when(F.greatest(nearness("before"), nearness("after")) < 0, F.lit(None))
                .when(nearness("before") >= nearness("after"), F.col("__before_lines")).otherwise(F.col("__after_lines")).alias("__other")))

    def differences(batches):
        for b in batches:
            gone = [taken(w, h, o) for h, w, o in zip(*[c.to_pylist() for c in b.columns[1:]], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("__key"), pa.array(gone, pa.list_(pa.int32()))], ["__key", "__gone"])

    gone = cut_lineage(paired.mapInArrow(differences, "__key long, __gone array<int>").where(F.size("__gone") > 0))
    listed = gone.agg(F.coalesce(F.sum(F.size("__gone") + 1), F.lit(0))).first()[0]
    kept = [c for c in pages.columns if c != name]
    rows = pages.withColumn("__key", key).join(F.broadcast(gone) if listed <= LISTED else gone, "__key", "left").select(
        *kept, F.col("html").cast("string").alias("__html"), "__gone")

    def texts(batches):
        for b in batches:
            n = b.num_columns
            text = [text_without(h, g) for h, g in zip(b.column(n - 2).to_pylist(), b.column(n - 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(text, pa.string())], [*kept, name])

    return rows.mapInArrow(texts, pages.select(*kept).withColumn(name, F.lit("")).schema)
