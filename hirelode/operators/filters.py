"""Predicates over postings, companies, applications and pages.

Postings carry the last match flattened as score, tier and profile_version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import fields as V
from ..functions import skills as S
from ..functions import text as T
from ..session import as_of, cut_lineage


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# --- validity ----------------------------------------------------------------

def validity(df: DataFrame) -> DataFrame:
    """adds is_valid and reasons, the list of everything wrong with a posting."""
    title, url, loc = T.strip(_text("title")), T.strip(_text("url")), T.strip(_text("location"))
    company = T.strip(_text("company"))
    tl, ul = F.lower(title), F.lower(url)
    host_path = F.regexp_replace(F.regexp_replace(ul, r"^[a-z][a-z0-9+.\-]*://", ""), r"[?#].*$", "")
    url_part = F.get(F.filter(
        F.array(*[F.lit(p) for p in rules.NON_JOB_URL_PARTS]), lambda p: host_path.contains(p)), F.lit(0))
    phrase = F.get(F.filter(
        F.array(*[F.lit(p) for p in rules.STATIC_PAGE_PHRASES]), lambda p: tl.contains(p)), F.lit(0))
    exact = tl.isin(rules.EXACT_TITLE_BLACKLIST)
    has_location = ~F.lower(loc).isin(rules.MISSING_MARKERS)
    has_date = F.coalesce(T.strip(F.col("posted_date").cast("string")), F.lit("")) != ""
    has_job_url = T.has_any(ul, rules.JOB_URL_PARTS)
    has_word = tl.rlike(T.bounded(T.any_of(rules.JOB_TITLE_WORDS)))
    place = F.concat(loc, F.lit(" "), title)
    india_scoped = company.contains("India") | ul.contains("india")
    abroad = place.rlike(T.bounded(T.any_of(rules.NON_INDIA_WORDS), "iU")) \
        & ~place.rlike(T.bounded(T.any_of(rules.INDIA_WORDS), "iU"))

    def quoted(lead: str, what: Column) -> Column:
        return F.concat(F.lit(lead + " '"), what, F.lit("'"))

    found = F.array_compact(F.array(
        F.when(title.rlike(T.bounded(T.any_of(rules.NON_JOB_TITLE_PHRASES), "iU")),
               quoted("Title matches non-job listing pattern:", title)),
        F.when(T.has_any(host_path, rules.NON_JOB_URL_PARTS),
               F.concat(quoted("URL hostname/path indicates non-job article/event/course:", url_part),
                        quoted(" in", host_path))),
        F.when(exact, quoted("Title is exact non-job text:", title))
        .when(T.has_any(tl, rules.STATIC_PAGE_PHRASES), quoted("Title contains blacklisted term:", phrase)),
        F.when(~has_location & ~has_date & ~has_job_url, F.lit("Lacks all 3 positive job signals")),
        F.when(~has_word & ~has_job_url & ~has_date,
               F.lit("No job title structure/keyword and no job URL pattern")),
        F.when(india_scoped & abroad,
               F.concat(quoted("Non-India location", loc), quoted(" for India-scoped company", company)))))
    reasons = F.when(F.length(title) < 3, F.array(F.lit("Title too short or missing"))).otherwise(found)
    return df.withColumn("reasons", reasons).withColumn("is_valid", F.size("reasons") == 0)


def valid_only(df: DataFrame) -> DataFrame:
    return validity(df).where("is_valid").drop("is_valid", "reasons")


def _integrity(df: DataFrame) -> DataFrame:
    synthetic = _text("id").contains(rules.SYNTHETIC_ID_MARK)
    return validity(df).withColumn("reasons", F.concat(
        F.when(synthetic, F.array(F.lit("Id matches forbidden synthetic pattern")))
        .otherwise(F.array().cast("array<string>")), "reasons"))


def integrity_errors(df: DataFrame) -> DataFrame:
    """rows that may not be in the store, with every reason."""
    return _integrity(df).where(F.size("reasons") > 0).drop("is_valid")


def enforce_integrity(df: DataFrame) -> DataFrame:
    return _integrity(df).where(F.size("reasons") == 0).drop("is_valid", "reasons")


# --- time --------------------------------------------------------------------

def _first_stated(df: DataFrame, names: list[str]) -> Column:
    """First non-empty time text; only then is it parsed, so bad text stays unknown."""
    return T.first_non_empty(*[F.col(n).cast("string") for n in names if n in df.columns])


def event_time(df: DataFrame) -> Column:
    """The employer's date first, else when we saw the posting."""
    return V.iso_ts(_first_stated(df, ["posted_date", "first_seen", "scan_timestamp", "first_seen_at"]))


def age_hours(df: DataFrame, now) -> Column:
    """Age by the store's precedence of dates; null when unknown."""
    stated = _first_stated(df, ["posted_date", "first_seen", "first_seen_at", "scan_timestamp", "last_seen"])
    return V.hours_between(V.iso_ts(stated), as_of(now))


def _unless_all_fail(df: DataFrame, flag: Column) -> DataFrame:
    """Rows with the flag; every row when the flag holds nowhere."""
    flagged = df.withColumn("__keep", flag)
    any_kept = flagged.agg(F.max("__keep").alias("any")).scalar()
    return flagged.where(F.col("__keep") | ~F.coalesce(any_kept, F.lit(False))).drop("__keep")


def is_recent(df: DataFrame, hours: float, now) -> Column:
    return F.coalesce(V.hours_between(event_time(df), as_of(now)) <= hours, F.lit(True))


def recent(df: DataFrame, hours: float, now) -> DataFrame:
    """posted or seen within the window; unknown dates pass; never an empty feed."""
    return _unless_all_fail(df, is_recent(df, hours, now))


def expand_if_sparse(df: DataFrame, hours: float, min_results: int, now) -> DataFrame:
    """widest needed window, found from one pass of conditional counts."""
    steps = [s for s in rules.EXPANSION_STEPS_HOURS if s >= hours] or [hours, 72.0]
    seen = V.iso_ts(_first_stated(df, ["first_seen", "posted_date", "scan_timestamp"]))
    aged = df.withColumn("__age", V.hours_between(seen, as_of(now)))

    def within(step: float) -> Column:
        return F.coalesce(F.col("__age") <= step, F.lit(True))

    counts = aged.agg(*[F.count_if(within(s)).alias(f"s{i}") for i, s in enumerate(steps)])
    chosen = F.coalesce(*[F.when(F.col(f"s{i}") >= min_results, F.lit(float(s))) for i, s in enumerate(steps)],
                        F.lit(float(max(steps))))
    used = counts.select(chosen.alias("used")).scalar()
    return aged.withColumn("timeframe_used_hours", used) \
        .where(F.coalesce(F.col("__age") <= F.col("timeframe_used_hours"), F.lit(True))) \
        .withColumn("was_expanded", F.col("timeframe_used_hours") > float(steps[0])).drop("__age")


# --- feed filters ------------------------------------------------------------

def _any(conditions: list[Column], when_empty: bool) -> Column:
    out = F.lit(when_empty) if not conditions else conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def role_flag(terms: list[str], title: str = "title") -> Column:
    return _any([S.matches_role(title, t) for t in terms], True)


def match_role(df: DataFrame, terms: list[str]) -> DataFrame:
    """F5"""
    return df.where(role_flag(terms))


def location_flag(terms: list[str]) -> Column:
    return _any([S.matches_location("location", "description", t) for t in terms], True)


def match_location(df: DataFrame, terms: list[str]) -> DataFrame:
    """F6"""
    return df.where(location_flag(terms))


def stated_years(df: DataFrame, name: str = "min_years") -> DataFrame:
    """P12 of whole postings, row by row: cheaper than a shuffle of the different texts."""
    return df.withColumn(name, V.min_experience_years("title", F.lit(""), "description"))


def experience_flag(max_years: Column | int | None, stated: str) -> Column:
    if max_years is None:
        return F.lit(True)
    return F.coalesce(F.col(stated) <= max_years, F.lit(True))


def within_experience(df: DataFrame, max_years: int | None) -> DataFrame:
    """demands no more years than the candidate has; unstated passes."""
    if max_years is None:
        return df
    return stated_years(df, "__years").where(experience_flag(max_years, "__years")).drop("__years")


def exclusion_flag(terms: list[str] | None) -> Column:
    terms = rules.DEFAULT_EXCLUSIONS if terms is None else terms
    banned = F.lower(_text("title")).rlike(T.bounded(T.any_of([t.lower() for t in terms]))) if terms else F.lit(False)
    return ~banned & ~S.numbered_level("title")


def exclude_seniority(df: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """F8"""
    return df.where(exclusion_flag(terms))


def is_verified() -> Column:
    return F.coalesce(F.col("tier").isin(rules.VERIFIED_TIERS), F.lit(False)) & F.col("score").isNotNull()


def score_bar_flag(bar: int, score: Column | None = None) -> Column:
    score = F.coalesce(F.col("score"), F.lit(rules.DEFAULT_SCORE)) if score is None else score
    lower = max(0, bar - rules.VERIFIED_BAR_DISCOUNT)
    return score >= F.when(is_verified(), F.lit(lower)).otherwise(F.lit(bar))


def min_score(df: DataFrame, bar: int) -> DataFrame:
    """verified scores face a lower bar; a missing score counts as 50."""
    return df.where(score_bar_flag(bar))


def match_state(profile_version: str | None) -> Column:
    """'pending' (unscored), 'stale' (other profile version) or 'ready'."""
    if profile_version is None:
        return F.lit("ready")
    return F.when(F.col("score").isNull(), F.lit("pending")) \
        .when(F.col("profile_version").isNotNull() & (F.col("profile_version") != profile_version), F.lit("stale")) \
        .otherwise(F.lit("ready"))


def split_pending(df: DataFrame, profile_version: str | None) -> tuple[DataFrame, DataFrame]:
    marked = df.withColumn("match_state", match_state(profile_version))
    return marked.where("match_state = 'ready'"), marked.where("match_state <> 'ready'")


def global_filter_flag(filters: dict[str, list[str]], skills: Column | None = None) -> Column:
    """every category needs one of its values somewhere in the text."""
    body = T.combined_text("title", "location", "company", "description", None, skills)
    out = F.lit(True)
    for values in filters.values():
        values = [values] if isinstance(values, str) else values
        wanted = [str(v).lower().strip() for v in values if v and str(v).strip()]
        if wanted:
            out = out & T.has_any(body, wanted)
    return out


def global_filters(df: DataFrame, filters: dict[str, list[str]]) -> DataFrame:
    return df.where(global_filter_flag(filters))


def search_filter(df: DataFrame, now, bar: int = 50, roles: list[str] = (), locations: list[str] = (),
                  hours: float = 168, filters: dict[str, list[str]] | None = None) -> DataFrame:
    """the search cycle's filter; unfiltered when nothing passes."""
    title, loc = F.lower(_text("title")), F.lower(_text("location"))
    role = _any([title.rlike(rf"(?U)(?:^|\s|\b){T.any_of([r.strip().lower()])}(?:$|\s|\b)") for r in roles], True)
    place = []
    for term in (t.strip().lower() for t in locations):
        if term == "remote":
            place.append(loc.contains("remote") | F.lower(_text("description")).rlike(T.bounded("remote")))
        else:
            place.append(loc.rlike(T.bounded(T.any_of([term]))))
    fresh = F.coalesce(V.hours_between(V.iso_ts("first_seen"), as_of(now)) <= hours, F.lit(True))
    keep = (F.coalesce(F.col("score"), F.lit(0)) >= bar) & role & _any(place, True) & fresh
    return _unless_all_fail(df, keep & global_filter_flag(filters or {}))


# fixed values: the scanner's wider word lists, matched as substrings
SCOPE_ABROAD = [
    "china", "nigeria", "milan", "ita", "italy", "seattle", "berlin", "tokyo", "toyko", "melbourne",
    "sydney", "london", "suzhou", "lagos", "dublin", "irl", "deu", "aus", "gbr", "uk", "chn", "sgp",
    "usa", "u.s.a", "united states", "australia", "germany", "united kingdom", "japan", "canada",
    "france", "brazil", "south africa",
]


def location_in_scope(df: DataFrame, company: str = "company", career_url: str = "career_url") -> DataFrame:
    """companies scoped to India keep only postings not placed abroad."""
    place = F.lower(F.concat_ws(" ", _text("location"), _text("title")))
    scoped = _text(company).contains("India") | F.lower(_text(career_url)).contains("india")
    return df.where(~(scoped & T.has_any(place, SCOPE_ABROAD) & ~T.has_any(place, rules.INDIA_WORDS)))


def admission_gate(probes: DataFrame, min_fresher: int = 1) -> DataFrame:
    """F16: verdict on probed boards; adds status and reason."""
    reason = (
        F.when(F.col("total_jobs") <= 0, F.lit("no public ATS endpoint found"))
        .when(F.col("india_jobs") <= 0, F.lit("no India-based openings"))
        .when(F.col("fresher_jobs") <= 0, F.lit("no fresher-eligible openings right now"))
        .when(F.col("fresher_india_jobs") <= 0, F.lit("fresher openings exist but none in India")))
    return probes.withColumn("reason", reason).withColumn(
        "status",
        F.when(F.col("reason").isNotNull(), F.lit("rejected"))
        .when(F.col("fresher_jobs") >= min_fresher, F.lit("verified")).otherwise(F.lit("watchlisted")))


# fixed values: what a page says of a posting that is gone. A sentence is a list of choices of words, "" for none
CLOSED_SENTENCES = [
    [["application", "applications"], ["are"], ["closed"], ["for"], ["this"]],
    [["closed"], ["for"], ["applications"]],
    [["no"], ["longer"], ["accepting"], ["applications"]],
    [["this"], ["job", "position", "posting", "role"], ["is", ""], ["no"], ["longer"], ["available", "active", "open"]],
    [["position"], ["has"], ["been"], ["filled"]],
    [["this"], ["job", "vacancy"], ["has"], ["expired"]],
    [["job"], ["posting"], ["is", ""], ["closed", "expired"]],
    [["sorry", "sorry,"], ["this"], ["job"], ["is", ""], ["closed", "expired", "unavailable"]],
]
CLOSED_FIELD = ('id="status"', 'value="expired"')


def _sentence(choices: list[list[str]]) -> str:
    """A pattern of the sentence with any white space between its words."""
    out = ""
    for words in choices:
        body = f"(?:{T.any_of([w for w in words if w])})"
        gap = r"\s+" if out else ""
        out += f"(?:{gap}{body})?" if "" in words else gap + body
    return out


def detect_closed(pages: DataFrame, html: str = "html", status: str = "status") -> DataFrame:
    """adds alive and reason; anything inconclusive counts as alive."""
    code = F.col(status) if status in pages.columns else F.lit(200)
    told = [r"\s+".join(T.any_of([x]) for x in CLOSED_FIELD), *map(_sentence, CLOSED_SENTENCES)]
    hit = F.regexp_extract(_text(html), "(?iU)(" + "|".join(told) + ")", 1)
    return pages.withColumn(
        "reason",
        F.when(code.isin(404, 410), F.concat(F.lit("HTTP "), code.cast("string")))
        .when(code != 200, F.concat(F.lit("inconclusive HTTP "), code.cast("string")))
        .when(hit != "", F.concat(F.lit("closed marker: '"), F.left(hit, F.lit(50)), F.lit("'")))
        .otherwise(F.lit("no closed markers"))
    ).withColumn("alive", ~(code.isin(404, 410) | ((code == 200) & (hit != ""))))


def due_for_check(df: DataFrame, state: DataFrame, now, hours: float = 72, bar: int = 50) -> DataFrame:
    """good open postings with a link, not checked lately. ``state``: id, checked_at."""
    seen = state.groupBy("id").agg(F.max("checked_at").alias("__checked"))
    return (
        df.where(_text("url").startswith("http") & (F.coalesce("score", F.lit(0)) >= bar)).join(seen, "id", "left")
        .where(F.coalesce(V.hours_between("__checked", as_of(now)) > hours, F.lit(True))).drop("__checked"))


def due_for_enrichment(df: DataFrame, state: DataFrame, source: str, url_part: str, bar: int = 50) -> DataFrame:
    """thin postings of one source not yet fetched. ``state``: id of done and failed ones."""
    thin = F.length(_text("description")) < rules.STUB_MIN_CHARS
    return df.where(
        (F.col("source") == source) & _text("url").contains(url_part) & thin
        & (F.coalesce("score", F.lit(0)) >= bar)).join(state.select("id"), "id", "left_anti")


def list_applications(apps: DataFrame, status=None, company=None, location=None) -> DataFrame:
    """F20"""
    if status:
        apps = apps.where(F.lower("status") == status.lower())
    if company:
        apps = apps.where(F.lower("company").contains(company.lower()))
    if location:
        apps = apps.where(F.lower("location").contains(location.lower()))
    return apps


def prune(df: DataFrame, protected: DataFrame, now, hours: float = rules.RETENTION_HOURS) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped); tracked postings and those of unknown age stay."""
    guard = protected.select("id").distinct().withColumn("__protected", F.lit(True))
    old = F.coalesce(age_hours(df, now) > hours, F.lit(False))
    marked = df.join(guard, "id", "left").withColumn("__drop", old & F.col("__protected").isNull())
    return marked.where(~F.col("__drop")).drop("__drop", "__protected"), \
        marked.where("__drop").drop("__drop", "__protected")


def zero_yield(companies: DataFrame, metrics: DataFrame) -> DataFrame:
    """companies without a success or without a posting, bot-protected ones aside."""
    joined = companies.join(metrics, "company_id", "left")
    if "bot_protected" in companies.columns:
        joined = joined.where(~F.coalesce("bot_protected", F.lit(False)))
    return joined.where(
        (F.coalesce("successful_scans", F.lit(0)) == 0) | (F.coalesce("jobs_extracted", F.lit(0)) == 0))


def preview_filter(df: DataFrame, bar: int, order: list[str], sample: int = 3) -> DataFrame:
    """how many rows would match, with the first titles (a top-k, never all rows)."""
    score = F.coalesce(F.col("score"), F.lit(rules.DEFAULT_SCORE))
    first = df.where(score >= bar).orderBy(*order).limit(sample).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(*order, "title"))), lambda r: r["title"]).alias("titles")).scalar()
    return df.agg(F.count_if(score >= bar).alias("would_match_count"), F.count(F.lit(1)).alias("total_evaluated")) \
        .withColumn("sample_matches", first)


def trials_due(trials: DataFrame, now, adjustment_id: str | None = None, outcomes: int = 20) -> DataFrame:
    """pending trials that are over."""
    over = (as_of(now) >= F.col("trial_period_end")) | (F.coalesce("outcomes_count", F.lit(0)) >= outcomes)
    if adjustment_id is not None:
        over = F.col("adjustment_id") == adjustment_id
    return trials.where((F.col("status") == "pending") & over)


def patterns_due(patterns: DataFrame, now, days: int = 7) -> DataFrame:
    """patterns last validated too long ago or at an unreadable time."""
    last = V.iso_ts(_first_stated(patterns, ["last_validated", "last_used"]))
    return patterns.where(F.coalesce(last <= as_of(now) - F.make_dt_interval(F.lit(days)), F.lit(True)))


def followups_due(apps: DataFrame, now, days: int = 5) -> DataFrame:
    """interviews without news. ``apps``: status, applied_at, last_history_at."""
    last = F.coalesce("last_history_at", "applied_at")
    return apps.where((F.col("status") == "interviewed") & (V.whole_days_between(last, as_of(now)) >= days))


def import_companies(rows: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """adds outcome (added / invalid / duplicate), company_id and a completed career_url.

    A row is a duplicate when its name or URL is known or was taken by an
    earlier accepted row.  Each round accepts the rows that are first for
    both their name and their URL and settles everything they block.
    """
    name, url = T.strip(_text("name")), T.strip(_text("career_url"))
    web = url.startswith("http://") | url.startswith("https://")
    ats = F.coalesce(F.nullif(F.col("ats_hint"), F.lit("")), F.lit("custom")) if "ats_hint" in rows.columns else F.lit("custom")
    cleaned = rows.withColumns({
        "name": name,
        "career_url": F.when(web | (url == ""), url).otherwise(F.concat(F.lit("https://"), url)),
        "ats": ats,
        "__ok": (name != "") & (url != "") & (web | url.contains(".")),
    }).withColumns({"__n": F.lower("name"), "__u": F.lower("career_url")})
    waiting = cut_lineage(
        cleaned.where("__ok").select(order, "__n", "__u")
        .join(existing.select(F.lower("name").alias("__n")).distinct(), "__n", "left_anti")
        .join(existing.select(F.lower("career_url").alias("__u")).distinct(), "__u", "left_anti"))
    accepted = None
    while not waiting.isEmpty():
        first_n = waiting.groupBy("__n").agg(F.min(order).alias("__fn"))
        first_u = waiting.groupBy("__u").agg(F.min(order).alias("__fu"))
        won = cut_lineage(waiting.join(first_n, "__n").join(first_u, "__u")
                          .where((F.col(order) == F.col("__fn")) & (F.col(order) == F.col("__fu")))
                          .select(order, "__n", "__u"))
        accepted = won if accepted is None else accepted.unionByName(won)
        waiting = cut_lineage(waiting.join(won.select("__n"), "__n", "left_anti").join(won.select("__u"), "__u", "left_anti"))
    taken = (accepted if accepted is not None else waiting).select(order).withColumn("__added", F.lit(True))
    return cleaned.join(taken, order, "left").withColumns({
        "outcome": F.when(~F.col("__ok"), F.lit("invalid")).when(F.col("__added"), F.lit("added")).otherwise(F.lit("duplicate")),
        "company_id": F.replace(F.replace("__n", F.lit(" "), F.lit("-")), F.lit("."), F.lit("")),
    }).drop("__n", "__u", "__ok", "__added")
