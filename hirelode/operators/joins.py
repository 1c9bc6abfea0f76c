"""Joins between postings, applications, companies, feedback and lists of ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as V
from ..functions import skills as S
from ..functions import text as T
from ..session import as_of, cut_lineage, with_global_rank
from .sets import first_by
from .shared_words import totals_of_sharing


def exclude_applied(df: DataFrame, apps: DataFrame) -> DataFrame:
    """Archived applications do not hide a posting. ``apps``: id, status."""
    return df.join(apps.where("status <> 'archived'").select("id"), "id", "left_anti")


def exclude_closed(df: DataFrame, closed: DataFrame) -> DataFrame:
    """J2"""
    return df.join(closed.select("id"), "id", "left_anti")


def suppress_tombstones(incoming: DataFrame, tombs: DataFrame, store: DataFrame) -> DataFrame:
    """Pruned ids stay away unless the store still holds them."""
    buried = tombs.select("id").distinct().join(store.select("id"), "id", "left_anti")
    return incoming.join(buried, "id", "left_anti")


def protected_ids(*lists: DataFrame) -> DataFrame:
    """Ids any list tracks."""
    return reduce(lambda a, b: a.union(b), [x.select("id") for x in lists]).where("id IS NOT NULL").distinct()


def applications_with_postings(apps: DataFrame, postings: DataFrame) -> DataFrame:
    """Each application with its posting as a struct. ``apps``: id of the posting."""
    return apps.join(postings.select("id", F.struct(*postings.columns).alias("posting")), "id", "left")


def tracked_postings(tracked: DataFrame, postings: DataFrame, kind: str) -> DataFrame:
    """Listed postings; viewed and saved ones get a placeholder when gone, never a made-up URL."""
    joined = tracked.join(postings, "id", "inner" if kind == "apply_later" else "left")
    if kind == "apply_later":
        return joined
    label = {"viewed": "Viewed Job", "saved": "Saved Job"}[kind]
    return joined.withColumns({
        "title": F.coalesce("title", F.concat(F.lit(f"{label} ("), "id", F.lit(")"))),
        "company": F.coalesce("company", F.lit("LinkedIn / Partner")),
        "location": F.coalesce("location", F.lit("India")),
        "source": F.coalesce("source", F.lit(f"{kind}_history")),
    })


def company_health(companies: DataFrame, metrics: DataFrame) -> DataFrame:
    """Companies with their scan counters; never scanned ones count zero."""
    return companies.join(metrics, "company_id", "left").withColumns({
        c: F.coalesce(c, F.lit(0)) for c in ("total_scans", "successful_scans", "jobs_extracted")})


def reconcile(apps: DataFrame, postings: DataFrame) -> DataFrame:
    """Adds matched_id and outcome by id, then unique URL, then unique (company, title)."""
    def key(name: str) -> Column:
        return T.strip(F.coalesce(F.col(name), F.lit("")))

    by_id = postings.select(F.col("id").alias("job_id"), F.col("id").alias("__by_id")).distinct()
    by_url = postings.select(key("url").alias("__url"), "id").where("__url <> ''").groupBy("__url").agg(
        F.count(F.lit(1)).alias("__url_n"), F.min("id").alias("__by_url"))
    by_role = postings.select(F.lower(key("company")).alias("__company"), F.lower(key("title")).alias("__title"), "id") \
        .groupBy("__company", "__title").agg(F.count(F.lit(1)).alias("__role_n"), F.min("id").alias("__by_role"))
    joined = (
        apps.withColumns({"__url": key("url"), "__company": F.lower(key("company")), "__title": F.lower(key("job_title"))})
        .join(by_id, "job_id", "left").join(by_url, "__url", "left").join(by_role, ["__company", "__title"], "left"))
    one_url, one_role = F.col("__url_n") == 1, F.col("__role_n") == 1
    return joined.withColumns({
        "matched_id": F.when(F.col("__by_id").isNotNull(), F.col("__by_id")).when(one_url, F.col("__by_url"))
        .when(F.col("__url_n") > 1, F.lit(None)).when(one_role, F.col("__by_role")),
        "outcome": F.when(F.col("__by_id").isNotNull() | one_url, F.lit("migrated"))
        .when(F.col("__url_n") > 1, F.lit("ambiguous")).when(one_role, F.lit("migrated"))
        .when(F.col("__role_n") > 1, F.lit("ambiguous")).otherwise(F.lit("unmatched")),
    }).drop("__url", "__company", "__title", "__by_id", "__by_url", "__url_n", "__by_role", "__role_n")


def remap_ids(dependents: DataFrame, id_map: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """Dependents under canonical ids, first one per id, with an orphan flag. ``id_map``: old_id, id."""
    remapped = dependents.withColumnRenamed("id", "old_id").join(
        id_map.withColumnRenamed("id", "new_id"), "old_id", "left") \
        .withColumn("id", F.coalesce("new_id", "old_id")).drop("new_id")
    alive = known.select("id").distinct().withColumn("__known", F.lit(True))
    flagged = remapped.join(alive, "id", "left").withColumn("orphan", F.col("__known").isNull()).drop("__known")
    return first_by(flagged, ["id"], [order])


# --- containment -------------------------------------------------------------

GRAM = 3


def containment_pairs(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (needle, text) of distinct strings where the text contains the needle.

    Every place of a text gives one row, its next three letters.  A needle looks for the
    rarest of its own three-letter runs at the place it has in the needle; one or two letters
    look for the start of such a row.  What meets is tested on the strings themselves.
    The empty needle is contained in everything and is left out.
    """
    asked = needles.select("needle").distinct().where("needle <> ''").withColumn("size", F.least(F.length("needle"), F.lit(GRAM)))
    known = cut_lineage(texts.select("text").distinct().where("text <> ''").withColumn("h", F.xxhash64("text")))
    places = cut_lineage(known.select("h", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("text")), lambda i: F.col("text").substr(i, F.lit(GRAM)))).alias("gram")).distinct())
    often = places.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    runs = F.transform(F.sequence(F.lit(1), F.length("needle") - GRAM + 1), lambda i: F.col("needle").substr(i, F.lit(GRAM)))
    # a run that no text has leaves its needle without a pair
    rarest = asked.where(F.col("size") == GRAM).select("needle", F.explode(F.array_distinct(runs)).alias("gram")).join(often, "gram", "left") \
        .groupBy("needle").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("r")).select("needle", F.col("r.gram").alias("gram"))
    met = rarest.join(places, "gram").select("needle", "h")
    for size in range(1, GRAM):
        starts = places.select("h", F.left("gram", F.lit(size)).alias("needle")).where(F.length("needle") == size).distinct()
        met = met.unionByName(asked.where(F.col("size") == size).select("needle").join(starts, "needle"))
    # equal hashes of different texts only mean one more test
    return met.join(known, "h").where(F.col("text").contains(F.col("needle"))).select("needle", "text")


def company_applications(companies: DataFrame, apps: DataFrame, name: str = "company") -> DataFrame:
    """(name, application) for every application whose company contains the name."""
    names = companies.select(F.col(name).alias("asked")).distinct().withColumn("needle", F.lower("asked"))
    tagged = apps.withColumn("text", F.lower("company"))
    pairs = containment_pairs(names, tagged.select("text"))
    return names.join(pairs, "needle").join(tagged, "text").drop("needle", "text")


def duplicate_applications(postings: DataFrame, apps: DataFrame, now, days: int = 30) -> DataFrame:
    """Postings like one applied to lately: first such application per posting.

    Roles are compared as distinct (company, title) pairs; postings and
    applications join back by equality.
    """
    now = as_of(now)
    mine = apps.where((F.col("status") != "archived") & F.coalesce(
        V.whole_days_between("applied_at", now) <= days, F.lit(True))).withColumns(
        {"__c2": F.lower(F.trim("company")), "__t2": F.lower(F.trim("job_title"))})
    theirs = postings.withColumns({"__c1": F.lower(F.trim("company")), "__t1": F.lower(F.trim("title"))})
    c1 = theirs.select(F.col("__c1").alias("x")).distinct()
    c2 = mine.select(F.col("__c2").alias("x")).distinct()
    forward = containment_pairs(c1.select(F.col("x").alias("needle")), c2.select(F.col("x").alias("text"))) \
        .select(F.col("needle").alias("__c1"), F.col("text").alias("__c2"))
    backward = containment_pairs(c2.select(F.col("x").alias("needle")), c1.select(F.col("x").alias("text"))) \
        .select(F.col("text").alias("__c1"), F.col("needle").alias("__c2"))
    roles1 = theirs.select("__c1", "__t1").distinct()
    # one application per distinct role is enough: the first one
    roles2 = mine.groupBy("__c2", "__t2").agg(F.min(F.struct("applied_at", "application_id", "company")).alias("app"))
    alike = (
        roles1.join(forward.union(backward).distinct(), "__c1").join(roles2, "__c2")
        .where((T.token_set_ratio("__t1", "__t2") >= 0.4)
               | F.col("__t2").contains(F.col("__t1")) | F.col("__t1").contains(F.col("__t2")))
        .groupBy("__c1", "__t1").agg(F.min("app").alias("app")))
    return theirs.join(alike, ["__c1", "__t1"]).withColumns({
        "application_id": F.col("app.application_id"),
        "warning": F.concat(F.lit("You applied to a similar role at "), "app.company", F.lit(" on "),
                            F.date_format("app.applied_at", "yyyy-MM-dd"), F.lit(" - continue anyway?")),
    }).drop("__c1", "__t1", "app")


def feedback_overlap(keys: DataFrame, feedback: DataFrame) -> DataFrame:
    """Per (company, title): feedback items sharing a word, and how many said yes.

    Both sides are folded to distinct roles first; feedback carries weights, and words
    that very many roles use are counted by groups of roles.
    """
    roles = feedback.groupBy(F.lower("company").alias("fc"), F.lower("job_title").alias("ft")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("action") == "yes").alias("positive"))
    items = roles.select(F.struct("fc", "ft").alias("role"), "total", "positive", T.tokens(F.concat_ws(" ", "ft", "fc")).alias("words"))
    asked = keys.select("company", "title").distinct().select(
        F.struct("company", "title").alias("key"), T.tokens(F.concat_ws(" ", F.lower(F.trim("title")), F.lower(F.trim("company")))).alias("words"))
    return totals_of_sharing(asked, items, "key", "role", ["total", "positive"]).select("key.*", "total", "positive")


def improvements_with_trials(log: DataFrame, trials: DataFrame) -> DataFrame:
    """J14"""
    return log.join(trials.select("adjustment_id", F.col("status").alias("trial_status")), "adjustment_id", "left")


def query_slice(roles: DataFrame, locations: DataFrame, targets: DataFrame, n: int, seed: int) -> DataFrame:
    """The slice of search queries of one cycle, rotating with the seed.

    The places are configured terms and travel with every role as one list; the plan of
    all queries is numbered over range partitions.
    """
    places = locations.agg(F.array_sort(F.collect_set("location"))).scalar()
    pairs = roles.select("role", F.explode(places).alias("place")).select(F.concat_ws(" ", "role", F.lit("in"), "place").alias("query"))
    plan = pairs.union(targets.select(F.col("target").alias("query"))).distinct()
    numbered = with_global_rank(plan, F.col("query"), name="position").withColumn("position", F.col("position") - 1)
    total = plan.agg(F.count(F.lit(1))).scalar()
    return numbered.where(F.pmod(F.col("position") - F.lit(seed * n), total) < n)


def skill_overlap(postings: DataFrame, profiles: dict[str, list[str]]) -> DataFrame:
    """Matched and missing skills of every posting for every profile."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("profile"), F.array(*[F.lit(s) for s in skills]).alias("has"))
        for name, skills in profiles.items()]))
    skilled = postings.withColumn("job_skills", S.extract_skills(F.concat_ws(" ", "title", "description")))
    met = skilled.withColumn("__p", rows).withColumn("__m", S.matched_missing("job_skills", "__p.has"))
    return met.withColumns({"profile": F.col("__p.profile"), "matched": F.col("__m.matched"),
                            "missing": F.col("__m.missing")}).drop("__p", "__m")


def new_candidates(candidates: DataFrame, known: DataFrame, blocked: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """First-seen new names, the best ``limit`` of them."""
    def plain(df: DataFrame) -> DataFrame:
        return df.select(F.lower(F.trim("name")).alias("__n")).distinct()

    fresh = candidates.withColumn("__n", F.lower(F.trim("name"))).where("__n <> ''") \
        .join(plain(known), "__n", "left_anti").join(plain(blocked), "__n", "left_anti")
    return first_by(fresh, ["__n"], order).drop("__n").orderBy(*order).limit(limit)


def apply_url(postings: DataFrame, companies: DataFrame) -> DataFrame:
    """A link to apply: posting, canonical, company career page, else null."""
    own = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.nullif(F.col("canonical_url"), F.lit("")))
    names = companies.groupBy(F.lower("name").alias("__name")).agg(F.min_by("career_url", "company_id").alias("__site"))
    joined = postings.withColumn("__name", F.lower(F.coalesce("company", F.lit("")))).join(names, "__name", "left")
    site = F.when(F.col("__site").startswith("http"), F.col("__site"))
    return joined.withColumn("apply_url", F.when(own.startswith("http"), own).otherwise(site)).drop("__name", "__site")


def feed_cards(postings: DataFrame, companies: DataFrame, metrics: DataFrame, apps: DataFrame) -> DataFrame:
    """Postings with company counters and the latest application."""
    firm = companies.select(T.clean_company("name").alias("normalized_company"), "company_id", "ats") \
        .groupBy("normalized_company").agg(F.min(F.struct("company_id", "ats")).alias("firm"))
    mine = apps.groupBy("id").agg(F.max(F.struct("applied_at", "application_id", "status")).alias("mine"))
    return (
        postings.join(firm, "normalized_company", "left").withColumn("company_id", F.col("firm.company_id"))
        .join(metrics, "company_id", "left").join(mine, "id", "left")
        .withColumns({"ats": F.col("firm.ats"), "application_id": F.col("mine.application_id"),
                      "application_status": F.col("mine.status")}).drop("firm", "mine"))

