"""Skill extraction, role classes, seniority: Column expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import _c, any_of, bind, bounded, has_any, strip


def _skill_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def _holds_any(t: Column, literals: list[str]) -> Column:
    out = t.contains(literals[0])
    for word in literals[1:]:
        out = out | t.contains(word)
    return out


# a word of a text is a run of these
LETTER = r"[\p{L}\p{N}_]"


def prefix_tree(words) -> str:
    """Alternation of literal words that tells them apart letter by letter, so that few letters of a text are tried twice."""
    root: dict = {}
    for word in words:
        node = root
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def body(node: dict) -> str:
        ways = [re.escape(letter) + body(child) for letter, child in sorted(node.items()) if letter]
        if not ways:
            return ""
        return f"(?:{'|'.join(ways)})" + ("?" if "" in node else "")

    return body(root)


def _context_pattern(skill: str, around: dict) -> str:
    """Where an ambiguous name stands for the skill."""
    name, blank = skill.upper(), r"\s"
    ways = [any_of(around["names"])] if around["names"] else []
    if around["followers"]:
        ways.append(rf"{name}{blank}*(?:{any_of(around['followers'])})")
    if around["leads"]:
        leads = "|".join(re.escape(w) for w in around["leads"])
        ways.append(rf"(?:{leads}){blank}+{name}")
    if around["beside"]:
        ways.append(rf"{name}{blank}*[/,]{blank}*(?:{any_of(around['beside'])})")
    if skill == "C":                                # beside C++ only
        ways += [rf"C{blank}*/{blank}*C\+\+", rf"C{blank}+(?:OR|,){blank}+C\+\+"]
    return rf"(?U)\b(?:{'|'.join(ways)})(?:$|{blank}|\b)"


def extract_skills(text) -> Column:
    """Sorted skills named in a text.

    One pass of one prefix tree finds every dictionary entry of up to three words, other
    spellings and the ambiguous names; only a text that holds such a name is searched for
    the words that must stand around it.
    """
    plain = {s.upper(): s for s in rules.KNOWN_SKILLS if s not in rules.CONTEXT_SKILLS} | rules.SKILL_RESCUES
    heads: dict[str, list[str]] = {}
    for skill, around in rules.CONTEXT_SKILLS.items():
        heads[skill] = [skill.upper(), *[n for n in around["names"] if not n.startswith(skill.upper() + "-") and "/" not in n]]
    entries = sorted({*plain, *[h for own in heads.values() for h in own]})
    wordy, symbol = [e for e in entries if e[-1].isalnum()], [e for e in entries if not e[-1].isalnum()]
    glued = "|".join(rf"{s.upper()}(?={any_of(a['followers'])})" for s, a in rules.CONTEXT_SKILLS.items() if a["followers"])
    pattern = rf"(?<!{LETTER})(?:{prefix_tree(symbol)}(?=$|\s|{LETTER})|{prefix_tree(wordy)}(?!{LETTER})|{glued})"
    # an entry may hold another one as a word of its own
    inside = {e: sorted({plain[x] for x in plain if re.search(rf"(?<!\w){re.escape(x)}(?!\w)", e)}) for e in plain}
    display = F.create_map(*[x for e, names in inside.items() for x in (F.lit(e), F.array(*[F.lit(n) for n in names]))])

    def named(t: Column, found: Column) -> Column:
        sure = F.flatten(F.array_compact(F.transform(found, lambda s: F.element_at(display, s))))
        by_context = [
            F.when(F.arrays_overlap(found, F.array(*[F.lit(h) for h in heads[skill]])) & t.rlike(_context_pattern(skill, around)), F.lit(skill))
            for skill, around in rules.CONTEXT_SKILLS.items()]
        return F.array_sort(F.array_union(sure, F.array_compact(F.array(*by_context))))

    return bind(F.upper(F.coalesce(_c(text), F.lit(""))), lambda t: bind(
        F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), 0)), lambda found: F.when(F.size(found) > 0, named(t, found)).otherwise(F.array().cast("array<string>"))))


def canonical_skill(col) -> Column:
    """One spelling per skill."""
    s = strip(_c(col))
    return F.coalesce(F.element_at(_skill_map(rules.SKILL_SYNONYMS), F.upper(s)), s)


def matched_missing(job_skills, profile_skills) -> Column:
    """struct(matched, missing) of canonical skills, ignoring case."""
    job = F.array_sort(F.array_distinct(F.transform(_c(job_skills), canonical_skill)))
    mine = F.transform(_c(profile_skills), lambda s: F.upper(canonical_skill(s)))
    return F.struct(
        F.filter(job, lambda s: F.array_contains(mine, F.upper(s))).alias("matched"),
        F.filter(job, lambda s: ~F.array_contains(mine, F.upper(s))).alias("missing"))


def classify_role(title, description) -> Column:
    """struct(score, category); the first rule that applies decides."""
    return bind(F.upper(F.coalesce(_c(description), F.lit(""))), lambda d: bind(
        F.upper(F.coalesce(_c(title), F.lit(""))), lambda t: _role_of(t, d)))


def _role_of(t: Column, d: Column) -> Column:
    supportive = _holds_any(d, rules.SUPPORT_ANCHORS) & d.rlike(bounded(any_of(rules.SUPPORT_TEXT))) & ~d.rlike(bounded(any_of(rules.ENGINEERING_TEXT)))

    def verdict(score, category: str) -> Column:
        return F.struct(
            (score if isinstance(score, Column) else F.lit(score)).cast("int").alias("score"),
            F.lit(category).alias("category"))

    def unless_support(score, category: str) -> Column:
        return F.when(supportive, verdict(45, "support")).otherwise(verdict(score, category))

    non_tech = t.rlike(bounded(any_of(rules.NON_TECH_TITLES))) & ~t.rlike(bounded(any_of(rules.DEV_TITLES)))
    core = has_any(t, rules.CORE_TITLES) | strip(t).isin(rules.CORE_EXACT_TITLES)
    core_score = F.when(has_any(t, rules.ENTRY_TITLES), F.lit(95)).otherwise(F.lit(90))
    return (
        F.when(has_any(t, rules.COURSE_TITLES), verdict(15, "non_technical"))
        .when(has_any(t, rules.SUPPORT_TITLES), verdict(45, "support"))
        .when(has_any(t, rules.DOCUMENTATION_TITLES), verdict(15, "non_technical"))
        .when(non_tech, verdict(15, "non_technical"))
        .when(has_any(t, rules.HARD_ENGINEERING_TITLES) & ~has_any(t, rules.SOFTWARE_HINTS),
              verdict(20, "non_software_engineering"))
        .when(has_any(t, rules.AI_TITLES), unless_support(90, "ai_ml"))
        .when(core, unless_support(core_score, "core_software"))
        .when(has_any(t, rules.QA_TITLES), unless_support(45, "testing_qa"))
        .when(has_any(t, rules.ADJACENT_TITLES), unless_support(70, "adjacent_engineering"))
        .when(has_any(t, rules.GENERAL_TECH_TITLES), unless_support(60, "general_tech"))
        .otherwise(verdict(40, "unknown")))


def seniority(title, description) -> Column:
    """struct(executive, senior, entry) on text whose separators are blanks."""
    return bind(F.upper(F.coalesce(_c(description), F.lit(""))), lambda d: bind(
        F.upper(F.coalesce(_c(title), F.lit(""))), lambda t: _seniority_of(t, d)))


def _seniority_of(t: Column, d: Column) -> Column:
    """Anything but letters, digits and plus signs parts the words; titles are rewritten so, long texts are matched as they are."""
    part, start, end = r"[^A-Z0-9+]", r"(?<![A-Z0-9])", r"(?![A-Z0-9])"
    several = any_of([*rules.EXECUTIVE_YEARS, *rules.SENIOR_YEARS])
    asked = rf"{start}(?:REQUIRES?{part}+(?:AT{part}+LEAST{part}+)?|(?=[0-9]+\+))({several})\+?{part}*YEARS{end}"

    def titled(nt: Column, words: list[str]) -> Column:
        return nt.rlike(bounded("|".join(w.replace(" ", r"\s+") for w in words)))

    def verdict(nt: Column, years: Column) -> Column:
        def over(limits: list[str]) -> Column:
            return F.arrays_overlap(years, F.array(*[F.lit(y) for y in limits]))

        executive = titled(nt, rules.EXECUTIVE_TITLES) | over(rules.EXECUTIVE_YEARS)
        senior = executive | titled(nt, rules.SENIOR_TITLES) | over(rules.SENIOR_YEARS)
        both = F.concat(t, F.lit(" "), d)
        entry = t.contains("INTERN") | (_holds_any(both, rules.ENTRY_ANCHORS) & both.rlike(bounded("|".join(rules.ENTRY_TEXT))))
        return F.struct(executive.alias("executive"), senior.alias("senior"), entry.alias("entry"))

    none = F.array().cast("array<string>")
    return bind(F.regexp_replace(t, r"[^A-Z0-9\+]", " "), lambda nt: bind(
        F.when(d.contains("YEARS"), F.regexp_extract_all(d, F.lit(asked), 1)).otherwise(none), lambda years: verdict(nt, years)))


def numbered_level(title) -> Column:
    """F8: title carries a level of two or more."""
    titles = "|".join(t.replace(" ", r"\s+") for t in rules.LEVELED_TITLES)
    body = rf"(?:{titles})\s*[-‐–—]?\s*(?:level\s*)?(?:{'|'.join(rules.LEVEL_MARKS)})"
    return F.lower(F.coalesce(_c(title), F.lit(""))).rlike(bounded(body))


def role_pattern(term: str) -> tuple[str, str | None]:
    """(pattern that must occur, pattern that must not) for one role term."""
    edge_open, edge_close = r"(?:^|[\s,/()\[\]\-])", r"(?:$|[\s,/()\[\]\-])"
    if term == "c":
        return edge_open + "c" + edge_close, r"c\+\+|c#"
    if term in rules.SYMBOL_ROLES:
        return edge_open + re.escape(term) + edge_close, None
    if term == "r":
        return edge_open + "r" + edge_close, "r&d"
    # here a dash does not end a role; a literal backspace does, as blanks do
    return r"(?:^|[\s,/()\[\]\x08])" + re.escape(term) + r"(?:$|[\s,/()\[\]\x08])", None


def matches_role(title, term: str) -> Column:
    """F5 for one term."""
    t = strip(F.lower(F.coalesce(_c(title), F.lit(""))))
    r = term.strip().lower()
    if not r:
        return F.lit(False)
    need, veto = role_pattern(r)
    hit = t.rlike(f"(?U){need}")
    if veto:
        hit = hit & ~t.rlike(veto)
    return (t == r) | ((t != "") & hit)


def matches_location(location, description, term: str) -> Column:
    """F6 for one term; 'remote' looks at the description only when no location is given."""
    loc = F.lower(F.coalesce(_c(location), F.lit("")))
    want = term.strip().lower()
    if not want:
        return F.lit(True)
    if want == "remote":
        named = has_any(loc, ["remote", "work from home", "wfh"])
        return named | ((strip(loc) == "")
                        & F.lower(F.coalesce(_c(description), F.lit(""))).rlike(bounded("remote")))
    return loc.rlike(bounded(any_of(rules.LOCATION_SYNONYMS.get(want, [want]))))
