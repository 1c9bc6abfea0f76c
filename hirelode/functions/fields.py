"""Column functions over numbers, times, JSON, maps, money and requirements."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import _c, bind, blank_to_null, bounded, has_any, strip


# --- scores and money --------------------------------------------------------

def numeric_score(col, default: int = rules.DEFAULT_SCORE) -> Column:
    """Any text or number to a 0-100 integer; unreadable values get the default."""
    n = strip(_c(col).cast("string")).try_cast("double")
    n = F.when(n.isNull() | F.isnan(n), F.lit(float(default))).otherwise(n)
    cut = F.when(n >= 0, F.floor(n)).otherwise(F.ceil(n))     # toward zero
    return F.least(F.lit(100), F.greatest(F.lit(0), cut)).cast("int")


def parse_salary(col) -> Column:
    """struct(low, high) in INR from free text: amounts with L/LPA/k units.

    An amount without a unit takes the one of the other end of the range.
    """
    t = F.lower(F.coalesce(_c(col), F.lit("")))
    pair = r"(\d[\d,]*(?:\.\d+)?)(?:\s*(lpa|lakhs?|lacs?|l|k)\b)?"
    found, units = F.regexp_extract_all(t, F.lit(pair), 1), F.regexp_extract_all(t, F.lit(pair), 2)
    per_year = F.when(t.rlike(r"(?:\bper|\ba|/)\s*month\b|\bmonthly\b"), F.lit(12)).otherwise(F.lit(1))

    def amount(i: int) -> Column:
        own, other = (F.nullif(F.get(units, F.lit(k)), F.lit("")) for k in (i, 1 - i))
        unit = F.coalesce(own, other, F.lit(""))
        times = F.when(unit == "k", F.lit(1000)).when(unit != "", F.lit(100000)).otherwise(F.lit(1))
        raw = F.replace(F.get(found, F.lit(i)), F.lit(","), F.lit("")).try_cast("decimal(18,2)")
        return (raw * times * per_year).try_cast("decimal(18,2)")

    return F.struct(
        amount(0).alias("low"),
        F.coalesce(amount(1), amount(0)).alias("high"))


# --- times -------------------------------------------------------------------

def iso_ts(col) -> Column:
    """ISO text to timestamp; 'Z' and naive text are UTC; unreadable is null."""
    return F.try_to_timestamp(_c(col).cast("string"))


def parse_any_ts(col) -> Column:
    """ISO, slash-separated and RFC-822 style dates, all UTC."""
    t = strip(_c(col).cast("string"))
    rfc = F.regexp_extract(t, r"^[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) [A-Z]+$", 1)
    return F.coalesce(
        F.try_to_timestamp(t),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.try_to_timestamp(t, F.lit("yyyy-MM-dd")),
        F.try_to_timestamp(t, F.lit("dd/MM/yyyy")),
        F.try_to_timestamp(t, F.lit("yyyy/MM/dd")),
        F.try_to_timestamp(F.nullif(rfc, F.lit("")), F.lit("dd MMM yyyy HH:mm:ss")))


def seconds_between(a, b) -> Column:
    """b - a in seconds, with fractions."""
    return (F.unix_micros(_c(b).cast("timestamp")) - F.unix_micros(_c(a).cast("timestamp"))) / F.lit(1e6)


def hours_between(a, b) -> Column:
    return seconds_between(a, b) / F.lit(3600.0)


def days_between(a, b) -> Column:
    return seconds_between(a, b) / F.lit(86400.0)


def whole_days_between(a, b) -> Column:
    """Whole days, rounded down also for negative spans."""
    return F.floor(days_between(a, b))


def hour_bucket(ts) -> Column:
    """Label of the 3-hour bucket of a time."""
    start = F.floor(F.hour(_c(ts)) / 3) * 3
    return bucket_label(start)


def bucket_label(start: Column) -> Column:
    return F.concat(F.lpad(start.cast("string"), 2, "0"), F.lit(":00-"),
                    F.lpad((start + 3).cast("string"), 2, "0"), F.lit(":00"))


def month_key(ts) -> Column:
    """X11: 'YYYY-MM' of a time."""
    return F.date_format(_c(ts), "yyyy-MM")


def day_key(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd")


def quota_day(ts) -> Column:
    """Calendar day on the US-Pacific clock of a UTC instant."""
    return F.date_format(F.from_utc_timestamp(_c(ts), "America/Los_Angeles"), "yyyy-MM-dd")


def cycle_seed(ts) -> Column:
    """Number of the six-hour cycle an instant falls in."""
    return F.floor(F.unix_timestamp(_c(ts)) / 21600)


# --- JSON and maps -----------------------------------------------------------

def json_path(col, path: str) -> Column:
    """Value at a JSON path; missing steps and bad JSON give null."""
    return F.get_json_object(_c(col), path)


def map_merge(a, b) -> Column:
    """Union of two maps in which the second one wins."""
    ma, mb = _c(a), _c(b)
    return F.map_concat(F.map_filter(ma, lambda k, v: ~F.map_contains_key(mb, k)), mb)


def map_sum(a, b) -> Column:
    """Union of two maps of counts in which the counts of a key add up."""
    ma, mb = _c(a), _c(b)
    return F.map_zip_with(ma, mb, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


# --- requirements ------------------------------------------------------------

def _one_of(words: list[str]) -> str:
    return "(?:" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in words) + ")"


def _experience_patterns() -> list[str]:
    """Ways to ask for years of experience; group 1 is their number."""
    number, plus, units = r"([0-9]{1,2})", r"\s*\+?\s*", _one_of(rules.YEAR_UNITS)
    adjectives = rf"(?:{_one_of(rules.EXPERIENCE_ADJECTIVES)}\s+)*"
    return [
        rf"{number}\s*{_one_of(rules.RANGE_SIGNS)}\s*[0-9]{{1,2}}{plus}{units}", rf"{number}\s*\+\s*{units}",
        rf"{_one_of(rules.LEAST_WORDS)}\s+{number}\s*{units}", rf"{number}{plus}{units}(?:['’]s?)?\s*(?:of\s+)?{adjectives}experience",
        rf"experience\s*(?:required|needed)?\s*{_one_of(rules.EXPERIENCE_SIGNS)}\s*{number}{plus}{units}",
        rf"{_one_of(rules.DEMAND_WORDS)}\s+(?:of\s+)?{number}{plus}{units}"]


# most characters other than blanks that an experience pattern has before its number
WORDS_BEFORE = 32


def _far_from_numbers() -> str:
    """Stretches without a digit that no experience pattern can reach; group 1 is what one may need of them.

    A stretch begins behind a digit or at the start of the text.  What follows a number there (all of a
    pattern's rest, however many blanks and adjectives it has) stays, and so do the last characters
    before the next number, blanks not counted.
    """
    plus, units, signs = r"\s*+\+?\s*+", _one_of(rules.YEAR_UNITS), _one_of(rules.RANGE_SIGNS)
    adjectives = rf"(?:{_one_of(rules.EXPERIENCE_ADJECTIVES)}\s+)*"
    rest = rf"\s*+{signs}\s*+(?=[0-9])|{plus}{units}(?:['’]s?)?\s*(?:of\s+)?{adjectives}experience|{plus}{units}|"
    # case and Unicode only where they matter: the class of the long stretches is tested for every character
    return rf"(?<![^0-9])((?iU:(?>{rest})))(?:[^0-9]{{16,}}+(?![0-9])|[^0-9]{{16,}}(?=(?U:(?>\s*+[^0-9\s]){{{WORDS_BEFORE}}})))"


def min_experience_years(*texts) -> Column:
    """Smallest number of years the texts demand; null when none is stated.

    The patterns look only at what is near a number: most of a long text goes in one quick pass before.
    """
    text = F.concat_ws(" ", *[F.coalesce(_c(t), F.lit("")) for t in texts])
    near = F.regexp_replace(text, F.lit(_far_from_numbers()), F.lit("$1;"))

    def smallest(t: Column) -> Column:
        hits = F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(f"(?iU){p}"), 1) for p in _experience_patterns()]))
        return F.array_min(F.transform(hits, lambda h: h.cast("int")))

    return bind(near, lambda t: F.when(t.rlike(r"(?U)[0-9]\s*\+?\s*[yY]"), smallest(t)))


def max_user_years(terms) -> Column:
    """Highest number of years a candidate's target texts allow; null when open."""

    def limits(item: Column) -> Column:
        s = strip(F.lower(item))
        return F.flatten(F.array(
            F.when(s.contains("fresher") | s.contains("entry"), F.array(F.lit("0")))
            .otherwise(F.array().cast("array<string>")),
            F.regexp_extract_all(s, F.lit(r"(?U)\d{1,2}\s*(?:-|–|to)\s*(\d{1,2})"), 1),
            F.regexp_extract_all(s, F.lit(r"(?U)^(\d{1,2})\s*years?"), 1)))

    return F.array_max(F.transform(F.flatten(F.transform(_c(terms), limits)), lambda x: x.try_cast("int")))


def is_stub(description) -> Column:
    """Description too thin to judge."""
    d = F.coalesce(_c(description), F.lit(""))
    return (F.length(d) < rules.STUB_MIN_CHARS) | d.contains(rules.STUB_PHRASE)


# fixed values: words of entry-level and senior titles, and India hints
SENIOR_TITLE_WORDS = r"senior|sr\.?|lead|principal|staff|manager|director|head|vp|architect|chief"
FRESHER_TITLE_WORDS = (
    r"intern|internship|trainee|graduate|fresher|apprentice|campus|entry[\s\-]?level|"
    r"associate engineer|engineer\s*i\b|sde\s*[i1]\b|analyst\s*i\b|new\s?grad")
INDIA_HINTS = [
    "india", "bangalore", "bengaluru", "gurugram", "gurgaon", "delhi", "noida",
    "hyderabad", "pune", "mumbai", "chennai", "apac",
]
OPEN_LOCATION_HINTS = ["india", "worldwide", "anywhere", "global", "remote", "apac", "asia"]


def is_fresher_title(col) -> Column:
    """entry-level wording and no senior wording."""
    t = F.coalesce(_c(col), F.lit(""))
    return t.rlike(bounded(FRESHER_TITLE_WORDS, "iU")) & ~t.rlike(bounded(SENIOR_TITLE_WORDS, "iU"))


def is_india(col) -> Column:
    """location names India, an Indian hub or the country code."""
    loc = F.lower(F.coalesce(_c(col), F.lit("")))
    return has_any(loc, INDIA_HINTS) | strip(loc).endswith(" in")


def eligible_location(col) -> Column:
    """open to candidates in India; no location means open."""
    loc = F.lower(blank_to_null(col))
    return F.coalesce(has_any(loc, OPEN_LOCATION_HINTS), F.lit(True))
