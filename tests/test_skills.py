"""Skills, seniority and years of experience against plain per-word tests."""

import random
import re

from hirelode import rules
from hirelode.functions import skills as S

NAMES = [s.upper() for s in rules.KNOWN_SKILLS]
SPICE = ["GOLANG", "GO DEVELOPER", "GODEVELOPER", "USING GO", "GO / PYTHON", "GO,JAVA", "GO HOME", "WRITTEN IN C", "C / C++", "C OR C++", "C,", "EMBEDDED  C", "CCODE",
         "C LANGUAGE", "VITAMIN C", "R, SQL", "R&D", "RSTUDIO", "R-STUDIO", "PROFICIENT IN R", "AI/ML", "AI MODEL", "GENERATIVE AI", "AI", "OPEN AI.", "AIRPORT", "CSS3", "CSS4",
         "HTML & CSS", "POSTGRES", "AWS EC2", "AMAZON WEB SERVICES", "GOOGLE CLOUD PLATFORM", "JS", "TS", "C#", "C++", "C++11", "C#.", "NODE.JS", "NODEXJS", "REST  API",
         "REST API", "JAVASCRIPTS", "JAVA", "ÉGO", "PYTHON3", "_SQL", "SQL_", "MACHINE LEARNING", "CI/CD", "SPRING BOOT", "RÉACT", "VUE"]


def plain_skills(text):
    t, out = text.upper(), set()
    for name in rules.KNOWN_SKILLS:
        if name not in rules.CONTEXT_SKILLS:
            tail = r"\b" if name[-1].isalnum() else r"(?:$|\s|\b)"
            if re.search(r"\b" + re.escape(name.upper()) + tail, t):
                out.add(name)
    for spelling, name in rules.SKILL_RESCUES.items():
        if re.search(rf"\b{spelling}\b", t):
            out.add(name)
    end, lead = r"(?:$|\s|\b)", r"(?:WRITTEN IN|EXPERIENCE IN|PROFICIENT IN"
    cases = {
        "Go": [r"GOLANG", r"GO\s*(?:DEVELOPER|ENGINEER|PROGRAMMING|LANGUAGE|BACKEND|STACK|CODE)", lead + r"|KNOWLEDGE OF|USING)\s+GO", r"GO\s*[/,]\s*(?:PYTHON|C\+\+|JAVA|RUST|DOCKER|KUBERNETES)"],
        "C": [r"C\s*(?:/\s*C\+\+|PROGRAMMING|PROGRAMMER|LANGUAGE|DEVELOPER|ENGINEER|CODE|DRIVER)", r"EMBEDDED\s+C", r"C\s+(?:OR|,)\s+C\+\+", lead + r"|KNOWLEDGE OF)\s+C"],
        "R": [r"R-?STUDIO", r"R\s*(?:PROGRAMMING|LANGUAGE|STUDIO|DEVELOPER|ANALYTICS)", lead + r")\s+R", r"R\s*[/,]\s*(?:PYTHON|SQL|SAS|STATA|PANDAS)"],
        "AI": [r"ARTIFICIAL INTELLIGENCE", r"GENAI", r"GENERATIVE AI", r"AI/ML", r"AI\s*(?:ENGINEER|DEVELOPER|MODEL|SYSTEM|PLATFORM|SOLUTION|APPLICATION|RESEARCH|TOOLS)"],
        "CSS": [r"CSS3?", "TAILWIND", "BOOTSTRAP"]}
    for name, ways in cases.items():
        if any(re.search(rf"\b(?:{w}){end}", t) for w in ways):
            out.add(name)
    return sorted(out)


def plain_seniority(title, text):
    t, d = title.upper(), text.upper()
    nt, nd = (re.sub(r"[^A-Z0-9+]", " ", x) for x in (t, d))
    asks = lambda years: any(re.search(rf"\b{y}\+\s*YEARS\b", nd) or re.search(rf"\bREQUIRES?\s+(?:AT\s+LEAST\s+)?{y}\+?\s*YEARS\b", nd) for y in years)
    executive = bool(re.search(r"\b(?:PRINCIPAL|STAFF|DIRECTOR|PARTNER|FELLOW|VP|VICE\s+PRESIDENT|CTO|CHIEF\s+(?:TECHNOLOGY|TECHNICAL|ARCHITECT|OFFICER))\b", nt)) or asks((10, 12, 15))
    senior = executive or bool(re.search(r"\b(?:SENIOR|SR|LEAD|ARCHITECT|MANAGER)\b", nt)) or asks((5, 6, 7, 8))
    entry = "INTERN" in t or bool(re.search(r"\b(?:INTERN|FRESHER|ENTRY\s*LEVEL|GRADUATE|0-1\s*YEAR|0-2\s*YEARS)\b", t + " " + d))
    return executive, senior, entry


def test_skills_equal_one_test_for_each_name(spark):
    rng = random.Random(12)
    pieces = NAMES + SPICE + ["developer", "and", "we use", "language"]
    texts = [rng.choice([" ", ", ", "; ", "/", ". ", "(", "-"]).join(rng.choice(pieces) for _ in range(rng.randrange(1, 7))) for _ in range(1500)] + SPICE + NAMES + ["", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.extract_skills("t").alias("s")).collect()
    for r in rows:
        assert r["s"] == plain_skills(texts[r["i"]] or ""), texts[r["i"]]


def test_seniority_equals_plain_patterns(spark):
    rng = random.Random(13)
    titles = ["Senior Engineer", "Sr. Dev", "Vice-President", "VP", "Chief  Architect", "chief of staff", "Leader", "Internal tools", "Engineer", "Lead/Manager", "CTO_"]
    parts = ["5+ years", "5 + years", "requires 7 years", "require at least 12+  years", "at least 8 years", "15+years", "115+ years", "10+ yearsold", "x10+ years", "3+5+ years", "6+-years",
             "fresher", "entry-level", "entry level", "0-1 year", "0-2 years", "graduate", "international", "we", "and", "requires_6_years", "é8+ years", "requires 5 10+ years"]
    cases = [(rng.choice(titles), rng.choice([" ", ", ", "-"]).join(rng.choice(parts) for _ in range(rng.randrange(4)))) for _ in range(1200)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, d string").select("i", S.seniority("t", "d").alias("s")).collect()
    for r in rows:
        assert tuple(r["s"]) == plain_seniority(*cases[r["i"]]), cases[r["i"]]
    empty = spark.range(1).select(S.seniority(S.F.lit(None).cast("string"), S.F.lit(None).cast("string")).alias("s")).first()["s"]
    assert tuple(empty) == (False, False, False)
