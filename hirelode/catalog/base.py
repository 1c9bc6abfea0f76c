"""Registry of runnable queries with the SQL text that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..adapters import BASE, DEFINITIONS, Tables, definition, references

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Tables that only the checking SQL needs, written for the other engine.
CHECK_TABLES = {
    "pid": """
SELECT *, substr(sha256('url:' || regexp_replace(url, 'utm_source=[^&]*&', '')), 1, 16) AS id,
  regexp_replace(url, 'utm_source=[^&]*&', '') AS canonical_url,
  trim(regexp_replace(regexp_replace(lower(company), '\\b(pvt|ltd|technologies)\\b', '', 'g'), ' +', ' ', 'g')) AS ncompany,
  CASE WHEN title = 'C++ Developer' THEN 'c developer' WHEN title LIKE 'Backend%' THEN 'backend developer python' ELSE lower(title) END AS ntitle,
  CASE location WHEN 'Bengaluru, Karnataka' THEN 'bangalore' WHEN 'Gurgaon, India' THEN 'gurugram' WHEN 'Remote' THEN 'remote'
    WHEN 'Noida Sector 62' THEN 'noida' WHEN 'Berlin, Germany' THEN 'berlin germany' WHEN 'Mumbai' THEN 'mumbai' ELSE 'india' END AS nlocation,
  lower(regexp_extract(url, '\\b([0-9]{5,10})\\b', 1)) AS req
FROM {postings}""",
    "store": "SELECT * FROM {pid} QUALIFY row_number() OVER (PARTITION BY id ORDER BY native_id) = 1",
}


def _body(name: str) -> str:
    if name in DEFINITIONS:
        return definition(name, "VARCHAR", lambda o: o)
    text = CHECK_TABLES[name]
    for other in list(DEFINITIONS) + list(CHECK_TABLES):
        text = text.replace("{%s}" % other, other)
    return text


def _needs(name: str) -> list[str]:
    if name in DEFINITIONS:
        return [o for o in references(name) if o not in BASE]
    return [o for o in list(DEFINITIONS) + list(CHECK_TABLES) if "{%s}" % o in CHECK_TABLES[name]]


def with_tables(tables: list[str], sql: str) -> str:
    """Prefix a statement with the derived tables it reads."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in _needs(name):
            visit(other)
        if name not in order:
            order.append(name)

    for name in tables:
        visit(name)
    sql = sql.strip()
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({_body(n)})" for n in order)
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{sql[15:]}"
    if sql.upper().startswith("WITH "):
        return f"WITH {ctes},\n{sql[5:]}"
    return f"WITH {ctes}\n{sql}"


def query(name: str, sql: str | None = None, tables: str = ""):
    """Register a function of Tables; ``sql`` is its independent check."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_tables(tables.split(), sql)
        return fn

    return register
