"""The feed, its funnel and the search cycle against their SQL where postings of different ids are near duplicates."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from hirelode.adapters import BASE

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def reposted(tmp_path_factory):
    """Every order a second time 25,200 keys on: same company, title and place, a requisition where the first has none."""
    folder = tmp_path_factory.mktemp("reposted")
    for name in BASE:
        if name != "orders":
            (folder / f"{name}.parquet").symlink_to(Path(FOLDER) / f"{name}.parquet")
    duckdb.execute(f"""COPY (SELECT * FROM '{FOLDER}/orders.parquet'
        UNION ALL SELECT * REPLACE (o_orderkey + 25200 AS o_orderkey) FROM '{FOLDER}/orders.parquet') TO '{folder}/orders.parquet'""")
    return str(folder)


@pytest.mark.parametrize("name", ["q1_build_feed", "a1_funnel", "q2_search_cycle"])
def test_near_duplicates_merge_as_in_sql(spark, reposted, name):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{reposted}/{t}.parquet'")
    df = entry.queries()[name](spark, reposted)
    cur = con.execute(entry.oracle_sql()[name])
    theirs = [d[0] for d in cur.description]
    a = sorted((tuple(plain(r[c]) for c in df.columns) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(r[theirs.index(c)]) for c in df.columns) for r in cur.fetchall()), key=repr)
    assert a == b and a


def test_ratio_of_sql_is_the_query_s(spark):
    from difflib import SequenceMatcher

    from hirelode.catalog.joining import LONGEST
    pairs = [("software engineer", "software enginer"), ("abcab", "cabab"), ("qa tester", "qa automation tester"), ("noida", "india"), ("xyz", "abc")]
    for a, b in pairs + [(b, a) for a, b in pairs]:
        got = duckdb.execute(f"""WITH RECURSIVE r AS (SELECT ? AS x, ? AS y UNION ALL SELECT p.x, p.y FROM (SELECT unnest([
            struct_pack(x := substr(x, 1, -m.i - 1), y := substr(y, 1, strpos(y, substr(x, -m.i, m.n)) - 1)),
            struct_pack(x := substr(x, m.n - m.i), y := substr(y, strpos(y, substr(x, -m.i, m.n)) + m.n))]) AS p
            FROM (SELECT *, {LONGEST} AS m FROM r) WHERE m.n > 0) WHERE p.x <> '' AND p.y <> '')
            SELECT 2 * CAST(sum(({LONGEST}).n) AS DOUBLE) / {len(a) + len(b)} FROM r""", [a, b]).fetchone()[0]
        assert got == SequenceMatcher(None, a, b).ratio()
