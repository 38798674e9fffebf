"""Every query of the catalog against its SQL, run by DuckDB on the same files."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

from srcquarry.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
    assert got == want


def test_fuzzy_candidates(spark, sf):
    rows = catalog.queries()["fuzzy_candidates"](spark, sf).collect()
    assert {r.p_name: r.close[0] for r in rows if r.p_name == "small bolt"} in ({"small bolt": "small bolt"}, {})
    assert all(len(r.close) <= 3 for r in rows)
