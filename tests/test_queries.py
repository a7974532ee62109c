"""Every registered relational query against DuckDB on the smallest tables."""

import datetime
import math
from decimal import Decimal

import duckdb
import pytest

from kinweave import registry

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (float, Decimal)):
        return round(float(x), 6)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.ORACLE_SQL:
        assert got[1]
        return
    rel = duck.sql(registry.ORACLE_SQL[name])
    assert got == rows(rel.columns, rel.fetchall())


def test_capped_pairs_are_the_first_of_all_pairs(spark, duck):
    """No pair twice, and those that all pairs' hashes put first, made one by one here."""
    import hashlib

    got = {}
    for r in registry.QUERIES["pairs_capped"](spark, SF).collect():
        got.setdefault(r.l_orderkey, []).append((r.rn_a, r.rn_b, r.weight))
    want = {}
    for key, n in duck.sql("select l_orderkey, least(count(*), 7) from lineitem group by 1 having count(*) > 1").fetchall():
        every = [(a, b) for b in range(2, n + 1) for a in range(1, b)]
        first = sorted(every, key=lambda p, key=key: (int(hashlib.md5(f"{key}-{p[0]}-{p[1]}".encode()).hexdigest()[:8], 16), p))[:5]
        want[key] = sorted((a, b, round(n / len(first), 6)) for a, b in first)
    assert {k: sorted(v) for k, v in got.items()} == want
