"""Every registered query against its SQL text on the smallest data set."""

from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    res = duck.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in res.fetchall()), key=repr)
    assert cols == sorted(names)
    assert got == want


def test_entry(spark):
    row = entry.entry(spark).collect()
    assert len(row) == 1 and row[0]["alerts_total"] == 1000
