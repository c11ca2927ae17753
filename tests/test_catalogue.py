"""Every registered query against its SQL on the smallest driver tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.catalogue_store import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    return con


def plain(rows, order):
    value = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, tiny, duck):
    out = QUERIES[name](spark, tiny)
    got = out.collect()
    if name not in ORACLE_SQL:
        assert got
        return
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(out.columns) == sorted(want.columns)
    order = lambda cols: sorted(range(len(cols)), key=lambda i: cols[i])
    assert plain(got, order(out.columns)) == plain(want.fetchall(), order(want.columns))


def test_entry(spark, tiny):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql())
