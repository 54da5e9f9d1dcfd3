"""Every query that has SQL against it, on the tables the driver uses."""

import os

import duckdb
import pytest

from brindle.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return str(v) if v != v or v in (float("inf"), float("-inf")) else round(v, 5) + 0.0
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{path}{'' if os.path.isfile(path) else '/*.parquet'}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    want = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    expected = want.fetchall()
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    got = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    assert got == sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in expected)
    assert expected


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_kernel_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
