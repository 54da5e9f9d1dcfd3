"""Compares a query with its SQL over the same tables."""

import os

import duckdb

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in rows)


def same(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'' if os.path.isfile(path) else '/*.parquet'}'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    df = entry.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, want.fetchall()), name
