"""Every registered query against its SQL in DuckDB at the smallest scale."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from kinolake.plans import all_oracles, all_queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float | decimal.Decimal):
        return f"{float(v):.8g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_query_equals_its_sql(spark, duck, name):
    df = all_queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted("|".join(plain(r[c]) for c in names) for r in df.collect())
    rel = duck.sql(all_oracles()[name])
    columns, rows = list(rel.columns), rel.fetchall()
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    assert got == sorted("|".join(plain(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_oracles())))
def test_other_queries_give_rows(spark, name):
    assert all_queries()[name](spark, DATA).count() > 0
