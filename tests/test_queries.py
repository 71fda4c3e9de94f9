"""Every registered query against its SQL on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from weftline.plans.oracles import SLOW
from weftline.plans.registry import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL) | set(SLOW) and not set(SQL) & set(SLOW)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, FOLDER)
    found = con.execute((SQL | SLOW)[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    key = lambda r: [(x is None, str(x)) for x in r]
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=key)
    assert sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=key) == want
