"""Every registered query against its SQL counterpart on the small tables."""

import math
from collections import Counter

import duckdb
import pytest

from declara.plans import oracle_more
from declara.plans.bridges import TABLES
from declara.plans.queries import QUERIES

ORACLE = oracle_more.ORACLE


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return "NULL" if value is None else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, data, duck, name):
    cur = duck.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    df = QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert got == Counter(tuple(map(plain, r)) for r in want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_and_contract(spark, data):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(5).count() == 5
