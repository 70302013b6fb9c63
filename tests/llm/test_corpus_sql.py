"""Corpus queries against their SQL counterparts."""

from collections import Counter

import duckdb
import pytest

from declara.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    want = Counter(cur.fetchall())
    df = QUERIES[name](spark, data)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == want
