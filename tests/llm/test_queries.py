"""Queries against their SQL twins."""

import os
from collections import Counter

import pytest

from lodestone.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"create view {table} as select * from read_parquet('{DIR}/{table}.parquet')")
    want = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries.queries()[name](spark, DIR)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r) for r in got.select(*columns).collect()) == Counter(want.fetchall())
