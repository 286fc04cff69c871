import os

import duckdb
import pandas as pd
import pytest

from lodestone import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(frame, cols):
    return sorted((tuple(None if pd.isna(v) else v for v in r) for r in frame[cols].astype(object).values.tolist()), key=repr)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, DIR).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    a, b = rows(got, cols), rows(want, cols)
    assert a == b or [tuple(map(str, r)) for r in a] == [tuple(map(str, r)) for r in b]


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
