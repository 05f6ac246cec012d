"""Every registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from millrace.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "events documents labels pages benchmark conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return "NULL"
        return v if isinstance(v, str) else repr(round(float(v), 6))

    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(catalog.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
