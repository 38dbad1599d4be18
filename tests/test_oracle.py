"""Every registered query with SQL equals DuckDB on the smallest tables."""

import duckdb
import pytest

from stratafuse import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def compare(spark, duck, query, sql):
    got, want = query(spark, SF).toPandas(), duck.sql(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    for c in cols:
        assert ((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all(), c


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query(spark, duck, name):
    compare(spark, duck, core.QUERIES[name], core.SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 3470
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
