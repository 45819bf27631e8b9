"""Every query against the same query in SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from read_parquet('{small}/{name}.parquet')")
    return con


def normalised(df):
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), key=lambda c: c.astype(str), kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, small, duck, name):
    ours = normalised(entry.queries()[name](spark, small).toPandas())
    assert len(ours) > 0
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    theirs = normalised(duck.execute(sql).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs)
    for column in ours.columns:
        a, b = ours[column], theirs[column]
        assert ((a == b) | (a.isna() & b.isna())).all(), column


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
