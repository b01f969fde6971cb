"""Every query against its SQL."""

import os

import duckdb
import pytest

from skipweave.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{sf_dir}/{file}'")
    return con


def rows(df):
    columns = sorted(df.columns)
    cells = df[columns].astype(object).where(df[columns].notna(), None).values.tolist()
    return columns, sorted((tuple(round(x, 9) if isinstance(x, float) and abs(x) < 1e12 else x for x in r) for r in cells), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, tables, name):
    assert rows(QUERIES[name](spark, sf_dir).toPandas()) == rows(tables.sql(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
