"""Every registered query of the engine against its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import pytest

from registrum.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def plain(value):
    return round(float(value), 6) if isinstance(value, float) or type(value).__name__ == "Decimal" else value


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, tables, name):
    df = catalogue.queries()[name](spark, FOLDER)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)
    if name in catalogue.oracle_sql():
        found = tables.sql(catalogue.oracle_sql()[name])
        at = [found.columns.index(c) for c in sorted(df.columns)]
        assert sorted(found.columns) == sorted(df.columns)
        assert got == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
