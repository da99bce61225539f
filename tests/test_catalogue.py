"""Every registered query of the reference's operators against its SQL."""

import duckdb
import pytest

from quorix.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(map(repr, plain.values.tolist()))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, tables, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(tables.execute(catalogue.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
