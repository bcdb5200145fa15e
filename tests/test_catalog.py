"""Each query of the engine against its SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from sensorloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def oracle(small):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return connection


def normal(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    rows = df[columns].astype(object).where(df[columns].notna(), None)
    return sorted((tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, oracle, name):
    found = QUERIES[name](spark, small).toPandas()
    if name in SQL:
        expected = oracle.sql(SQL[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert normal(found) == normal(expected)
    else:
        assert len(found.columns) > 1


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
