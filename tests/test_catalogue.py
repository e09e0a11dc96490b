"""Every query of the catalogue that has SQL, against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from trailweave.plans import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    plain = lambda v: None if pd.isna(v) else (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v)
    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).values.tolist()), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, db, name):
    assert rows(catalogue.queries()[name](spark, SMALL).toPandas()) == rows(db.sql(catalogue.oracle_sql()[name]).df())


def test_names():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
