"""Every registered graph query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from weftgraph.plans import catalog
from weftgraph.plans.projection import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in (*TABLES, "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df):
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or v != v:
            return None
        return str(v) if isinstance(v, (str, bool)) or str(v) in ("True", "False") else round(float(v), 6)

    return list(df.columns), sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(catalog.ORACLES[name]).df())
