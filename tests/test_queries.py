"""Every registered query of the engine against DuckDB on the smallest tables."""

import os

import pytest

from loomline.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    cols = sorted(df.columns)

    def cell(v):
        if v is None or v != v:
            return None
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return cols, sorted((tuple(map(cell, r)) for r in df[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = rows(catalog.QUERIES[name](spark, SF).toPandas()), rows(duck.execute(catalog.ORACLES[name]).df())
    assert got == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
