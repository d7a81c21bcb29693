"""Every query of the engine against its SQL in DuckDB."""

import duckdb
import pytest

from foliomill.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _cell(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(_cell(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    place = [rel.columns.index(c) for c in columns]
    theirs = sorted((tuple(_cell(r[i]) for i in place) for r in rel.fetchall()), key=repr)
    assert mine == theirs


def test_dealer_match(spark):
    rows = catalog.QUERIES["dealer_match"](spark, SF).collect()
    assert rows and all((r["score"] or 0) >= 90 or r["name"] is None for r in rows)
    assert any(r["score"] == 100 for r in rows)
