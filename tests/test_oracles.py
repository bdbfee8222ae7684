"""Every query with SQL gives the same rows as DuckDB over the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from understory.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(df: pd.DataFrame) -> list[str]:
    def text(v):
        return "null" if v is None or (not isinstance(v, (list, dict)) and pd.isna(v)) else format(v, ".9g") if isinstance(v, float) else str(v)

    return sorted("|".join(map(text, t)) for t in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_same_rows_as_sql(spark, duck, name):
    got = catalog.queries()[name](spark, FOLDER).toPandas()
    want = duck.execute(catalog.oracles()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
