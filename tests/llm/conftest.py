from __future__ import annotations

import duckdb
import pytest

SF01 = "/root/testdata/sf0.01"
SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
