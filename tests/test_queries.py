"""Each query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from ligamap.plans.oracles import oracle_sql
from ligamap.plans.queries import queries

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("part", "lineitem", "events", "nation", "orders")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        return f"{float(x):.5f}" if not isinstance(x, str | bool | np.bool_) and hasattr(x, "__float__") else str(x)

    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(plain(x) for x in row) for row in ordered.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    wanted = db.sql(oracle_sql()[name]).df()
    got = queries()[name](spark, SF_DIR).toPandas()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_query_without_sql(spark, name):
    assert queries()[name](spark, SF_DIR).count() > 0
