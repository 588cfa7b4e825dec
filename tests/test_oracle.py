"""Every query with a SQL twin gives the same rows in both engines."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from geodemand.plans import QUERIES, SQL

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return ""
        if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
            return str(bool(v))
        if isinstance(v, (int, float)) or "int" in type(v).__name__ or "float" in type(v).__name__:
            return repr(float(v) + 0.0)
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, duck, sf):
    mine = QUERIES[name](spark, sf).toPandas()
    theirs = duck.execute(SQL[name]).fetchdf()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert canonical(mine) == canonical(theirs)


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)
