"""Every registered query of the engine gives the rows of its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from frostline import catalogue

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(frame: pd.DataFrame) -> list[tuple]:
    def one(x: object) -> object:
        if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and math.isnan(x):
            return ""
        if isinstance(x, bool) or not hasattr(x, "__float__"):
            return str(x)
        return str(round(float(x), 6))

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(one, r)) for r in frame.itertuples(index=False))


def test_each_query_has_sql() -> None:
    assert set(catalogue.oracle_sql()) == set(catalogue.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name: str, spark, duck) -> None:  # noqa: ANN001
    ours = catalogue.queries()[name](spark, str(DATA)).toPandas()
    theirs = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert shown(ours) == shown(theirs)
