"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest
from conftest import SMALL

from pricelens import plans, registry  # noqa: F401
from pricelens.tables import Tables


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype == float:
            frame[c] = frame[c].round(6)
        frame[c] = frame[c].astype(str).replace({"nan": "None", "NaT": "None", "<NA>": "None"})
    return sorted(map(tuple, frame.itertuples(index=False)))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got = registry.QUERIES[name](Tables(spark, SMALL)).toPandas()
    wanted = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)
