"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

from tenfold.plans import collecting, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v:.6f}"
    return "null" if v is None else f"{v:.6f}" if isinstance(v, int) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(set(oracle.SQL) - {"predict_one", "predict_scored"}))
def test_same_rows(spark, con, name):
    got = collecting.Q[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({oracle.SQL[name]})").fetchall()
    assert sorted(tuple(map(shown, r)) for r in got.select(*cols).collect()) == sorted(tuple(map(shown, r)) for r in want)
