"""Every query with SQL gives the same rows as that SQL, on the smallest tables."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from rostrum.plans.catalog import ORACLES, QUERIES
from rostrum.sources.tables import BASE

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    if isinstance(v, int | np.integer):
        return int(v)
    if isinstance(v, float | np.floating) or type(v).__name__ == "Decimal":
        return None if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) > 170


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    res = duck.execute(ORACLES[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    want = sorted(str([plain(r[names.index(c)]) for c in columns]) for r in res.fetchall())
    assert got == want
