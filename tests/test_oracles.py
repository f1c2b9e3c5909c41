"""Every registered query of the engine against its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pytest

from echograin.plans.queries import ORACLES, QUERIES

SF = os.environ.get("ECHOGRAIN_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def norm(df):
    df = df[sorted(df.columns)]
    plain = lambda v: round(float(v), 6) if isinstance(v, (float, np.floating)) else int(v) if isinstance(v, (bool, np.bool_, np.integer)) else str(v)
    return sorted(tuple(map(plain, row)) for row in df.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert norm(got) == norm(want)
