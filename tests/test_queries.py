"""Every registered query of the engine against its DuckDB SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from lexspan import plans


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return float(value) if type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_its_oracle(spark, duck, sf_dir, name):
    df = plans.QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    assert name in plans.ORACLES, "a query without SQL needs a test of its own"
    found = duck.execute(plans.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    at = [columns.index(c) for c in df.columns]
    want = [tuple(r[i] for i in at) for r in found.fetchall()]
    key = lambda r: tuple((v is None, str(plain(v))) for v in r)
    assert sorted((tuple(map(plain, r)) for r in got), key=key) == sorted((tuple(map(plain, r)) for r in want), key=key)
