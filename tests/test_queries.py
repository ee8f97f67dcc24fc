"""Every query with SQL gives the same rows as DuckDB."""

import glob
from pathlib import Path

import duckdb
import pytest

from foliograph.plans import catalog, queries  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLES:
        assert got.count() > 0
        return
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {Path(p).stem} as select * from read_parquet('{p}')")
    want = c.sql(catalog.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda it, names: sorted(str(tuple(dict(zip(names, r))[c] for c in cols)) for r in it)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)
