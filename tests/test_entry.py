"""Every query with SQL gives the SQL's rows at the smallest scale."""

from __future__ import annotations

import os

import pytest

from loomspan.plans import registry

registry.load()
ROOT = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(df):
    cols = sorted(df.columns)
    clean = lambda v: None if v is None or v != v else f"{float(v):.6f}" if isinstance(v, float) or type(v).__name__.startswith("float") else str(v)
    return sorted((tuple(clean(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{ROOT}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, ROOT)
    if name not in registry.ORACLES:
        assert got.count() > 0
        return
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    frame = got.toPandas()
    as_int = lambda df: df.apply(lambda c: c.astype("float") if c.dtype.kind in "iuf" else c)
    assert _rows(as_int(frame)) == _rows(as_int(want))
