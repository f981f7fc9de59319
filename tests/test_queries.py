"""Every registered query against its SQL on an independent engine, over the smallest tables."""

import math
import os

import duckdb
import pytest

from metaspan.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        p = f"{SF}/{t}"
        c.execute(f"create view {t.split('.')[0]} as select * from '{p}/*.parquet'" if os.path.isdir(p) else f"create view {t.split('.')[0]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return repr([plain(x) for x in v])
    return repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert columns
        return
    out = duck.execute(ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall())
