"""Every registered query against its SQL oracle in DuckDB on the smallest tables; the others must run."""

import os
from collections import Counter

import duckdb
import pytest

from tidespan import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in catalog.ORACLES:
        return
    quoted = ", ".join(f'"{c}"' for c in cols)
    want = Counter(tuple(map(plain, r)) for r in duck.sql(f"select {quoted} from ({catalog.ORACLES[name]}) q").fetchall())
    assert got == want


def test_oracles_have_queries():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
