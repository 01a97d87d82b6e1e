"""Every registered query of the core against its SQL on the smallest tables."""

import math
import os
from pathlib import Path

import pytest

from pagewright.plans import queries

ROOT = os.environ.get("PAGEWRIGHT_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(ROOT).is_dir(), reason="no test data")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "-"
    if isinstance(value, float):
        return f"{value:.5f}"
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and not isinstance(value, str) and getattr(value, "ndim", 0):
        return str([plain(v) for v in value])
    return str(value)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(ROOT).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, ROOT)
    want = duck.execute(queries.ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    mine = sorted(tuple(plain(v) for v in r) for r in got.select(*columns).collect())
    assert mine == sorted(tuple(plain(v) for v in r) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, ROOT).count() > 0
