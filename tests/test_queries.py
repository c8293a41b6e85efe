"""Every named query against its SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import TABLES, compare  # noqa: E402
from tonegrid import plans  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = list(plans.queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="given tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = plans.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    sql = plans.oracle_sql().get(name)
    if sql:
        cur = con.execute(sql)
        assert compare(rows, df.columns, cur.fetchall(), [c[0] for c in cur.description]) is None
