"""Every query with SQL against DuckDB on the small tables."""

import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from twintongue.operators import registry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
ORACLE = registry.oracle_sql()


def normal(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 3) + 0.0
    return str(v) if not isinstance(v, (int, str, bool)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    theirs = sorted(repr([normal(r[columns.index(c)]) for c in sorted(columns)]) for r in want.fetchall())
    ours = sorted(repr([normal(r[c]) for c in sorted(columns)]) for r in got.collect())
    assert ours == theirs


def test_every_query_has_sql():
    assert set(registry.queries()) == set(ORACLE)
