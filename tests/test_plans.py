import datetime as dt
import math
import os

import duckdb
import pytest

from lodestone import plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def same(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v.isoformat() if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_matches_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    want = duck.sql(plans.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    place = [want.columns.index(c) for c in order]
    key = lambda r: [(x is None, str(type(x)), x) for x in r]
    mine = sorted(([same(r[c]) for c in order] for r in got.collect()), key=key)
    theirs = sorted(([same(r[i]) for i in place] for r in want.fetchall()), key=key)
    assert mine == theirs
    assert got.count() or name in ("filter_eq_null", "filter_in_empty", "where_not_in_subquery_null", "where_not_in_subquery", "multi_column_equality")


def test_flagship(spark):
    assert plans.flagship(spark, SF).columns == ["c_mktsegment", "n", "revenue"]
