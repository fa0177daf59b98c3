"""Every registered query with SQL, against DuckDB on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check import TABLES, rows_of  # noqa: E402

from crowdgap.plans import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


# sets of a fixed size per family need more rows than the smallest tables have
TOO_SMALL = {"disjoint_sets"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - TOO_SMALL))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
