"""Every query that has SQL against DuckDB, on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from sievework.plans import registry

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    ours = registry.QUERIES[name](spark, SF)
    theirs = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    assert sorted(tuple(map(plain, r)) for r in ours.select(*columns).collect()) == sorted(tuple(map(plain, r)) for r in theirs.fetchall())


def test_queries_without_sql_run(spark):
    for name in set(registry.QUERIES) - set(registry.ORACLE_SQL):
        assert registry.QUERIES[name](spark, SF).count() > 0
