"""Every registered query of the role domain against its SQL in DuckDB, on the smallest data."""

import math

import duckdb
import pytest

from talentweave import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SIZED = {"inventory_counts": {"supplier": 100, "part": 2001}}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return "" if value is None else str(int(value)) if isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    found = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(norm(r[names.index(c)]) for c in df.columns) for r in found.fetchall())
    got = sorted(tuple(map(norm, r)) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
