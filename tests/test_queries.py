"""Every core query runs over the smallest tables; those with SQL give the same rows as DuckDB."""

import os

import duckdb
import pytest

from presswork.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in os.listdir(DIR):
        c.execute(f"create view {t.removesuffix('.parquet')} as select * from '{DIR}/{t}'")
    return c


def rows(cols, data):
    order = sorted(range(len(cols)), key=cols.__getitem__)
    norm = lambda x: None if x is None or x != x else round(float(x), 9) if isinstance(x, float) else x
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DIR)
    data = [tuple(r) for r in got.collect()]
    if name in registry.SQL:
        want = duck.execute(registry.SQL[name])
        cols = [c[0] for c in want.description]
        assert sorted(cols) == sorted(got.columns)
        assert rows(got.columns, data) == rows(cols, want.fetchall())


def test_entry_without_the_subpackage_names_core_queries():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
