"""Every query that has SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from pelagia.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(registry.ORACLE_SQL[name])
    expected = rows_of([d[0] for d in result.description], result.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in result.description)
    assert found == expected
    assert found, "an empty result shows nothing"


def test_entry_and_registry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
