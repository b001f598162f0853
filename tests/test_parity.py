"""Every query that SQL can express gives DuckDB's rows on the smallest tables."""

import math

import duckdb
import pytest

from reelmill.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, list):
        return [plain(v) for v in value]
    return str(value)


def rows(table, columns):
    return sorted([plain(r[c]) for c in columns] for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_parity(spark, small, con, name):
    got = registry.queries()[name](spark, small).toArrow()
    want = con.sql(registry.oracle_sql()[name]).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    assert sorted(got.column_names) == sorted(want.column_names)
    columns = sorted(got.column_names)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0
