"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from geolith import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    """A value as text; numbers that are not whole stay numbers."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return value if isinstance(value, float) and not math.isinf(value) else str(value)


def rows_of(columns, rows):
    """Rows in an order that the last digits of numbers do not change."""
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    found = [tuple(plain(r[i]) for i in at) for r in rows]
    return sorted(found, key=lambda r: ([x for x in r if isinstance(x, str)], [round(x, 3) for x in r if isinstance(x, float)]))


def same(a, b):
    """Equal texts, and numbers equal but for one in the sixth decimal, where two engines round a half differently."""
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.01e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, db, sf_dir, name):
    found = registry.QUERIES[name](spark, sf_dir)
    expected = db.sql(registry.ORACLES[name])
    assert sorted(found.columns) == sorted(expected.columns)
    left, right = rows_of(found.columns, found.collect()), rows_of(expected.columns, expected.fetchall())
    assert len(left) == len(right)
    unequal = [(x, y) for x, y in zip(left, right, strict=True) if not all(map(same, x, y))]
    assert not unequal, unequal[:3]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
