"""Every engine query with SQL agrees with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import SparkSession

from krylith.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    db = duckdb.connect()
    for name in os.listdir(DATA):
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return db


def rows(columns, data):
    """Columns by name; rows in order, numbers as floats and all else as text."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: v if v is None or isinstance(v, float) else float(v) if isinstance(v, int) and not isinstance(v, bool) or hasattr(v, "as_tuple") else str(v)
    key = lambda r: tuple((v is None, isinstance(v, str), v if v is not None and v == v else 0) for v in r)
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in data), key=key)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    frame = catalog.queries()[name](spark, DATA)
    found = duck.execute(catalog.oracle_sql()[name])
    want_columns, want = rows([c[0] for c in found.description], found.fetchall())
    columns, got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    assert columns == want_columns
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(p == q or math.isclose(p, q, rel_tol=1e-7, abs_tol=2e-4) or p != p and q != q for p, q in zip(a, b))
