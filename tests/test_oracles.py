"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from parcelwise.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def told(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        return repr(round(float(value), 5) + 0.0) if math.isfinite(float(value)) else str(value)
    return str(value)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, DATA)
    theirs = duck.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a = sorted(tuple(told(v) for v in r) for r in ours.select(columns).collect())
    b = sorted(tuple(told(v) for v in r) for r in duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM theirs").fetchall())
    assert a == b
    assert a or name == "empty_tiles_anti"  # no tile is empty at this scale


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0
