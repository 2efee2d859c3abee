"""Every registered query against its SQL on DuckDB, whole tables at sf0.01."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
from conftest import TESTDATA
from queries import oracle, spark as operators

SF = TESTDATA / "sf0.01"
QUERIES = operators.queries()
ORACLE = oracle.oracle_sql()

pytestmark = pytest.mark.skipif(not SF.is_dir(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in SF.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def cell(value):
    if isinstance(value, float):
        return value if not math.isnan(value) else "NaN"
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, str(SF))
    cursor = duck.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(result.columns) == sorted(columns)
    expected = [dict(zip(columns, row)) for row in cursor.fetchall()]
    order = sorted(columns)
    got = Counter(tuple(cell(row[c]) for c in order) for row in result.collect())
    want = Counter(tuple(cell(row[c]) for c in order) for row in expected)
    assert sum(want.values()) > 0
    assert got == want, (list((got - want).items())[:5], list((want - got).items())[:5])


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
