"""Every query with an SQL twin, on whole tables, against DuckDB."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
         "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def text(row) -> str:
    return repr([f"{value:.6e}" if isinstance(value, float) else str(value) for value in row])


def same(one, other) -> bool:
    if isinstance(one, float) and isinstance(other, float):
        return math.isclose(one, other, rel_tol=1e-12, abs_tol=1e-12)
    return one == other


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found = entry.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    listed = ", ".join(f'"{column}"' for column in columns)
    expected = duck.sql(f"SELECT {listed} FROM ({entry.oracle_sql()[name]})")
    kinds = dict(found.dtypes)
    assert [KINDS[kinds[column]] for column in columns] == [str(kind) for kind in expected.types]
    ours = sorted((tuple(row[column] for column in columns) for row in found.collect()), key=text)
    theirs = sorted(expected.fetchall(), key=text)
    assert len(ours) == len(theirs)
    for one, other in zip(ours, theirs, strict=True):
        assert all(map(same, one, other)), (one, other)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert {row.segment for row in entry.entry(spark).collect()} <= {"At-Risk", "Silver", "Gold", "Platinum"}
