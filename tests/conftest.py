from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from patronage.schemas import SCHEMAS, Tables, empty_table  # noqa: E402
from patronage.session import local_session  # noqa: E402
from patronage.sources.files import cast_to  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", 8, shuffle_partitions=4, memory="8g")
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture
def many_runs(spark):
    """Small shuffles keep all their partitions, so that sorted runs are more than one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="session")
def make(spark):
    """Domain tables from lists of dicts; a table not named is empty."""

    def table(name: str, rows: list[dict]):
        if not rows:
            return empty_table(spark, name)
        names = list(dict.fromkeys(key for row in rows for key in row))
        fields = dict(field.split() for field in SCHEMAS[name].replace("\n", " ").split(","))
        schema = ", ".join(f"{column} {fields[column]}" for column in names)
        return cast_to(spark.createDataFrame([tuple(row.get(column) for column in names) for row in rows], schema),
                       name)

    def tables(**named: list[dict]) -> Tables:
        return Tables(*[table(name, named.get(name, [])) for name in Tables._fields])

    return tables


def customer(number: int, **other) -> dict:
    return {"customer_id": number, "name": f"C{number}", "age": 30, "gender": "Female", "state": "Here",
            "signup_date": dt.date(2020, 1, 1), "is_active": True, **other}


def sale(number: int, customer_id: int, amount: float, when: dt.datetime, **other) -> dict:
    return {"transaction_id": number, "customer_id": customer_id, "product_id": 1, "quantity": 1,
            "order_amount": amount, "cost_amount": 0.0, "discount_amount": 0.0, "order_date": when,
            "status": "completed", **other}


def by_key(df, key: str) -> dict:
    return {row[key]: row for row in df.collect()}
