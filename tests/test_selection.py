"""Values at ranks against sorted lists, also where values repeat, are extreme or missing."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from patronage.operators import selection
from patronage.operators.profiling import duplicate_rows, exact_quartiles, profile
from patronage.operators.selection import median, ranked_values

NAN, INF = float("nan"), float("inf")


def sorted_values(values: list) -> list[float]:
    known = [float(value) for value in values if value is not None]
    return sorted((value for value in known if not math.isnan(value))) + [v for v in known if math.isnan(v)]


def same(one: float, other: float) -> bool:
    return one == other or math.isnan(one) and math.isnan(other)


@pytest.fixture
def few_bins(monkeypatch):
    monkeypatch.setattr(selection, "BINS", 7)
    monkeypatch.setattr(selection, "FEW", 20)


def columns() -> dict[str, list]:
    draw = random.Random(4)
    n = 500
    return {
        "spread": [draw.gauss(0, 1e6) for _ in range(n)],
        "hot": [5.0 if i % 3 else draw.random() * 100 for i in range(n)],
        "wide": [draw.choice([-1, 1]) * 10.0 ** draw.randrange(-300, 308) for _ in range(n)],
        "odd": [draw.choice([None, NAN, INF, -INF, 0.0, -0.0, 1.5]) for _ in range(n)],
        "none": [None] * n,
        "one": [None] * (n - 1) + [7.25],
        "near": [1.0 + draw.randrange(3) * 2 ** -52 for _ in range(n)],
    }


@pytest.mark.parametrize(("bins", "few"), [(16, 0), (1024, 0), (16, 1_000)])
def test_every_rank(spark, monkeypatch, bins, few):
    """Magnitudes from 1e-300 to 1e307 are apart after a few rounds as well."""
    monkeypatch.setattr(selection, "BINS", bins)
    monkeypatch.setattr(selection, "FEW", few)
    rounds, real = [], selection._narrowed
    monkeypatch.setattr(selection, "_narrowed", lambda df, open_: (rounds.append(set(open_)), real(df, open_))[1])
    data = columns()
    df = spark.createDataFrame(list(zip(*data.values(), strict=True)), ", ".join(f"{name} double" for name in data)).repartition(5)
    asked = {0, 1, 17, 124, 125, 249, 250, 374, 375, 498, 499}
    found = ranked_values(df, list(data), lambda n: [rank for rank in asked if rank < n] + [-1, n])
    for name, values in data.items():
        expected = sorted_values(values)
        assert found[name].size == len(expected)
        assert set(found[name].values) == {rank for rank in asked if rank < len(expected)}
        assert all(same(value, expected[rank]) for rank, value in found[name].values.items()), name
    assert len(rounds) <= (2 if few else 12)
    assert ranked_values(df, [], lambda n: [0]) == {}


def test_whole_numbers_and_decimals(spark, few_bins):
    df = spark.range(1001).select((F.col("id") * 3).alias("a"), (F.col("id") / 8).cast("decimal(10,3)").alias("b"))
    found = ranked_values(df, ["a", "b"], lambda n: [n // 4])
    assert found["a"].values == {250: 750.0} and found["b"].values == {250: 31.25}
    assert median(df, "a") == 1500.0 and median(df.filter("id < 2"), "a") == 1.5 and median(df.limit(0), "a") is None


def test_rounds(spark, monkeypatch):
    """One round of histograms, then few values are fetched; a column of ten values is settled in the first round."""
    rounds, fetched = [], []
    real, fetch = selection._narrowed, selection._fetched
    monkeypatch.setattr(selection, "_narrowed", lambda df, open_: (rounds.append(set(open_)), real(df, open_))[1])
    monkeypatch.setattr(selection, "_fetched", lambda df, open_, result: (fetched.append(set(open_)), fetch(df, open_, result)))
    df = spark.range(200_000).select(F.rand(3).alias("a"), (F.col("id") % 10).alias("b"))
    found = exact_quartiles(df, ["a", "b"])
    assert (rounds, fetched) == ([{"a", "b"}], [{"a"}])
    assert found["b"] == {"p25": 2.0, "p50": 4.5, "p75": 7.0} and abs(found["a"]["p50"] - 0.5) < 0.01


def test_duplicates_are_compared_cell_by_cell(spark, monkeypatch):
    rows = [(1, None, "a"), (1, None, "a"), (None, 1, "a"), (None, 1, "b"), (None, 1, "b"), (None, 1, "b"), (2, 2, None)]
    df = spark.createDataFrame(rows, "x int, y int, `z z` string")
    assert duplicate_rows(df) == 3
    assert duplicate_rows(df.limit(0)) == 0 and duplicate_rows(df.distinct()) == 0
    # nulls in other cells are not the same row, nor are rows whose digests meet
    monkeypatch.setattr(F, "xxhash64", lambda *cells: F.lit(7).cast("long"))
    assert duplicate_rows(df) == 3


def test_audit_reads_lines_once(spark):
    """The lines stand once in the plan, with one shuffle of keys for all rules."""
    from patronage.operators.profiling import constraint_audit
    from patronage.sources.star import star_tables

    audited = constraint_audit(star_tables(spark, "/root/testdata/sf0.001"))
    plan = audited._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") and plan.count("lineitem") <= 1
    assert sum(line.count("l_linenumber#") > 0 and "Relation" in line for line in plan.splitlines()) == 1


def test_audit_by_hand(spark):
    from patronage.operators.profiling import Checks, audit, present

    tables = {"p": spark.createDataFrame([(1, "a"), (2, "a"), (2, None), (None, "b")], "id long, mail string"),
              "c": spark.createDataFrame([(i, 1 if i % 3 else 9) for i in range(30)] + [(None, None), (5, 2)], "id int, p int"),
              "d": spark.createDataFrame([("a",), ("x",), (None,)], "mail string")}
    found = {(row["table_name"], row["rule"]): row["violations"] for row in audit(tables, {
        "p": Checks(present("id", "mail"), ["id", "mail"]),
        "c": Checks({"id < 40": F.col("id") >= 40}, ["id"], {"p": "p"}),
        "d": Checks(present("mail"), [], {})}).collect()}
    assert found == {("p", "id not null"): 1, ("p", "mail not null"): 1, ("p", "id unique"): 1, ("p", "mail unique"): 1,
                     ("c", "id < 40"): 0, ("c", "id unique"): 1, ("c", "p references"): 10, ("d", "mail not null"): 1}


def test_profile_stores_no_rows(spark, monkeypatch):
    stored: list[list[str]] = []
    monkeypatch.setattr("patronage.operators.profiling.staged", lambda df, label: (stored.append(df.columns), df)[1])
    df = spark.range(100).select("id", (F.col("id") % 4).cast("double").alias("v"), F.lit("t").alias("s"))
    found = {row["column_name"]: row for row in profile(df).collect()}
    assert stored == [["_digest0", "_digest1", "n"]]
    assert found["v"]["p50"] == 1.5 and found["id"]["duplicate_rows"] == 0 and found["s"]["p50"] is None
