from __future__ import annotations

import datetime as dt

import pytest
from conftest import by_key, customer, sale
from pyspark.sql import functions as F

from patronage.operators import rollups
from patronage.plans.dashboard import collected, dashboard, exploratory
from patronage.plans.master import customer_master

JAN, MAR = dt.datetime(2024, 1, 15), dt.datetime(2024, 3, 10)


def months(make, *lines):
    tables = make(customers=[customer(1)], transactions=[
        sale(n, 1, amount, when, status=status) for n, (amount, when, status) in enumerate(lines)])
    return rollups.monthly_revenue(tables.transactions)


def test_gaps_are_filled_and_growth_from_zero_is_zero(make):
    by_month = months(make, (10.0, JAN, "completed"), (99.0, JAN, "cancelled"), (5.0, MAR, "Completed"))
    rows = sorted(tuple(row) for row in rollups.labelled_months(by_month).collect())
    assert rows == [("2024-01", 10.0), ("2024-02", 0.0), ("2024-03", 5.0)]
    assert rollups.growth(by_month).first()[0] == 0.0


def test_growth(make):
    assert rollups.growth(months(make, (10.0, JAN, "completed"))).first()[0] == 0.0
    two = months(make, (10.0, JAN, "completed"), (15.0, JAN + dt.timedelta(days=31), "completed"))
    assert rollups.growth(two).first()[0] == pytest.approx(50.0)
    assert rollups.growth(months(make)).first()[0] == 0.0


def test_months_fill_per_series(spark):
    rows = [("a", dt.date(2024, 1, 1), 1.0), ("a", dt.date(2024, 4, 1), 2.0), ("b", dt.date(2023, 12, 1), 3.0)]
    filled = rollups.fill_months(spark.createDataFrame(rows, "series STRING, month DATE, revenue DOUBLE"),
                                 ["revenue"], ["series"])
    assert sorted(tuple(row) for row in filled.collect()) == [
        ("a", dt.date(2024, 1, 1), 1.0), ("a", dt.date(2024, 2, 1), 0.0), ("a", dt.date(2024, 3, 1), 0.0),
        ("a", dt.date(2024, 4, 1), 2.0), ("b", dt.date(2023, 12, 1), 3.0)]


def test_null_groups(make):
    tables = make(
        customers=[customer(1, state=None, gender=None, age=None), customer(2, gender="Male", age=24)],
        products=[{"product_id": 1, "product_name": "A", "category": None, "unit_price": 1.0, "unit_cost": 1.0},
                  {"product_id": 2, "product_name": "B", "category": "K", "unit_price": 1.0, "unit_cost": 1.0}],
        transactions=[sale(1, 1, 5.0, JAN), sale(2, 2, 7.0, JAN, product_id=2), sale(3, 2, 1.0, JAN, product_id=9)])
    master = customer_master(tables)
    assert [tuple(row) for row in rollups.geography(master).collect()] == [("Here", 1, 8.0)]
    assert {tuple(row) for row in rollups.demographics(master).collect()} == {(None, 1, 5.0), ("Male", 1, 8.0)}
    assert [tuple(row) for row in rollups.age_bands(master).collect()] == [("18-24", 1)]
    assert [tuple(row) for row in rollups.category_revenue(tables.transactions, tables.products).collect()] == [
        ("K", 7.0)]
    assert [tuple(row) for row in rollups.product_performance(tables.transactions, tables.products).collect()] == [
        ("K", "B", 7.0, 1, 1)]
    assert [tuple(row) for row in rollups.uncategorised_revenue(tables.transactions).collect()] == [("Unknown", 13.0)]


def test_age_edges(spark):
    ages = [16, 24, 25, 110, 120, 121, None]
    found = by_key(rollups.age_bands(spark.createDataFrame([(age,) for age in ages], "age INT")), "age_band")
    assert {name: row.customers for name, row in found.items()} == {"18-24": 2, "25-34": 1, "65+": 2}


def test_cohorts_count_customers_once_and_label_unknown_signup(make):
    tables = make(customers=[customer(1, signup_date=dt.date(2023, 5, 9)), customer(2, signup_date=None)],
                  transactions=[sale(1, 1, 1.0, JAN), sale(2, 1, 1.0, JAN), sale(3, 2, 1.0, JAN),
                                sale(4, 1, 1.0, MAR, status="cancelled")])
    rows = {tuple(row) for row in rollups.cohorts(tables.transactions, tables.customers).collect()}
    assert rows == {("2023-05", "2024-01", 1), ("NaT", "2024-01", 1), ("2023-05", "2024-03", 1)}


def test_product_performance_counts_a_transaction_once_over_products_of_a_name(make):
    product = {"category": "K", "product_name": "A", "unit_price": 1.0, "unit_cost": 1.0}
    tables = make(products=[{"product_id": 1, **product}, {"product_id": 2, **product}],
                  transactions=[sale(1, 1, 1.0, JAN), sale(1, 1, 2.0, JAN, product_id=2, quantity=3)])
    assert [tuple(row) for row in rollups.product_performance(tables.transactions, tables.products).collect()] == [
        ("K", "A", 3.0, 4, 1)]


def test_dashboard_members_agree(make):
    tables = make(
        customers=[customer(n, state="AB"[n % 2]) for n in range(1, 9)],
        products=[{"product_id": n, "product_name": "P", "category": "XY"[n % 2], "unit_price": 1.0, "unit_cost": 1.0}
                  for n in (1, 2)],
        transactions=[sale(n, 1 + n % 7, 1.25 * n, JAN + dt.timedelta(days=11 * n), product_id=1 + n % 2,
                           status="cancelled" if n % 5 == 0 else "completed") for n in range(1, 30)])
    found = collected(dashboard(tables))
    revenue = found["kpis"][0].revenue
    assert revenue == sum(1.25 * n for n in range(1, 30) if n % 5)
    for member, column in (("segments", "revenue"), ("geography", "revenue"), ("monthly_revenue", "revenue"),
                           ("category_revenue", "order_amount")):
        assert sum(row[column] for row in found[member]) == pytest.approx(revenue)
    assert sum(row.customers for row in found["segments"]) == 8
    header = found["dataset"][0]
    assert (header.transactions, header.products, header.customers, header.markets) == (29, 2, 8, 2)
    assert header.date_start == "2024-01-26T00:00:00"
    everything = collected(dashboard(tables, statuses=None))
    assert sum(row.revenue for row in everything["monthly_revenue"]) == sum(1.25 * n for n in range(1, 30))
    named = collected(dashboard(tables, statuses=["cancelled"]))
    assert sum(row.order_amount for row in named["category_revenue"]) == sum(1.25 * n for n in range(5, 30, 5))


def test_exploratory_members(make):
    tables = make(customers=[customer(1)], transactions=[sale(1, 1, 2.0, JAN)])
    found = collected(exploratory(tables))
    assert [tuple(row) for row in found["demographics"]] == [("Female", 1, 2.0)]
    assert found["product_performance"] == []


def test_empty_tables_give_zero_figures(make):
    found = collected(dashboard(make()))
    kpis = found["kpis"][0]
    assert (kpis.customers, kpis.revenue, kpis.churn_rate, kpis.top_segment) == (0, 0.0, 0.0, None)
    assert found["segments"] == [] and found["dataset"][0].transactions == 0


def test_top_segment_tie_and_histogram(spark):
    df = spark.createDataFrame([("Silver",), ("Gold",)], "segment STRING")
    assert rollups.top_segment(df).first()[0] == "Gold"
    scores = spark.createDataFrame([(0.01,), (0.04,), (0.99,), (1.0,)], "churn_probability DOUBLE")
    bins = {row.bin: row.customers for row in rollups.probability_histogram(scores).collect()}
    assert bins == {1: 1, 2: 1, 25: 2}


def test_value_summary_and_markets(spark):
    listed = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 9.0), (4, 4.0)], "customer_id INT, predicted_clv DOUBLE")
    assert tuple(rollups.value_summary(listed).first()) == (4, 9.0, 3.0)
    assert tuple(rollups.value_summary(listed.limit(0)).first()) == (0, None, None)
    states = spark.createDataFrame([("B", 1, 5.0), ("A", 2, 5.0), ("C", 1, 1.0)],
                                   "state STRING, customers BIGINT, revenue DOUBLE")
    assert tuple(rollups.market_summary(states).first()) == (3, "A", 5.0)
    assert [row.state for row in rollups.top_by(states, "revenue", "state", 2).collect()] == ["A", "B"]
    assert states.filter(F.col("revenue") > 9).count() == 0


def test_cohorts_of_a_hot_customer_and_a_hot_month(spark):
    """A third of the lines are one customer's, all customers signed up in one month; eleven years are three numbers each."""
    import collections
    import random

    draw = random.Random(5)
    lines = [(1 if i % 3 == 0 else draw.randrange(2, 60), dt.datetime(2010 + m // 12, m % 12 + 1, 9) if m < 132 else None)
             for i in range(6_000) for m in [draw.randrange(133)]]
    frame = spark.createDataFrame([(*line, "completed") for line in lines],
                                  "customer_id long, order_date timestamp_ntz, status string").repartition(6)
    people = spark.createDataFrame([(c, dt.date(2010, 1, 5)) for c in range(1, 50)], "customer_id long, signup_date date")
    found = rollups.cohorts(frame, people)
    active = collections.defaultdict(set)
    for customer, date in lines:
        active["2010-01" if customer < 50 else "NaT", date.strftime("%Y-%m") if date else "NaT"].add(customer)
    assert {(row["cohort"], row["activity_month"]): row["active_customers"] for row in found.collect()} == {
        key: len(who) for key, who in active.items()}
    # what is shuffled first are the customers' numbers, not their months
    first = frame.groupBy("customer_id", F.floor((F.year("order_date") * 12 + F.month("order_date") - 1) / rollups.MASK_MONTHS))
    assert first.count().count() < 0.1 * frame.select("customer_id", F.date_trunc("month", "order_date")).distinct().count()
