from __future__ import annotations

import datetime as dt
import json

import pytest
from conftest import by_key, customer, sale

from patronage.operators.features import transaction_features
from patronage.plans.master import as_document, customer_master, customer_profile, register_master_view

NOON = dt.datetime(2024, 3, 1, 12)


def test_recency_counts_whole_days(make):
    tables = make(customers=[customer(1)], transactions=[sale(1, 1, 5.0, dt.datetime(2024, 2, 29, 13))])
    row = customer_master(tables, as_of=NOON).first()
    assert row.recency_days == 0


def test_customer_without_any_row(make):
    tables = make(customers=[customer(1), customer(2)], transactions=[sale(1, 1, 5.0, NOON)])
    row = by_key(customer_master(tables), "customer_id")[2]
    assert (row.recency_days, row.order_count, row.total_revenue, row.purchase_frequency) == (9999, 0, 0.0, 0.0)
    assert (row.campaigns_received, row.support_tickets, row.average_order_value) == (0, 0, 0.0)
    assert row.tenure_days >= 1 and row.last_purchase_date is None


def test_facts_do_not_multiply_each_other(spark, make):
    tables = make(
        customers=[customer(1)],
        transactions=[sale(1, 1, 10.0, NOON, cost_amount=4.0, discount_amount=1.0), sale(2, 1, 20.0, NOON)],
        marketing=[{"campaign_id": n, "customer_id": 1, "campaign_response": n == 1, "campaign_cost": 2.0,
                    "touched_at": NOON} for n in (1, 2, 3)],
        support=[{"ticket_id": n, "customer_id": 1, "resolution_time": hours, "opened_at": NOON}
                 for n, hours in ((1, 3.0), (2, None))],
    )
    row = customer_master(tables).first()
    assert (row.total_revenue, row.total_profit, row.average_order_value) == (30.0, 25.0, 15.0)
    assert (row.campaigns_received, row.campaign_responses, row.marketing_cost) == (3, 1, 6.0)
    assert row.campaign_response_rate == pytest.approx(1 / 3)
    assert (row.support_tickets, row.avg_resolution_hours) == (2, 3.0)
    view = register_master_view(spark, tables).first()
    assert (view.total_revenue, view.total_profit, view.support_ticket_count) == (30.0, 25.0, 2)
    assert spark.table("customer_master_view").count() == 1


def test_status_in_any_case_and_as_of_over_all_statuses(make):
    tables = make(customers=[customer(1)], transactions=[
        sale(1, 1, 1.0, NOON, status="Completed"), sale(2, 1, 2.0, NOON, status="COMPLETED"),
        sale(3, 1, 4.0, NOON + dt.timedelta(days=9), status="cancelled")])
    row = customer_master(tables).first()
    assert (row.total_revenue, row.order_count, row.recency_days) == (3.0, 2, 10)


def test_as_of_sees_customers_not_on_file(make):
    tables = make(customers=[customer(1)], transactions=[
        sale(1, 1, 1.0, NOON), sale(2, 77, 1.0, NOON + dt.timedelta(days=5))])
    rows = customer_master(tables).collect()
    assert [(row.customer_id, row.recency_days) for row in rows] == [(1, 6)]


def test_given_and_derived_as_of_agree(make):
    tables = make(customers=[customer(1), customer(2)], transactions=[
        sale(1, 1, 1.5, NOON), sale(1, 1, 2.5, NOON, product_id=2), sale(2, 2, 4.0, NOON - dt.timedelta(days=40))])
    derived = sorted(customer_master(tables).collect())
    given = sorted(customer_master(tables, as_of=NOON + dt.timedelta(days=1)).collect())
    assert derived == given
    assert derived[0].order_count == 1 and derived[0].product_diversity == 2 and derived[0].average_order_value == 2.0


def test_columns_limit_the_work(make):
    tables = make(customers=[customer(1)], transactions=[sale(1, 1, 1.0, NOON)])
    master = customer_master(tables, columns=["state", "total_revenue"])
    assert master.columns == ["state", "total_revenue"]
    plan = master._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan and "support" not in plan


def test_no_transactions_still_gives_all_columns(make):
    row = customer_master(make(customers=[customer(1)])).first()
    assert row.recency_days == 9999 and row.tenure_days > 1000 and row.total_profit == 0.0


def test_profile_filters_every_scan(spark, make, tmp_path):
    tables = make(customers=[customer(1), customer(2)],
                  transactions=[sale(1, 1, 1.0, NOON), sale(2, 2, 4.0, NOON + dt.timedelta(days=3))])
    stored = type(tables)(*[_stored(spark, table, f"{tmp_path}/{name}")
                            for name, table in zip(tables._fields, tables, strict=True)])
    found = customer_profile(stored, 1)
    row = found.first()
    assert (row.customer_id, row.total_revenue, row.recency_days) == (1, 1.0, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(customer_id,1)") >= 2
    assert customer_profile(stored, 99).count() == 0


def test_document_keeps_nulls_and_iso_dates(make):
    tables = make(customers=[customer(1, email=None)], transactions=[sale(1, 1, 1.0, NOON)])
    document = json.loads(as_document(customer_master(tables)).first()[0])
    assert document["last_purchase_date"] == "2024-03-01T12:00:00"
    assert document["email"] is None and document["customer_id"] == 1


def _stored(spark, table, path):
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def test_two_distinct_counts_do_not_copy_the_lines(spark, make):
    lines = [
        sale(1, 1, 10.0, NOON, status="cancelled", product_id=7), sale(1, 1, 10.0, NOON, product_id=8),
        sale(1, 1, 10.0, NOON, product_id=9), sale(1, 2, 5.0, NOON, product_id=8), sale(2, 1, 1.0, NOON, product_id=9),
        sale(None, 1, 2.0, NOON, product_id=1), sale(None, 1, 2.0, NOON, product_id=None),
        sale(3, 1, 9.0, NOON, status="cancelled", product_id=6), sale(4, 3, 9.0, NOON, status=None),
    ]
    # the transaction without a number is dealt out with number 1, and must not count in its place
    found = transaction_features(make(transactions=lines).transactions, ["order_count", "product_diversity", "total_revenue"])
    rows = {key: (row.order_count, row.product_diversity, row.total_revenue)
            for key, row in by_key(found, "customer_id").items()}
    assert rows == {1: (2, 3, 25), 2: (1, 1, 5), 3: (0, 0, None)}
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
