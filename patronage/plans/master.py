"""The customer master: one row per customer with everything known about them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.functions.dates import iso_text, moment_literal, naive, whole_days
from patronage.operators.features import (
    as_of_date,
    is_completed,
    marketing_features,
    profit,
    support_features,
    transaction_features,
    transaction_measures,
)
from patronage.functions.numbers import money
from patronage.schemas import Tables
from patronage.session import staged

NEVER = 9999  # recency of a customer who never bought
DAYS_PER_YEAR = 365.25

SALES = ["total_revenue", "total_profit", "order_count", "average_order_value", "last_purchase_date",
         "first_purchase_date", "product_diversity", "recency_days"]
MARKETING = ["campaigns_received", "campaign_responses", "marketing_cost", "campaign_response_rate"]
SUPPORT = ["support_tickets", "avg_resolution_hours", "avg_satisfaction"]
DERIVED = ["tenure_days", "purchase_frequency"]
AS_OF_COLUMNS = {"recency_days", "tenure_days", "purchase_frequency"}

# which aggregates a master column is computed from, where it is not the aggregate itself
NEEDS = {
    "average_order_value": ["total_revenue", "paid_lines"],
    "recency_days": ["last_purchase_date"],
    "tenure_days": [],
    "purchase_frequency": ["order_count"],
}


def customer_master(tables: Tables, as_of: dt.datetime | Column | None = None, columns: Iterable[str] | None = None,
                    reuse: bool = False) -> DataFrame:
    """Customers with their sales, marketing and support measures.

    ``columns`` limits the work to what is needed later; all columns otherwise.
    ``as_of`` is a day after the last transaction of any status unless given, and
    the current time without any transaction. It is taken from the same pass over
    the transactions as the other measures: that pass is written once, with one
    row per customer, and then read for the date and for the rows. ``reuse`` asks
    for the same where several passes over the master follow.
    """
    identity = tables.customers.columns
    wanted = list(columns) if columns is not None else identity + SALES + MARKETING + SUPPORT + DERIVED
    needs_date = bool(AS_OF_COLUMNS.intersection(wanted))
    from_data = needs_date and as_of is None

    sales = _sales_inputs(wanted) + (["last_activity"] if from_data else [])
    kept = _customer_inputs(identity, wanted)
    joined = tables.customers.select(*kept)
    if sales:
        lines = tables.transactions
        if not from_data:  # every measure left counts completed lines only
            lines = lines.filter(is_completed())
        features = transaction_features(lines, sales)
        if from_data:
            # transactions of customers not on file move the date too
            joined = joined.withColumn("_on_file", F.lit(True)).join(features, "customer_id", "full_outer")
        else:
            joined = joined.join(features, "customer_id", "left")
    if set(wanted).intersection(MARKETING):
        joined = joined.join(marketing_features(tables.marketing), "customer_id", "left")
    if set(wanted).intersection(SUPPORT):
        joined = joined.join(support_features(tables.support), "customer_id", "left")

    if from_data:
        joined = staged(joined, "master")
        # one value; as a literal it folds into every expression that uses it
        last = joined.agg(F.max("last_activity")).first()[0]
        as_of = last + dt.timedelta(days=1) if last is not None else F.localtimestamp()
        joined = joined.filter("_on_file")
    elif reuse:
        joined = staged(joined, "master")
    moment = None
    if needs_date:
        moment = as_of if isinstance(as_of, Column) else moment_literal(as_of)
    return joined.select(*[_column(name, identity, moment).alias(name) for name in wanted])


def _sales_inputs(wanted: Iterable[str]) -> list[str]:
    known = transaction_measures()
    inputs: list[str] = []
    for name in wanted:
        for measure in NEEDS.get(name, [name] if name in known else []):
            if measure not in inputs:
                inputs.append(measure)
    return inputs


def _customer_inputs(identity: list[str], wanted: list[str]) -> list[str]:
    extra = {"signup_date"} if {"tenure_days", "purchase_frequency"}.intersection(wanted) else set()
    return [name for name in identity if name == "customer_id" or name in wanted or name in extra]


def _column(name: str, identity: list[str], as_of: Column | None) -> Column:
    if name in identity:
        return F.col(name)
    if name in ("total_revenue", "total_profit", "marketing_cost"):
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    if name in ("last_purchase_date", "first_purchase_date"):
        return F.col(name)
    if name == "average_order_value":
        return F.coalesce(F.try_divide(F.col("total_revenue").cast("double"), "paid_lines"), F.lit(0.0))
    if name == "recency_days":
        since = F.greatest(whole_days(as_of, F.col("last_purchase_date")), F.lit(0))
        return F.when(F.col("last_purchase_date").isNull(), NEVER).otherwise(since)
    if name == "tenure_days":
        return tenure_days(as_of)
    if name == "purchase_frequency":
        years = F.greatest(tenure_days(as_of) / F.lit(DAYS_PER_YEAR), F.lit(1.0))
        return F.when(F.col("signup_date").isNotNull(), F.coalesce(F.col("order_count"), F.lit(0)) / years)
    if name in ("campaign_response_rate", "avg_resolution_hours", "avg_satisfaction"):
        return F.coalesce(F.col(name), F.lit(0.0))
    return F.coalesce(F.col(name), F.lit(0).cast("bigint"))


def tenure_days(as_of: Column) -> Column:
    """At least one day; unknown without a signup date."""
    return F.when(F.col("signup_date").isNotNull(),
                  F.greatest(whole_days(as_of, F.col("signup_date")), F.lit(1)))


def customer_profile(tables: Tables, customer_id: int, as_of: dt.datetime | None = None) -> DataFrame:
    """The master row of one customer, or no row.

    The key filter reaches every scan; only the as-of date looks at all
    transactions, and at nothing but their dates.
    """
    if as_of is None:
        as_of = F.coalesce(as_of_date(tables.transactions).scalar(), F.localtimestamp())
    mine = Tables(*[table.filter(F.col("customer_id") == customer_id) if "customer_id" in table.columns else table
                    for table in tables])
    return customer_master(mine, as_of=as_of)


def as_document(rows: DataFrame) -> DataFrame:
    """Each row as JSON text, dates in ISO form and missing values as null."""
    shown = [iso_text(F.col(name)).alias(name) if kind in ("timestamp", "timestamp_ntz", "date") else F.col(name)
             for name, kind in rows.dtypes]
    return rows.select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("document"))


def register_master_view(spark: SparkSession, tables: Tables, name: str = "customer_master_view") -> DataFrame:
    """The master as a SQL view over per-customer sums.

    Joining the three fact tables first and summing afterwards would multiply
    revenue by the number of touches and tickets.
    """
    tables.customers.createOrReplaceTempView(f"{name}_customers")
    tables.transactions.filter(F.col("status") == "completed").select(
        "customer_id", "transaction_id", "product_id", naive("order_date").alias("order_date"),
        money("order_amount").alias("order_amount"), profit().alias("profit"),
    ).createOrReplaceTempView(f"{name}_lines")
    tables.marketing.createOrReplaceTempView(f"{name}_marketing")
    tables.support.createOrReplaceTempView(f"{name}_support")
    view = spark.sql(f"""
        SELECT c.customer_id, c.name, c.age, c.gender, c.city, c.state, c.signup_date,
               coalesce(t.order_count, 0) AS order_count,
               coalesce(CAST(t.revenue AS DOUBLE), 0D) AS total_revenue,
               coalesce(CAST(t.profit AS DOUBLE), 0D) AS total_profit,
               coalesce(CAST(t.revenue AS DOUBLE) / t.priced, 0D) AS average_order_value,
               t.last_purchase_date,
               coalesce(t.product_diversity, 0) AS product_diversity,
               coalesce(m.campaigns_received, 0) AS campaigns_received,
               coalesce(m.responses / m.touches, 0D) AS campaign_response_rate,
               coalesce(s.tickets, 0) AS support_ticket_count,
               coalesce(CAST(s.hours AS DOUBLE) / s.timed, 0D) AS avg_resolution_hours
        FROM {name}_customers c
        LEFT JOIN (
            SELECT customer_id, count(DISTINCT transaction_id) AS order_count, sum(order_amount) AS revenue,
                   sum(profit) AS profit, nullif(count(order_amount), 0) AS priced,
                   max(order_date) AS last_purchase_date, count(DISTINCT product_id) AS product_diversity
            FROM {name}_lines GROUP BY customer_id) t ON t.customer_id = c.customer_id
        LEFT JOIN (
            SELECT customer_id, count(DISTINCT campaign_id) AS campaigns_received, count(*) AS touches,
                   count_if(campaign_response) AS responses
            FROM {name}_marketing GROUP BY customer_id) m ON m.customer_id = c.customer_id
        LEFT JOIN (
            SELECT customer_id, count(DISTINCT ticket_id) AS tickets, nullif(count(resolution_time), 0) AS timed,
                   sum(CAST(resolution_time AS DECIMAL(28,10))) AS hours
            FROM {name}_support GROUP BY customer_id) s ON s.customer_id = c.customer_id
    """)
    view.createOrReplaceTempView(name)
    return view
