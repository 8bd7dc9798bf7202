"""Per-customer measures from transactions, marketing touches and support tickets.

Every fact table is reduced to its key before anything is joined to it, so rows of
one table never multiply the amounts of another, and a customer holding a large
share of the rows is summed up on the map side.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patronage.functions.dates import naive
from patronage.functions.numbers import money

COMPLETED = "completed"
FIRST = "_first"


def is_completed(status: Column | str = "status") -> Column:
    """Whatever the letter case; no status is not completed."""
    status = F.col(status) if isinstance(status, str) else status
    return F.coalesce(F.lower(status) == COMPLETED, F.lit(False))


def with_statuses(transactions: DataFrame, statuses: Iterable[str] | None) -> DataFrame:
    """Only the named statuses, in any letter case; all rows for ``None``."""
    if statuses is None:
        return transactions
    return transactions.filter(F.lower("status").isin([status.lower() for status in statuses]))


def profit() -> Column:
    return money("order_amount") - money("cost_amount") - money("discount_amount")


def transaction_measures() -> dict[str, Column]:
    """Aggregates over all lines that count the completed ones; ``last_activity`` sees every line."""
    done = is_completed()
    return {
        "total_revenue": F.sum(F.when(done, money("order_amount"))),
        "total_profit": F.sum(F.when(done, profit())),
        "order_count": F.count_distinct(F.when(done, F.col("transaction_id"))),
        "paid_lines": F.count(F.when(done, F.col("order_amount"))),
        "last_purchase_date": F.max(F.when(done, naive("order_date"))),
        "first_purchase_date": F.min(F.when(done, naive("order_date"))),
        "product_diversity": F.count_distinct(F.when(done, F.col("product_id"))),
        "last_activity": F.max(naive("order_date")),
    }


def with_first_lines(transactions: DataFrame) -> DataFrame:
    """Mark one completed line of every transaction of a customer.

    Lines are dealt out by transaction and customer, so a customer with many of them
    fills no task; lines without a transaction, which are never marked, go by product.
    """
    able = is_completed() & F.col("transaction_id").isNotNull()
    spread = F.col("product_id").try_cast(transactions.schema["transaction_id"].dataType)
    place = F.row_number().over(
        W.partitionBy(F.coalesce("transaction_id", spread), "customer_id").orderBy(able.desc()))
    return transactions.withColumn(FIRST, F.when(able & (place == 1), True))


def transaction_features(transactions: DataFrame, measures: Iterable[str]) -> DataFrame:
    """One row per customer with the named measures.

    Two distinct counts in one aggregation copy every line three times, sums and all;
    where both are asked for, transactions are counted by their marked lines.
    """
    known, measures = transaction_measures(), list(measures)
    if {"order_count", "product_diversity"}.issubset(measures):
        transactions = with_first_lines(transactions)
        known["order_count"] = F.count(FIRST)
    return transactions.groupBy("customer_id").agg(*[known[name].alias(name) for name in measures])


def marketing_features(marketing: DataFrame) -> DataFrame:
    return marketing.groupBy("customer_id").agg(
        F.count("campaign_id").alias("campaigns_received"),
        F.count_if("campaign_response").alias("campaign_responses"),
        F.sum(money("campaign_cost")).cast("double").alias("marketing_cost"),
        F.try_divide(F.count_if("campaign_response"), F.count("campaign_id")).alias("campaign_response_rate"),
    )


def support_features(support: DataFrame) -> DataFrame:
    """Means ignore tickets without the value."""
    def mean(name: str) -> Column:
        return F.try_divide(F.sum(F.col(name).cast("decimal(28,10)")).cast("double"), F.count(name))

    return support.groupBy("customer_id").agg(
        F.count("ticket_id").alias("support_tickets"),
        mean("resolution_time").alias("avg_resolution_hours"),
        mean("satisfaction_score").alias("avg_satisfaction"),
    )


def as_of_date(transactions: DataFrame) -> DataFrame:
    """One row: a day after the last transaction of any status."""
    return transactions.agg((F.max(naive("order_date")) + F.expr("INTERVAL 1 DAY")).alias("as_of"))
