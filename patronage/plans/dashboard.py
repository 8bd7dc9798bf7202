"""Result bundles: dashboard and exploratory analysis."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from patronage.operators import rollups
from patronage.operators.segments import rfm_segments
from patronage.operators.value import lifetime_value, next_best_actions
from patronage.plans.master import customer_master
from patronage.schemas import Tables
from patronage.session import at_once, staged

# what scores, KPIs and geography are computed from
HEADLINE_COLUMNS = ["customer_id", "state", "recency_days", "order_count", "total_revenue", "total_profit",
                    "average_order_value", "campaign_response_rate", "avg_satisfaction"]


def segmented_master(tables: Tables, columns: Iterable[str] | None = None, as_of=None) -> DataFrame:
    """The master, or the columns asked for, with RFM scores and segment."""
    scored = ["customer_id", "recency_days", "order_count", "total_revenue"]
    wanted = None if columns is None else list(dict.fromkeys(scored + list(columns)))
    return rfm_segments(customer_master(tables, as_of=as_of, columns=wanted, reuse=True))


def valued_master(tables: Tables, columns: Iterable[str] | None = None, as_of=None) -> DataFrame:
    """``segmented_master`` with ``predicted_clv``."""
    wanted = None if columns is None else ["average_order_value", "purchase_frequency", *columns]
    return lifetime_value(segmented_master(tables, wanted, as_of))


def action_master(tables: Tables, narrow_range: int = 1, campaigns: bool = True, as_of=None) -> DataFrame:
    """Next best actions straight from the tables."""
    columns = ["name", "product_diversity", "campaign_response_rate"]
    return next_best_actions(valued_master(tables, columns, as_of), narrow_range, campaigns)


def dashboard(tables: Tables, statuses: Iterable[str] | None = rollups.PAID, as_of=None,
              segmented: DataFrame | None = None) -> dict[str, DataFrame]:
    """Header, KPIs, segments, geography, monthly and category revenue.

    The transactions are read twice, whatever the number of members: once per
    customer, and once for the months and products. The first is left out if the
    segmented master is at hand.
    """
    segmented, totals = at_once([
        lambda: segmented_master(tables, HEADLINE_COLUMNS, as_of) if segmented is None else segmented,
        lambda: staged(rollups.activity_totals(tables.transactions), "totals"),
    ])
    if statuses is None:
        counted = totals
    elif [status.lower() for status in statuses] == list(rollups.PAID):
        counted = totals.filter("completed")
    else:
        counted = rollups.activity_totals(rollups.with_statuses(tables.transactions, statuses))
    months = counted.filter(F.col("by_month") & F.col("month").isNotNull())
    by_month = rollups.fill_months(months.groupBy("month").agg(F.sum("order_amount").alias("revenue")), ["revenue"])
    by_product = counted.filter(~F.col("by_month")).groupBy("product_id").agg(
        F.sum("order_amount").alias("order_amount"))
    return {
        "dataset": rollups.dataset_header(totals.filter("by_month"), tables.products, segmented),
        "kpis": rollups.executive_kpis(segmented, by_month),
        "segments": rollups.segment_rollup(segmented),
        "geography": rollups.geography(segmented),
        "monthly_revenue": rollups.labelled_months(by_month),
        "category_revenue": rollups.category_totals(by_product, tables.products),
    }


def exploratory(tables: Tables, statuses: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Demographics, age bands, signup cohorts and product performance."""
    master = customer_master(tables, columns=["customer_id", "gender", "age", "total_revenue"], reuse=True)
    return {
        "demographics": rollups.demographics(master),
        "age_distribution": rollups.age_bands(master),
        "cohorts": rollups.cohorts(tables.transactions, tables.customers, statuses),
        "product_performance": rollups.product_performance(tables.transactions, tables.products, statuses),
    }


def collected(bundle: dict[str, DataFrame]) -> dict[str, list[Row]]:
    """The rows of every member, for bundles of small results; the members run side by side."""
    return dict(zip(bundle, at_once([member.collect for member in bundle.values()]), strict=True))
