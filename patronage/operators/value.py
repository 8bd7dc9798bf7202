"""Customer lifetime value, health, churn risk and the next best action."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.numbers import band, clipped, rounded
from patronage.operators.ranking import global_dense_rank

# Fixed values of the scoring rules.
MARGIN_RATE = 0.30
DISCOUNT_RATE = 0.10
HORIZON_YEARS = 3
RETENTION_RANGE = (0.05, 0.95)
CHURN_DAYS = 90
RISK_BANDS = [(0.35, "Low"), (0.65, "Medium"), (1.0, "High")]
PROBABILITY_RANGE = (0.01, 0.99)
PRIORITIES = ["High", "Medium", "Low"]
RESPONSIVE_RATE = 0.5
NARROW_RANGE = 1


def retention(master: DataFrame) -> DataFrame:
    """One row: the share of customers with more than one order, kept within its range."""
    share = F.try_divide(F.count_if(F.col("order_count") > 1), F.count("*"))
    return master.agg(clipped(share, *RETENTION_RANGE).alias("retention"))


def lifetime_value(master: DataFrame, margin_rate: float = MARGIN_RATE,
                   horizon_years: int = HORIZON_YEARS) -> DataFrame:
    """Add ``predicted_clv``: yearly margin times the discounted years of expected retention."""
    discounted = F.col("retention") / F.lit(1 + DISCOUNT_RATE)
    years = F.aggregate(
        F.sequence(F.lit(1), F.lit(horizon_years)),
        F.struct(F.lit(1.0).alias("power"), F.lit(0.0).alias("total")),
        lambda state, _: F.struct((state["power"] * discounted).alias("power"),
                                  (state["total"] + state["power"] * discounted).alias("total")),
        lambda state: state["total"],
    )
    multiplier = retention(master).select(years).scalar()
    worth = F.col("average_order_value") * F.col("purchase_frequency") * F.lit(margin_rate) * multiplier
    return master.withColumn("predicted_clv", clipped(worth, 0.0))


def lifetime_value_ranked(master: DataFrame, margin_rate: float = MARGIN_RATE,
                          horizon_years: int = HORIZON_YEARS) -> DataFrame:
    """``lifetime_value`` with its dense rank, highest first."""
    return global_dense_rank(lifetime_value(master, margin_rate, horizon_years), "predicted_clv", "customer_id",
                             "clv_rank")


def is_churned(days: int = CHURN_DAYS) -> Column:
    return F.col("recency_days") > days


def health() -> Column:
    """0 to 100 from recency, campaign response and satisfaction."""
    idle = F.least(F.greatest(F.col("recency_days"), F.lit(0)), F.lit(365))
    score = (F.lit(100.0) - idle / F.lit(365.0) * 60 + F.col("campaign_response_rate") * 20
             + F.coalesce(F.col("avg_satisfaction"), F.lit(0.0)) / 5 * 20)
    return clipped(score, 0.0, 100.0)


def service_probability() -> Column:
    """Risk from recency and tickets, eased by campaign response."""
    idle = clipped(F.col("recency_days") / F.lit(365.0), 0.0, 1.0)
    return (F.lit(0.15) + idle * 0.65 + F.when(F.col("support_tickets") > 2, 0.1).otherwise(0.0)
            - F.col("campaign_response_rate") * 0.15)


def behavioral_probability() -> Column:
    """Risk from recency, eased by the number of orders."""
    idle = F.least(F.greatest(F.col("recency_days"), F.lit(0)), F.lit(365)) / F.lit(365.0)
    return F.lit(0.08) + idle * 0.78 - F.log1p("order_count") / F.log(F.lit(25.0)) * 0.16


def churn_scores(master: DataFrame, formula: str = "service") -> DataFrame:
    """Heuristic churn probability per customer and its risk level."""
    formulas = {"service": service_probability, "behavioral": behavioral_probability}
    probability = clipped(formulas[formula](), *PROBABILITY_RANGE)
    return with_risk_level(master.select("customer_id", "name", probability.alias("churn_probability")))


def with_risk_level(scores: DataFrame) -> DataFrame:
    probability = rounded(F.col("churn_probability"), 4)
    return scores.withColumn("churn_probability", probability).withColumn(
        "risk_level", band(F.col("churn_probability"), RISK_BANDS))


def churn_queue(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.col("churn_probability").desc(), "customer_id")


def next_best_actions(valued: DataFrame, narrow_range: int = NARROW_RANGE, campaigns: bool = True) -> DataFrame:
    """The first rule that fits a customer; customers no rule fits are left out.

    Needs the master with segment and ``predicted_clv``.
    """
    def proposal(action: str, reason: str | Column, priority: str) -> Column:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(action).alias("action"), reason.alias("reason"), F.lit(priority).alias("priority"))

    idle = F.format_string("No purchase for %d days", F.col("recency_days"))
    choice = (
        F.when(is_churned() & (F.col("total_revenue") > 0), proposal("Retention outreach", idle, "High"))
        .when(F.col("segment") == "Platinum",
              proposal("VIP loyalty offer", "High RFM value and engagement", "Medium"))
        .when((F.col("order_count") >= 2) & (F.col("product_diversity") <= narrow_range),
              proposal("Cross-sell adjacent category", "Repeat buyer with narrow category mix", "Medium"))
    )
    if campaigns:
        choice = choice.when(F.col("campaign_response_rate") >= RESPONSIVE_RATE,
                             proposal("Target next campaign", "Historically responsive to marketing", "Low"))
    return (
        valued.select("customer_id", F.col("name").alias("customer_name"), choice.alias("choice"),
                      rounded(F.col("predicted_clv"), 2).alias("expected_value"))
        .filter(F.col("choice").isNotNull())
        .select("customer_id", "customer_name", "choice.*", "expected_value")
    )


def priority_rank() -> Column:
    order = F.when(F.col("priority") == PRIORITIES[0], 0)
    for rank, priority in enumerate(PRIORITIES[1:], start=1):
        order = order.when(F.col("priority") == priority, rank)
    return order


def action_queue(actions: DataFrame, priorities: Iterable[str] | None = None) -> DataFrame:
    """By priority, then value; optionally only some priorities."""
    if priorities is not None:
        actions = actions.filter(F.col("priority").isin(list(priorities)))
    return actions.orderBy(priority_rank(), F.col("expected_value").desc(), "customer_id")
