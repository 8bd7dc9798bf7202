"""Group totals over the master and the transactions.

Transactions are always reduced to the key of a dimension before that dimension
is joined, so no join carries fact rows and a key with many rows arrives as one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patronage.functions.dates import iso_text, month_label, month_start, naive
from patronage.functions.numbers import EXACT, band, exact_mean, money, rounded
from patronage.operators.features import COMPLETED, is_completed, with_statuses
from patronage.operators.selection import median
from patronage.operators.value import health, is_churned

PAID = (COMPLETED,)

# Right-closed age bands.
AGE_BANDS = [(24, "18-24"), (34, "25-34"), (44, "35-44"), (54, "45-54"), (64, "55-64"), (120, "65+")]
#: Months that one number holds as bits.
MASK_MONTHS = 60
HISTOGRAM_BINS = 25
PUBLIC_SOURCE, UPLOADED_SOURCE = "Public retail data", "Demo or uploaded data"


def total(amount: str) -> Column:
    return rounded(F.sum(F.col(amount).cast("decimal(28,4)")), 2)


def customers_and_revenue(master: DataFrame, group: str) -> DataFrame:
    """Customers and revenue per group; a null group is kept."""
    return master.groupBy(group).agg(F.count("customer_id").alias("customers"), total("total_revenue").alias("revenue"))


def segment_rollup(segmented: DataFrame) -> DataFrame:
    return customers_and_revenue(segmented, "segment")


def geography(master: DataFrame) -> DataFrame:
    """Customers without a state are left out."""
    return customers_and_revenue(master.filter(F.col("state").isNotNull()), "state")


def demographics(master: DataFrame) -> DataFrame:
    return customers_and_revenue(master, "gender")


def age_bands(master: DataFrame) -> DataFrame:
    """Customers per age band; unknown ages and empty bands are left out."""
    known = master.withColumn("age_band", F.when(F.col("age") > 0, band(F.col("age"), AGE_BANDS)))
    return known.filter(F.col("age_band").isNotNull()).groupBy("age_band").agg(F.count("*").alias("customers"))


def count_by(rows: DataFrame, *groups: str) -> DataFrame:
    return rows.groupBy(*groups).agg(F.count("*").alias("customers"))


def monthly(transactions: DataFrame, measures: dict[str, Column], series: Iterable[str] = (),
            date: str = "order_date") -> DataFrame:
    """Aggregates per calendar month (and series), with zeros for the months in between.

    The months missing after a month are generated from the month that follows
    it, so the transactions are read once and nothing is joined.
    """
    series = list(series)
    by_month = transactions.filter(F.col(date).isNotNull()).groupBy(
        *series, month_start(date).alias("month")).agg(*[agg.alias(name) for name, agg in measures.items()])
    return fill_months(by_month, list(measures), series)


def fill_months(by_month: DataFrame, measures: list[str], series: Iterable[str] = ()) -> DataFrame:
    """``by_month`` has at most one row per month and series, which is what bounds the window."""
    series = list(series)
    following = F.lead("month").over(W.partitionBy(*series).orderBy("month"))
    until = F.coalesce(F.add_months("_following", -1), F.col("month"))
    spread = by_month.withColumn("_following", following).withColumn(
        "_filled", F.explode(F.sequence("month", until, F.expr("INTERVAL 1 MONTH"))))
    own = F.col("_filled") == F.col("month")
    zeros = [F.when(own, F.col(name)).otherwise(F.lit(0).cast(by_month.schema[name].dataType)).alias(name)
             for name in measures]
    return spread.select(*series, F.col("_filled").alias("month"), *zeros)


def monthly_revenue(transactions: DataFrame, statuses: Iterable[str] | None = PAID,
                    series: Iterable[str] = ()) -> DataFrame:
    """Exact monthly revenue with ``month`` as a date."""
    return monthly(with_statuses(transactions, statuses), {"revenue": F.sum(money("order_amount"))}, series)


def labelled_months(by_month: DataFrame) -> DataFrame:
    return by_month.select(month_label("month").alias("month"), rounded(F.col("revenue"), 2).alias("revenue"))


def growth(by_month: DataFrame) -> DataFrame:
    """One row: percent change of the last month on the one before; 0 where that is undefined.

    At most one row per month arrives here.
    """
    months = by_month.agg(F.array_sort(F.collect_list(F.struct("month", "revenue"))).alias("months"))
    now = F.try_element_at("months", F.lit(-1))["revenue"].cast("double")
    before = F.try_element_at("months", F.lit(-2))["revenue"].cast("double")
    change = F.try_divide(now - before, before) * 100
    return months.select(F.coalesce(change, F.lit(0.0)).alias("growth_pct"))


def category_revenue(transactions: DataFrame, products: DataFrame,
                     statuses: Iterable[str] | None = PAID) -> DataFrame:
    """Revenue per category, largest first; lines without a category are left out."""
    by_product = with_statuses(transactions, statuses).groupBy("product_id").agg(
        F.sum(money("order_amount")).alias("order_amount"))
    return category_totals(by_product, products)


def category_totals(by_product: DataFrame, products: DataFrame) -> DataFrame:
    joined = by_product.join(products.select("product_id", "category"), "product_id", "left")
    return (
        joined.filter(F.col("category").isNotNull()).groupBy("category")
        .agg(total("order_amount").alias("order_amount"))
        .orderBy(F.col("order_amount").desc(), "category")
    )


def uncategorised_revenue(transactions: DataFrame, statuses: Iterable[str] | None = PAID) -> DataFrame:
    """What ``category_revenue`` becomes where there is no product table."""
    lines = with_statuses(transactions, statuses).withColumn("category", F.lit("Unknown"))
    return lines.groupBy("category").agg(total("order_amount").alias("order_amount"))


def cohorts(transactions: DataFrame, customers: DataFrame, statuses: Iterable[str] | None = None) -> DataFrame:
    """Customers active per signup month and activity month; ``NaT`` stands for no signup date.

    The months of a customer are bits of a number, which lines are combined into before
    the shuffle: a row per customer and five years, not per customer and month. The
    months are told apart again after the signup month has been looked up, and counted
    before the next shuffle, so a cohort of any size is a row per month and task.
    """
    date = F.to_date("order_date")
    number = F.year(date) * 12 + F.month(date) - 1
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), number % MASK_MONTHS)
    active = with_statuses(transactions, statuses).groupBy("customer_id", F.floor(number / MASK_MONTHS).alias("_span")).agg(
        F.coalesce(F.bit_or(bit), F.lit(1)).alias("_months"))
    signup = customers.select("customer_id", month_label("signup_date").alias("cohort"))
    bits = F.filter(F.sequence(F.lit(0), F.lit(MASK_MONTHS - 1)), lambda bit: F.getbit("_months", bit) == 1)
    months = active.join(signup, "customer_id", "left").withColumn("_bit", F.explode(bits))
    month = F.col("_span") * MASK_MONTHS + F.col("_bit")
    label = F.format_string("%04d-%02d", F.floor(month / 12), month % 12 + 1)
    return (
        months.groupBy(F.coalesce("cohort", F.lit("NaT")).alias("cohort"),
                       F.when(F.col("_span").isNull(), "NaT").otherwise(label).alias("activity_month"))
        .agg(F.count("customer_id").alias("active_customers"))
    )


def product_performance(transactions: DataFrame, products: DataFrame,
                        statuses: Iterable[str] | None = None) -> DataFrame:
    """Revenue, units and distinct transactions per category and product name."""
    lines = with_statuses(transactions, statuses).groupBy("product_id", "transaction_id").agg(
        F.sum(money("order_amount")).alias("order_amount"), F.sum("quantity").alias("quantity"))
    named = lines.join(products.select("product_id", "category", "product_name"), "product_id", "left")
    return (
        named.filter(F.col("category").isNotNull() & F.col("product_name").isNotNull())
        .groupBy("category", "product_name")
        .agg(total("order_amount").alias("revenue"), F.sum("quantity").alias("units"),
             F.count_distinct("transaction_id").alias("orders"))
    )


def activity_totals(transactions: DataFrame) -> DataFrame:
    """Lines and revenue per month and per product, by completion, from one pass.

    Two grouping sets: the result has as many rows as there are months and
    products, not their combinations. ``by_month`` tells which set a row is from.
    """
    lines = transactions.select(
        month_start("order_date").alias("month"), "product_id", is_completed().alias("completed"),
        money("order_amount").alias("order_amount"), naive("order_date").alias("order_date"))
    month, product, completed = F.col("month"), F.col("product_id"), F.col("completed")
    return lines.groupingSets([[month, completed], [product, completed]], month, product, completed).agg(
        (F.grouping("month") == 0).alias("by_month"),
        F.count("*").alias("lines"),
        F.sum("order_amount").alias("order_amount"),
        F.min("order_date").alias("first"),
        F.max("order_date").alias("last"),
    )


def activity_span(transactions: DataFrame) -> DataFrame:
    """One row: lines, first and last date."""
    date = naive("order_date")
    return transactions.agg(F.count("*").alias("lines"), F.min(date).alias("first"), F.max(date).alias("last"))


def dataset_header(span: DataFrame, products: DataFrame, customers: DataFrame,
                   source: str = UPLOADED_SOURCE) -> DataFrame:
    """One row: where the data are from, sizes, date range, number of markets; ``span`` may hold partial rows."""
    lines = span.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("transactions"), F.min("first").alias("first"),
                     F.max("last").alias("last"))
    people = customers.agg(F.struct(F.count("*").alias("customers"), F.count_distinct("state").alias("markets")))
    return lines.select(
        F.lit(source).alias("source"),
        "transactions",
        products.agg(F.count("*")).scalar().alias("products"),
        people.scalar()["customers"].alias("customers"),
        iso_text(F.col("first")).alias("date_start"),
        iso_text(F.col("last")).alias("date_end"),
        people.scalar()["markets"].alias("markets"),
    )


def top_segment(segmented: DataFrame) -> DataFrame:
    """One row: the segment with the most customers, first by name among equals."""
    sizes = segmented.groupBy("segment").agg(F.count("*").alias("customers"))
    return sizes.agg(F.min_by("segment", F.struct(-F.col("customers"), "segment")).alias("top_segment"))


def executive_kpis(segmented: DataFrame, by_month: DataFrame) -> DataFrame:
    """One row of headline figures; an empty master gives zeros."""
    churned = F.avg(is_churned().cast("int"))

    def zero(value: Column) -> Column:
        return F.coalesce(value, F.lit(0.0))

    figures = segmented.agg(
        F.count("customer_id").alias("customers"),
        F.count_if(~is_churned()).alias("active_customers"),
        zero(total("total_revenue")).alias("revenue"),
        zero(total("total_profit")).alias("profit"),
        zero(rounded(churned * 100, 2)).alias("churn_rate"),
        zero(rounded((1 - churned) * 100, 2)).alias("retention_rate"),
        zero(rounded(exact_mean(F.col("average_order_value")), 2)).alias("average_order_value"),
        zero(rounded(exact_mean(F.col("campaign_response_rate")) * 100, 2)).alias("campaign_conversion_rate"),
        zero(rounded(exact_mean(health()), 2)).alias("customer_health_score"),
    )
    margin = F.coalesce(F.try_divide("profit", "revenue") * 100, F.lit(0.0))
    return figures.select(
        "*",
        rounded(growth(by_month).scalar(), 2).alias("revenue_growth_pct"),
        top_segment(segmented).scalar().alias("top_segment"),
        rounded(margin, 2).alias("margin_pct"),
    )


def bi_measures(valued: DataFrame) -> DataFrame:
    """One row of report measures; the order value here is revenue over orders.

    The master has one row per customer, so counting rows counts customers.
    """
    at_risk = F.count_if(is_churned())
    return valued.agg(
        total("total_revenue").alias("total_revenue"),
        total("total_profit").alias("total_profit"),
        F.count("customer_id").alias("customer_count"),
        rounded(F.try_divide(F.sum(F.col("total_revenue").cast("decimal(28,4)")).cast("double"),
                             F.sum("order_count").cast("double")), 2).alias("average_order_value"),
        at_risk.alias("at_risk_customers"),
        rounded(1 - F.try_divide(at_risk, F.count("customer_id")), 4).alias("retention_rate"),
        rounded(F.sum(F.col("predicted_clv").cast(EXACT)), 2).alias("predicted_clv"),
    )


def risk_summary(scores: DataFrame) -> DataFrame:
    """One row: customers per risk level, the share at high risk and the mean probability."""
    def level(name: str) -> Column:
        return F.count_if(F.col("risk_level") == name)

    return scores.agg(
        level("Low").alias("low"),
        level("Medium").alias("medium"),
        level("High").alias("high"),
        rounded(F.try_divide(level("High"), F.count("*")) * 100, 2).alias("high_pct"),
        rounded(exact_mean(F.col("churn_probability")), 4).alias("mean_probability"),
        F.count("*").alias("scored"),
    )


def probability_histogram(scores: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Customers per bin of equal width over 0 to 1; empty bins are left out."""
    number = F.width_bucket("churn_probability", F.lit(0.0), F.lit(1.0), F.lit(bins))
    return scores.groupBy(F.least(number, F.lit(bins)).cast("int").alias("bin")).agg(F.count("*").alias("customers"))


def market_summary(states: DataFrame) -> DataFrame:
    """One row: number of markets, the leading one and its revenue."""
    return states.agg(
        F.count("*").alias("markets"),
        F.min_by("state", F.struct(-F.col("revenue"), "state")).alias("leading_market"),
        F.max("revenue").alias("top_revenue"),
    )


def value_summary(valued: DataFrame) -> DataFrame:
    """One row over all customers with a value: how many, the largest and the exact median."""
    middle = F.lit(median(valued, "predicted_clv")).cast("double")
    return valued.agg(
        F.count("*").alias("customers_ranked"),
        rounded(F.max("predicted_clv"), 2).alias("top_clv"),
        rounded(middle, 2).alias("median_clv"),
    )


def action_summary(actions: DataFrame) -> DataFrame:
    return actions.agg(
        F.count("*").alias("actions"),
        F.count_if(F.col("priority") == "High").alias("high_priority"),
        F.coalesce(total("expected_value"), F.lit(0.0)).alias("value_represented"),
        F.count_distinct("action").alias("action_types"),
    )


def top_by(rows: DataFrame, measure: str, key: str, limit: int) -> DataFrame:
    return rows.orderBy(F.col(measure).desc(), key).limit(limit)
