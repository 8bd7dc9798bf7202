"""Joins on lines of which a third share one key: Spark splits the large partition."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from patronage.operators.rollups import product_performance
from patronage.plans.retail import product_table, purchase_lines, typed_lines

SPLITTING = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def splitting(spark):
    before = {key: spark.conf.get(key, None) for key in SPLITTING}
    for key, value in SPLITTING.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def skewed(frame) -> bool:
    frame.collect()
    return "skew=true" in frame._jdf.queryExecution().executedPlan().toString()


def test_hot_stock_code(spark, splitting):
    numbers = spark.range(60_000).repartition(8)
    code = F.when(F.col("id") % 3 == 0, "POST").otherwise(F.concat(F.lit("P"), (F.col("id") % 900).cast("string")))
    raw = numbers.select(
        F.col("id").cast("string").alias("invoice"), code.alias("stock_code"), F.lit("pen").alias("description"),
        F.lit("2").alias("quantity"), F.lit("2024-01-05").alias("invoice_date"), F.lit("1.5").alias("unit_price"),
        (F.col("id") % 50).cast("string").alias("customer_id"), F.lit("UK").alias("country"))
    lines = typed_lines(raw)
    purchases = purchase_lines(lines, product_table(lines))
    assert skewed(purchases) and purchases.count() == 60_000


def test_hot_product(spark, make, splitting):
    numbers = spark.range(60_000).repartition(8)
    product = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 900)
    lines = numbers.select(
        F.col("id").alias("transaction_id"), F.lit(1).cast("long").alias("customer_id"),
        product.cast("long").alias("product_id"), F.lit(1).alias("quantity"), F.lit(2.0).alias("order_amount"),
        F.lit(1.0).alias("cost_amount"), F.lit(0.0).alias("discount_amount"),
        F.lit("2024-01-05").cast("timestamp_ntz").alias("order_date"), F.lit("x").alias("channel"),
        F.lit("completed").alias("status"))
    products = spark.range(900).select(
        F.col("id").alias("product_id"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("product_name"),
        F.lit("c").alias("category"), F.lit(1.0).alias("unit_price"), F.lit(1.0).alias("unit_cost"))
    found = product_performance(lines, products)
    assert skewed(found)
    orders = {row["product_name"]: row["orders"] for row in found.collect()}
    assert orders.keys() == {f"p{i}" for i in range(900) if i % 3} and orders["p7"] > 20_000
