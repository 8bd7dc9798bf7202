"""Schemas, required columns and conversions of the domain tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "customers": """customer_id BIGINT, name STRING, age INT, gender STRING, city STRING, state STRING,
        signup_date DATE, email STRING, is_active BOOLEAN, created_at TIMESTAMP_NTZ""",
    "products": """product_id BIGINT, product_name STRING, category STRING, unit_price DOUBLE, unit_cost DOUBLE""",
    "transactions": """transaction_id BIGINT, customer_id BIGINT, product_id BIGINT, quantity INT,
        order_amount DOUBLE, cost_amount DOUBLE, discount_amount DOUBLE, order_date TIMESTAMP_NTZ,
        channel STRING, status STRING""",
    "marketing": """campaign_id BIGINT, customer_id BIGINT, campaign_name STRING, campaign_response BOOLEAN,
        channel STRING, campaign_cost DOUBLE, touched_at TIMESTAMP_NTZ""",
    "support": """ticket_id BIGINT, customer_id BIGINT, issue_type STRING, resolution_time DOUBLE,
        ticket_status STRING, satisfaction_score DOUBLE, opened_at TIMESTAMP_NTZ, closed_at TIMESTAMP_NTZ""",
    "ingestion_batches": """batch_id STRING, dataset_type STRING, file_name STRING, checksum STRING,
        row_count BIGINT, status STRING, quality_report STRING, created_at TIMESTAMP_NTZ""",
    "model_runs": """run_id STRING, model_type STRING, model_name STRING, version STRING,
        metrics_json STRING, artifact_path STRING, trained_at TIMESTAMP_NTZ""",
}

# Columns an upload must bring, the first one being the key.
REQUIRED = {
    "customers": ["customer_id", "name", "signup_date"],
    "products": ["product_id", "product_name", "category", "unit_price", "unit_cost"],
    "transactions": ["transaction_id", "customer_id", "order_amount", "order_date"],
    "marketing": ["campaign_id", "customer_id", "touched_at"],
    "support": ["ticket_id", "customer_id", "opened_at"],
}

# Columns read as dates, moments or booleans.
DATES = {"customers": ["signup_date"]}
MOMENTS = {
    "customers": ["created_at"],
    "transactions": ["order_date"],
    "marketing": ["touched_at"],
    "support": ["opened_at", "closed_at"],
}
BOOLEANS = {"customers": ["is_active"], "marketing": ["campaign_response"]}
TITLES = ["name", "city", "state", "product_name", "category"]
STRICT_MONEY = ["order_amount", "cost_amount", "discount_amount", "unit_price", "unit_cost", "campaign_cost"]
REPORT_NUMBERS = ["order_amount", "unit_price", "unit_cost", "campaign_cost", "resolution_time"]

# What a missing cell of a new row becomes.
DEFAULTS = {
    "customers": {"is_active": True},
    "transactions": {"quantity": 1, "cost_amount": 0.0, "discount_amount": 0.0, "status": "completed"},
    "marketing": {"campaign_response": False, "campaign_cost": 0.0},
    "support": {"ticket_status": "closed"},
    "products": {},
}

# Columns of the raw retail sheets, by position.
RAW_RETAIL = ["invoice", "stock_code", "description", "quantity", "invoice_date", "unit_price",
              "customer_id", "country"]


class Tables(NamedTuple):
    """The five business tables every analysis starts from."""

    customers: DataFrame
    products: DataFrame
    transactions: DataFrame
    marketing: DataFrame
    support: DataFrame


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    """A table without rows but with all columns, for sources that do not exist."""
    return spark.createDataFrame([], SCHEMAS[name])
