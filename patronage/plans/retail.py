"""Raw retail lines to customers, products, transactions and a monthly summary."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.functions.dates import parsed_moment
from patronage.functions.numbers import money, number
from patronage.functions.text import customer_label, keyword_category, stripped, tidy_title
from patronage.operators.cleaning import whole
from patronage.operators.ranking import file_order_number, global_row_number, numbered_blocks
from patronage.operators.rollups import monthly
from patronage.session import LINE, staged, staged_lines
from patronage.sources.files import SEQUENCE

COST_SHARE = "0.65"
CHANNEL = "Online"
UNKNOWN = "Unknown"
#: What a transaction is made from, besides its number.
PURCHASE = ["customer_id", "product_id", "invoice_date", "quantity", "unit_price", "is_cancelled"]


class Prepared(NamedTuple):
    customers: DataFrame
    products: DataFrame
    transactions: DataFrame
    monthly_summary: DataFrame


def typed_lines(raw: DataFrame, formats: Sequence[str] = ()) -> DataFrame:
    """Trimmed texts, parsed dates and numbers, and the cancellation flag."""
    lines = raw.withColumns({
        "invoice": stripped(F.col("invoice")),
        "stock_code": stripped(F.col("stock_code")),
        "description": tidy_title(F.col("description")),
        "invoice_date": parsed_moment(F.col("invoice_date"), formats),
        "customer_id": whole(F.col("customer_id"), "bigint"),
        "quantity": number(F.col("quantity")),
        "unit_price": number(F.col("unit_price")),
        "country": stripped(F.col("country")),
    })
    cancelled = F.upper("invoice").startswith("C") | (F.col("quantity") < 0)
    return lines.withColumn("is_cancelled", F.coalesce(cancelled, F.lit(False)))


def prepare(raw: DataFrame, formats: Sequence[str] = (), order: Sequence[str] = ()) -> Prepared:
    """All four tables; ``order`` names the columns that give the order of the raw lines.

    Lines that bring their place in the source (``ingest_seq``) are numbered by it;
    without either, by date, invoice, code, customer, quantity and price. The raw text
    is parsed once; the typed lines are stored for the tables made from them.
    """
    order = list(order) or [name for name in raw.columns if name == SEQUENCE]
    lines = staged_lines(typed_lines(raw, formats), "lines")
    products = product_table(lines)
    purchases = purchase_lines(lines, products)
    ordered = purchase_lines(numbered_blocks(lines, SEQUENCE), products) if order == [SEQUENCE] else purchases
    return Prepared(
        customers=customer_table(lines),
        products=products.drop("stock_code"),
        transactions=transaction_table(ordered, order),
        monthly_summary=monthly_summary(purchases),
    )


def product_table(lines: DataFrame) -> DataFrame:
    """Latest description and price per stock code, numbered by code.

    Undated lines count as the latest. Equal dates are decided by invoice, price
    and description.
    """
    source = lines.filter(
        F.col("stock_code").isNotNull() & F.col("description").isNotNull() & (F.col("unit_price") > 0))
    newest = F.max(F.struct(F.col("invoice_date").isNull().alias("undated"), "invoice_date", "invoice",
                            "unit_price", "description"))
    latest = source.groupBy("stock_code").agg(newest.alias("l")).select("stock_code", "l.unit_price", "l.description")
    numbered = global_row_number(latest, ["stock_code"], "product_id")
    return numbered.select(
        "stock_code",
        "product_id",
        F.col("description").alias("product_name"),
        keyword_category(F.col("description")).alias("category"),
        "unit_price",
        F.round(money("unit_price") * F.lit(COST_SHARE).cast("decimal(3,2)"), 2).cast("double").alias("unit_cost"),
    )


def purchase_lines(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines of known customers and products with a price and a quantity; returns keep a positive amount."""
    valid = lines.filter(
        F.col("customer_id").isNotNull() & F.col("invoice_date").isNotNull()
        & (F.col("quantity") != 0) & (F.col("unit_price") > 0))
    return with_amounts(valid.join(products.select("stock_code", "product_id"), "stock_code"))


def with_amounts(purchases: DataFrame) -> DataFrame:
    """Units and amount, both without a sign."""
    units = F.abs("quantity").cast("int")
    amount = money(F.round(units * money("unit_price"), 2))
    return purchases.withColumn("quantity_abs", units).withColumn("order_amount", amount)


def transaction_table(purchases: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """Numbered transactions, in file order if that is the order asked for, else sorted.

    In a sort the place of a stored line tells copies apart, however many there are.
    Products are numbered by their code, so they sort alike. Only what a transaction is
    made from is moved and stored; lines in file order are joined once and then read twice.
    """
    keys = list(order) or ["invoice_date", "invoice", "product_id", "customer_id", "quantity", "unit_price"]
    if keys == [SEQUENCE]:
        numbered = file_order_number(staged(purchases.select(*PURCHASE, SEQUENCE), "purchases"), SEQUENCE,
                                     "transaction_id")
    else:
        keys += [LINE] if LINE in purchases.columns else []
        narrow = purchases.select(*dict.fromkeys([*PURCHASE, *keys]))
        numbered = global_row_number(narrow, keys, "transaction_id", PURCHASE)
    numbered = with_amounts(numbered)
    cost = F.round(F.col("order_amount") * F.lit(COST_SHARE).cast("decimal(3,2)"), 2)
    return numbered.select(
        "transaction_id",
        "customer_id",
        "product_id",
        F.col("quantity_abs").alias("quantity"),
        F.col("order_amount").cast("double").alias("order_amount"),
        cost.cast("double").alias("cost_amount"),
        F.lit(0.0).alias("discount_amount"),
        F.col("invoice_date").alias("order_date"),
        F.lit(CHANNEL).alias("channel"),
        F.when(F.col("is_cancelled"), "cancelled").otherwise("completed").alias("status"),
    )


def customer_table(lines: DataFrame) -> DataFrame:
    """One row per customer seen with a date; the most frequent country stands as state."""
    seen = lines.filter(F.col("customer_id").isNotNull() & F.col("invoice_date").isNotNull())
    by_country = seen.groupBy("customer_id", "country").agg(
        F.count("*").alias("n"), F.min("invoice_date").alias("first"))
    # countries of a customer are few; the smallest name wins among equally frequent ones
    modal = F.min_by("country", F.struct(F.col("country").isNull().alias("unknown"), -F.col("n"), "country"))
    per_customer = by_country.groupBy("customer_id").agg(modal.alias("country"), F.min("first").alias("first"))
    return per_customer.select(
        "customer_id",
        customer_label(F.col("customer_id")).alias("name"),
        F.lit(None).cast("int").alias("age"),
        F.lit(UNKNOWN).alias("gender"),
        F.lit(None).cast("string").alias("city"),
        F.coalesce("country", F.lit(UNKNOWN)).alias("state"),
        F.col("first").cast("date").alias("signup_date"),
        F.lit(None).cast("string").alias("email"),
        F.lit(True).alias("is_active"),
        F.col("first").alias("created_at"),
    )


def monthly_summary(purchases: DataFrame) -> DataFrame:
    """Revenue, distinct invoices and units of completed lines per month, gaps filled with 0."""
    months = monthly(
        purchases.filter(~F.col("is_cancelled")),
        {"revenue": F.sum("order_amount"), "orders": F.count_distinct("invoice"), "units": F.sum("quantity_abs")},
        date="invoice_date",
    )
    return months.select(F.col("month").alias("invoice_date"), F.col("revenue").cast("double").alias("revenue"),
                         "orders", "units")
