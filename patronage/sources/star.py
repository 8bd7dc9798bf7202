"""The sales star schema (orders, order lines, parts, customers, events) as domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.functions.numbers import money
from patronage.schemas import RAW_RETAIL, Tables

CENTS = "decimal(12,2)"  # prices have two decimals; products with a share still fit a long

STAR_SCHEMAS = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": """o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,
        o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING""",
    "lineitem": """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,
        l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,
        l_shipdate TIMESTAMP_NTZ""",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
}


def star_tables(spark: SparkSession, folder: str) -> Tables:
    return Tables(
        customers=customers(spark, folder),
        products=products(spark, folder),
        transactions=transactions(spark, folder),
        marketing=marketing(spark, folder),
        support=support(spark, folder),
    )


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A declared schema saves the job that would read it from the files."""
    return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    first = _read(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").alias("first_order"))
    nation = _read(spark, folder, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    key = F.col("c_custkey")
    signup = F.coalesce(F.col("first_order").cast("date"), F.lit("1995-01-01").cast("date"))
    return (
        _read(spark, folder, "customer").join(nation, "c_nationkey", "left").join(first, "c_custkey", "left")
        .select(
            key.alias("customer_id"),
            F.col("c_name").alias("name"),
            F.when(key % 17 != 0, (18 + key % 60).cast("int")).alias("age"),
            F.when(key % 10 != 9, F.element_at(F.array(F.lit("Female"), F.lit("Male"), F.lit("Non-binary")),
                                               (key % 3 + 1).cast("int"))).alias("gender"),
            F.lit(None).cast("string").alias("city"),
            F.col("n_name").alias("state"),
            signup.alias("signup_date"),
            F.lit(None).cast("string").alias("email"),
            F.lit(True).alias("is_active"),
            signup.cast("timestamp_ntz").alias("created_at"),
        )
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    price = money("p_retailprice")
    return _read(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("unit_price"),
        F.round(price * F.lit("0.65").cast("decimal(3,2)"), 2).cast("double").alias("unit_cost"),
    )


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = _read(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return lines.join(_read(spark, folder, "orders"), "o_orderkey")


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    amount = F.col("l_extendedprice").cast(CENTS)
    cost = F.round(amount * F.lit("0.65").cast("decimal(3,2)"), 2)
    discount = F.round(amount * F.col("l_discount").cast("decimal(4,2)"), 2)
    return _lines(spark, folder).select(
        (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("int").alias("quantity"),
        money(amount).alias("order_amount"),
        money(cost).alias("cost_amount"),
        money(discount).alias("discount_amount"),
        F.col("o_orderdate").alias("order_date"),
        F.col("o_orderpriority").alias("channel"),
        F.when(F.col("l_returnflag") == "R", "cancelled").otherwise("completed").alias("status"),
    )


def marketing(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    return _read(spark, folder, "events").filter(kind.isin("click", "view", "purchase")).select(
        F.col("event_id").alias("campaign_id"),
        F.col("user_id").alias("customer_id"),
        F.lit(None).cast("string").alias("campaign_name"),
        (kind == "purchase").alias("campaign_response"),
        kind.alias("channel"),
        F.col("value").alias("campaign_cost"),
        F.col("ts").alias("touched_at"),
    )


def support(spark: SparkSession, folder: str) -> DataFrame:
    score = F.get_json_object("props", "$.k").cast("double")
    return _read(spark, folder, "events").filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("ticket_id"),
        F.col("user_id").alias("customer_id"),
        F.col("event_type").alias("issue_type"),
        F.col("value").alias("resolution_time"),
        F.lit("closed").alias("ticket_status"),
        (1 + 4 * score / 99).alias("satisfaction_score"),
        F.col("ts").alias("opened_at"),
        F.lit(None).cast("timestamp_ntz").alias("closed_at"),
    )


def raw_retail(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as the untyped text rows of a retailer's sheet.

    The country is joined to the orders, so that lines are not moved by customer.
    """
    returned = F.col("l_returnflag") == "R"
    quantity = F.col("l_quantity").cast("int")
    part = _read(spark, folder, "part").withColumnRenamed("p_partkey", "l_partkey")
    nation = _read(spark, folder, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    country = _read(spark, folder, "customer").withColumnRenamed("c_custkey", "o_custkey").join(
        nation, "c_nationkey", "left")
    price = F.round(F.try_divide("l_extendedprice", "l_quantity").cast("decimal(18,8)"), 2)
    orders = _read(spark, folder, "orders").join(country, "o_custkey", "left")
    lines = _read(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey").join(orders, "o_orderkey")
    return lines.join(part, "l_partkey", "left").select(
        F.concat(F.when(returned, "C").otherwise(""), F.col("o_orderkey").cast("string")),
        F.concat(F.lit("P"), F.lpad(F.col("l_partkey").cast("string"), 6, "0")),
        F.col("p_name"),
        F.when(returned, -quantity).otherwise(quantity).cast("string"),
        F.col("o_orderdate").cast("string"),
        price.cast("string"),
        F.col("o_custkey").cast("string"),
        F.col("n_name"),
    ).toDF(*RAW_RETAIL)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "documents")


def customer_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Untidy customer records, one sent with every order; the order key tells which came last."""
    nation = _read(spark, folder, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    order, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    gender = F.array(F.lit("m"), F.lit("F "), F.lit(" female"), F.lit("NON-binary"))
    return (
        _read(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
        .join(_read(spark, folder, "customer"), "c_custkey").join(nation, "c_nationkey")
        .select(
            F.col("c_custkey").cast("string").alias(" Customer ID "),
            F.concat(F.lit("  o'brien "), F.lower("c_name"), F.lit(" x2y ")).alias("NAME"),
            (10 + (order + F.col("c_custkey")) % 110).cast("string").alias("Age"),
            F.get(gender, (order % 5).cast("int")).alias("Gender"),
            F.lower("n_name").alias("State"),
            F.col("o_orderdate").cast("date").cast("string").alias("Signup  Date"),
            F.when(priority == "1-URGENT", "Yes").when(priority == "2-HIGH", " TRUE ")
            .when(priority == "3-MEDIUM", "0").when(priority == "5-LOW", "y").alias("Is Active"),
            order.alias("sent"),
        )
    )


def transaction_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Untidy order lines with repeated ids; ``sent`` is unique but for identical lines."""
    status = F.col("l_linestatus")
    return _lines(spark, folder).select(
        (F.col("o_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("Transaction_ID"),
        F.col("o_custkey").cast("string").alias("Customer_ID"),
        F.col("l_partkey").cast("string").alias("Product_ID"),
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("-"), money("l_extendedprice").cast("string")))
        .otherwise(money("l_extendedprice").cast("string")).alias("Order_Amount"),
        F.when(F.col("l_discount") == 0, "n/a")
        .otherwise(F.col("l_discount").cast("decimal(4,2)").cast("string")).alias("Discount_Amount"),
        F.col("o_orderdate").cast("string").alias("Order_Date"),
        F.when(status == "O", "Pending").otherwise("completed").alias("Status"),
        F.struct("l_shipdate", "l_partkey", "l_extendedprice", "l_discount", "l_returnflag",
                 "l_linestatus").alias("sent"),
    )


def touch_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Marketing touches as text; error events carry a payload where the date should be."""
    failed = F.col("event_type") == "error"
    return _read(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("Campaign ID"),
        F.when(F.col("event_type") != "view", F.col("user_id").cast("string")).alias("Customer ID"),
        F.when(failed, F.col("props")).otherwise(F.col("ts").cast("string")).alias("Touched At"),
        F.when(failed, "unknown").otherwise(money("value").cast("string"))
        .alias("Campaign Cost"),
        F.col("event_id").alias("sent"),
    )


def written_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customer records with what people type: quotes, line breaks, stray white space, texts for missing values."""
    key = F.col("c_custkey")
    nation = _read(spark, folder, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    name = (F.when(key % 7 == 0, F.concat(F.lit('ann "q" '), F.lower("c_name")))
            .when(key % 7 == 1, F.concat(F.lit("two\nlines, "), F.lower("c_name"))).otherwise(F.col("c_name")))
    state = F.when(key % 11 == 0, "NA").when(key % 11 == 1, "nan").otherwise(
        F.concat(F.lit("\t"), F.lower("n_name"), F.lit("\u00a0")))
    return _read(spark, folder, "customer").join(nation, "c_nationkey").select(
        F.when(key % 2 == 0, F.concat(key.cast("string"), F.lit(".0"))).otherwise(key.cast("string")).alias("customer_id"),
        name.alias("name"), state.alias("state"),
        F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), (key % 1000).cast("int")), "MM/dd/yyyy").alias("signup_date"),
        F.when(key % 3 == 0, "NaN").otherwise("y").alias("is_active"),
    )


def customer_batches(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Three files to load: every second customer, every third with a new name, and the second file again."""
    key = F.col("c_custkey")
    people = _read(spark, folder, "customer").select(key.alias("customer_id"), F.col("c_name").alias("name"),
                                                     F.lit("2020-02-03").alias("signup_date"))
    even = people.filter("customer_id % 2 = 0").withColumn("email", F.concat("customer_id", F.lit("@example.com")))
    third = people.filter("customer_id % 3 = 0").withColumn("name", F.concat(F.lit("new "), F.lower("name")))
    return {"a": even, "b": third, "c": third}


def later_customers(spark: SparkSession, folder: str) -> DataFrame:
    """A file that comes later: every fifth customer, capitalised otherwise, of some the second time in the file."""
    people = _read(spark, folder, "customer").filter("c_custkey % 5 = 0").select(
        F.col("c_custkey").alias("customer_id"), F.lower("c_name").alias("name"), F.lit("2021-07-08").alias("signup_date"))
    twice = people.filter("customer_id % 2 = 0").withColumn("name", F.lit("first try"))
    return (twice.withColumn("turn", F.lit(0)).unionByName(people.withColumn("turn", F.lit(1)))
            .orderBy("turn", "customer_id").drop("turn"))
