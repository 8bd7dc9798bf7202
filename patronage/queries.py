"""Every query by name, over the star-schema tables of a folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.functions.numbers import rounded
from patronage.functions.text import keyword_category
from patronage.operators import rollups
from patronage.operators.cleaning import clean_report, clean_strict, cleaning_report
from patronage.operators.loading import compare_with_ledger, file_checksums, upsert_dataset
from patronage.operators.profiling import constraint_audit, profile
from patronage.operators.segments import rfm_segments
from patronage.operators.value import (
    action_queue,
    churn_queue,
    churn_scores,
    health,
    lifetime_value_ranked,
)
from patronage.plans import retail
from patronage.plans.churn_models import (
    MASTER_COLUMNS,
    METRICS,
    SCORED_ROWS,
    TRAIN_SHARE,
    chronological_split,
    feature_table,
    heuristic_measures,
    labelled,
    note_run,
    read_runs,
    rest,
    sampled,
    score_customers,
    train_models,
)
from patronage.plans.clustering import FEATURES as CLUSTER_FEATURES
from patronage.plans.clustering import (
    Clusters,
    cluster_customers,
    group_silhouettes,
    log_features,
    standardised,
)
from patronage.plans.dashboard import HEADLINE_COLUMNS, action_master, dashboard, segmented_master, valued_master
from patronage.plans.forecast import (
    backtest,
    error_measures,
    forecast_features,
    head_and_tail,
    history,
    moving_average_forecast,
    revenue_forecast,
    revenue_series,
)
from patronage.plans.ingest import latest_version, load_files, read_ledger
from patronage.plans.master import as_document, customer_master, customer_profile, register_master_view
from patronage.plans.mart import build_mart, payload, segmented_export, write_mart
from patronage.schemas import empty_table
from patronage.session import few_partitions, staged, staged_lines, staging_folder
from patronage.sinks.files import write_csv, write_tables
from patronage.sources import star
from patronage.sources.files import load_retail, read_csv, read_raw_retail
from patronage.sources.star import star_tables

Query = Callable[[SparkSession, str], DataFrame]
TOP = 100
LEADERS = 30
TOP_MARKETS = 20
PREVIEW = 250
PROFILED_CUSTOMER = 1

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# -- master ---------------------------------------------------------------------------------------

@query
def customer_master_full(spark: SparkSession, folder: str) -> DataFrame:
    return customer_master(star_tables(spark, folder))


@query
def master_view(spark: SparkSession, folder: str) -> DataFrame:
    return register_master_view(spark, star_tables(spark, folder))


@query
def customer_profile_row(spark: SparkSession, folder: str) -> DataFrame:
    return customer_profile(star_tables(spark, folder), PROFILED_CUSTOMER)


@query
def customer_documents(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["customer_id", "name", "state", "city", "signup_date", "order_count", "last_purchase_date"]
    return as_document(customer_master(star_tables(spark, folder), columns=columns))


# -- segments -------------------------------------------------------------------------------------

@query
def rfm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return segmented_master(star_tables(spark, folder), ["name"])


@query
def segment_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.segment_rollup(segmented_master(star_tables(spark, folder), []))


@query
def segment_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.count_by(segmented_master(star_tables(spark, folder), []), "segment")


@query
def segment_score_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.count_by(segmented_master(star_tables(spark, folder), []), "segment", "rfm_score")


@query
def segment_listing(spark: SparkSession, folder: str) -> DataFrame:
    listed = segmented_master(star_tables(spark, folder), ["name"])
    return listed.select("customer_id", "name", "rfm_score", "segment").orderBy(
        F.col("rfm_score").desc(), "customer_id")


@query
def top_segment(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.top_segment(segmented_master(star_tables(spark, folder), []))


# -- value ----------------------------------------------------------------------------------------

def _valuation(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["customer_id", "name", "order_count", "average_order_value", "purchase_frequency"]
    return customer_master(star_tables(spark, folder), columns=columns)


@query
def clv_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return lifetime_value_ranked(_valuation(spark, folder)).select("customer_id", "name", "predicted_clv", "clv_rank")


def _clv_listing(spark: SparkSession, folder: str, limit: int) -> DataFrame:
    return clv_ranked(spark, folder).orderBy("clv_rank", "customer_id").limit(limit)


@query
def top_clv(spark: SparkSession, folder: str) -> DataFrame:
    return _clv_listing(spark, folder, TOP)


@query
def clv_leaders(spark: SparkSession, folder: str) -> DataFrame:
    return _clv_listing(spark, folder, LEADERS).orderBy("predicted_clv", "customer_id")


@query
def clv_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.value_summary(clv_ranked(spark, folder))


@query
def top_customers(spark: SparkSession, folder: str) -> DataFrame:
    valued = valued_master(star_tables(spark, folder), ["name", "state"])
    listed = valued.select("customer_id", "name", "state", "total_revenue", "order_count", "recency_days", "segment",
                           "predicted_clv")
    return rollups.top_by(listed, "total_revenue", "customer_id", TOP)


@query
def customer_health(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["customer_id", "recency_days", "campaign_response_rate", "avg_satisfaction"]
    master = customer_master(star_tables(spark, folder), columns=columns)
    return master.select("customer_id", rounded(health(), 4).alias("health_score"))


# -- headline figures -----------------------------------------------------------------------------

@query
def executive_kpis(spark: SparkSession, folder: str) -> DataFrame:
    tables = star_tables(spark, folder)
    by_month = rollups.monthly_revenue(tables.transactions)
    return rollups.executive_kpis(segmented_master(tables, HEADLINE_COLUMNS), by_month)


@query
def bi_measures(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.bi_measures(valued_master(star_tables(spark, folder), ["total_profit"]))


@query
def dataset_header(spark: SparkSession, folder: str) -> DataFrame:
    tables = star_tables(spark, folder)
    return rollups.dataset_header(rollups.activity_span(tables.transactions), tables.products, tables.customers)


@query
def monthly_revenue(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.labelled_months(rollups.monthly_revenue(star.transactions(spark, folder)))


@query
def monthly_revenue_all_statuses(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.labelled_months(rollups.monthly_revenue(star.transactions(spark, folder), None))


@query
def monthly_growth(spark: SparkSession, folder: str) -> DataFrame:
    by_month = rollups.monthly_revenue(star.transactions(spark, folder))
    return rollups.growth(by_month).select(rounded(F.col("growth_pct"), 2).alias("growth_pct"))


@query
def category_revenue(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.category_revenue(star.transactions(spark, folder), star.products(spark, folder))


def _markets(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["customer_id", "state", "total_revenue"]
    return rollups.geography(customer_master(star_tables(spark, folder), columns=columns))


@query
def geography(spark: SparkSession, folder: str) -> DataFrame:
    return _markets(spark, folder)


@query
def market_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.market_summary(_markets(spark, folder))


@query
def top_markets(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.top_by(_markets(spark, folder), "revenue", "state", TOP_MARKETS)


@query
def market_listing(spark: SparkSession, folder: str) -> DataFrame:
    return _markets(spark, folder).orderBy(F.col("revenue").desc(), "state")


# -- exploration ----------------------------------------------------------------------------------

@query
def demographics(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["customer_id", "gender", "total_revenue"]
    return rollups.demographics(customer_master(star_tables(spark, folder), columns=columns))


@query
def age_bands(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.age_bands(star.customers(spark, folder))


@query
def cohorts(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.cohorts(star.transactions(spark, folder), star.customers(spark, folder))


@query
def product_performance(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.product_performance(star.transactions(spark, folder), star.products(spark, folder))


# -- churn heuristics and actions -----------------------------------------------------------------

def _risk(spark: SparkSession, folder: str, formula: str) -> DataFrame:
    inputs = {"service": ["support_tickets", "campaign_response_rate"], "behavioral": ["order_count"]}[formula]
    columns = ["customer_id", "name", "recency_days", *inputs]
    return churn_scores(customer_master(star_tables(spark, folder), columns=columns), formula)


@query
def churn_service(spark: SparkSession, folder: str) -> DataFrame:
    return churn_queue(_risk(spark, folder, "service"))


@query
def churn_behavioral(spark: SparkSession, folder: str) -> DataFrame:
    return churn_queue(_risk(spark, folder, "behavioral"))


@query
def risk_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.risk_summary(_risk(spark, folder, "service"))


@query
def risk_levels(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.count_by(_risk(spark, folder, "service"), "risk_level")


@query
def churn_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.probability_histogram(_risk(spark, folder, "service"))


@query
def next_best_action(spark: SparkSession, folder: str) -> DataFrame:
    return action_master(star_tables(spark, folder))


@query
def next_best_action_wide_range(spark: SparkSession, folder: str) -> DataFrame:
    """The variant with the wider cross-sell rule and without the campaign rule."""
    return action_master(star_tables(spark, folder), narrow_range=3, campaigns=False)


@query
def action_queue_top100(spark: SparkSession, folder: str) -> DataFrame:
    return action_queue(action_master(star_tables(spark, folder))).limit(TOP)


@query
def action_queue_by_priority(spark: SparkSession, folder: str) -> DataFrame:
    return action_queue(action_master(star_tables(spark, folder)), ["Medium", "Low"])


@query
def action_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.action_summary(action_master(star_tables(spark, folder)))


@query
def action_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.count_by(action_master(star_tables(spark, folder)), "action", "priority")


# -- cleaning, profiling, loading -----------------------------------------------------------------

@query
def clean_strict_customers(spark: SparkSession, folder: str) -> DataFrame:
    return clean_strict(star.customer_feed(spark, folder), "customers", "sent")


@query
def clean_strict_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return clean_strict(star.transaction_feed(spark, folder), "transactions", "sent")


@query
def clean_report_marketing(spark: SparkSession, folder: str) -> DataFrame:
    return clean_report(star.touch_feed(spark, folder), "marketing", "sent")


@query
def upload_preview(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = clean_report(star.touch_feed(spark, folder), "marketing", "sent")
    return cleaned.orderBy("campaign_id").limit(PREVIEW)


@query
def cleaning_counts(spark: SparkSession, folder: str) -> DataFrame:
    feed = star.touch_feed(spark, folder)
    return cleaning_report(feed, staged(clean_report(feed, "marketing", "sent"), "cleaned"), "marketing")


@query
def profile_customers(spark: SparkSession, folder: str) -> DataFrame:
    return profile(star.customers(spark, folder))


@query
def profile_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return profile(star.transactions(spark, folder))


@query
def constraints(spark: SparkSession, folder: str) -> DataFrame:
    return constraint_audit(star_tables(spark, folder))


@query
def upsert_customers(spark: SparkSession, folder: str) -> DataFrame:
    batch = clean_strict(star.customer_feed(spark, folder), "customers", "sent")
    return upsert_dataset(star.customers(spark, folder), batch, "customers")


@query
def clean_written_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Untidy records written as CSV, read back and cleaned."""
    path = f"{_run_folder(spark, 'written')}/customers.csv"
    write_csv(star.written_customers(spark, folder), path)
    rows = read_csv(spark, path, ["customer_id", "name", "state", "signup_date", "is_active"])
    return clean_strict(rows, "customers", formats=["MM/dd/yyyy"])


@query
def retail_in_file_order(spark: SparkSession, folder: str) -> DataFrame:
    """Raw retail lines written as one sheet per cancellation, read back and numbered as they stand there."""
    path = _run_folder(spark, "sheets")
    raw = staged(star.raw_retail(spark, folder), "raw")
    order = ["invoice_date", "invoice", "stock_code", "customer_id", "quantity", "unit_price"]
    sheets = []
    for number, part in enumerate([raw.filter("NOT startswith(invoice, 'C')"), raw.filter("startswith(invoice, 'C')")]):
        write_csv(part.orderBy(*order), f"{path}/{number}.csv")
        sheets.append(read_csv(spark, f"{path}/{number}.csv", raw.columns, multiline=False))
    return retail.prepare(read_raw_retail(sheets)).transactions.select(
        "transaction_id", "customer_id", "quantity", "order_amount", "order_date", "status")


def _loaded(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    root = _run_folder(spark, "load")
    for name, batch in star.customer_batches(spark, folder).items():
        write_csv(batch.orderBy("customer_id").coalesce(1), f"{root}/inbox/{name}")
    return root, load_files(spark, root, "customers", f"{root}/inbox/*/*.csv").files


@query
def ingest_job(spark: SparkSession, folder: str) -> DataFrame:
    """The dataset after one run over three files that overlap."""
    root, _ = _loaded(spark, folder)
    return latest_version(spark, root, "customers").select("customer_id", "name", "email", "signup_date", "is_active")


@query
def ingest_outcome(spark: SparkSession, folder: str) -> DataFrame:
    """What became of each file of that run."""
    _, files = _loaded(spark, folder)
    return files.select(F.element_at(F.split("file_path", "/"), -2).alias("batch"), "status", "rows_loaded")


@query
def ingest_second_run(spark: SparkSession, folder: str) -> DataFrame:
    """The dataset after another run, with a file of some known and some new customers and no e-mail addresses."""
    root, _ = _loaded(spark, folder)
    write_csv(star.later_customers(spark, folder).coalesce(1), f"{root}/inbox/d")
    load_files(spark, root, "customers", f"{root}/inbox/*/*.csv")
    return latest_version(spark, root, "customers").select("customer_id", "name", "email", "signup_date", "is_active")


@query
def ingest_counts(spark: SparkSession, folder: str) -> DataFrame:
    """What the load counted while it wrote each file, from the reports in the ledger."""
    root, _ = _loaded(spark, folder)
    counts = F.from_json(F.get_json_object("quality_report", "$.counts"), "map<string,bigint>")
    return read_ledger(spark, root).select("row_count", F.explode(counts).alias("metric", "value"))


@query
def text_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as uploads: the checksum of each, the batch it belongs to, and whether its text came before.

    Texts of the first source count as loaded earlier.
    """
    checksum = F.sha2("text", 256)
    texts = star.documents(spark, folder).filter("text IS NOT NULL").select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("file_name"), checksum.alias("checksum"), "source")
    first = texts.agg(F.min("source")).scalar()
    ledger = texts.filter(F.col("source") == first).groupBy("checksum").agg(F.count("*").alias("row_count")).select(
        "checksum", F.substring("checksum", 33, 32).alias("batch_id"), "row_count")
    files = texts.select("file_name", F.col("file_name").alias("file_path"), "checksum")
    return compare_with_ledger(files, ledger).drop("file_path")


@query
def load_ledger(spark: SparkSession, folder: str) -> DataFrame:
    files = file_checksums(spark, f"{folder}/*.parquet")
    compared = compare_with_ledger(files, empty_table(spark, "ingestion_batches"))
    return compared.select("file_name", "checksum", "batch_id", "status")


@query
def keyword_categories(spark: SparkSession, folder: str) -> DataFrame:
    return star.documents(spark, folder).select("doc_id", keyword_category(F.col("text")).alias("category"))


# -- retail preparation ---------------------------------------------------------------------------

def _typed_retail(spark: SparkSession, folder: str) -> DataFrame:
    return retail.typed_lines(star.raw_retail(spark, folder))


def _purchases(spark: SparkSession, folder: str) -> DataFrame:
    lines = staged_lines(_typed_retail(spark, folder), "lines")
    return retail.purchase_lines(lines, retail.product_table(lines))


@query
def retail_products(spark: SparkSession, folder: str) -> DataFrame:
    return retail.product_table(_typed_retail(spark, folder)).drop("stock_code")


@query
def retail_customers(spark: SparkSession, folder: str) -> DataFrame:
    return retail.customer_table(_typed_retail(spark, folder))


@query
def retail_transactions(spark: SparkSession, folder: str) -> DataFrame:
    return retail.transaction_table(_purchases(spark, folder))


@query
def monthly_summary(spark: SparkSession, folder: str) -> DataFrame:
    return retail.monthly_summary(_purchases(spark, folder))


@query
def retail_manifest(spark: SparkSession, folder: str) -> DataFrame:
    prepared = retail.prepare(star.raw_retail(spark, folder))._asdict()
    return write_tables(prepared, _run_folder(spark, "retail"))


# -- BI mart --------------------------------------------------------------------------------------

@query
def mart_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Writes the mart to the shared folder and counts what is in it."""
    return write_mart(build_mart(star_tables(spark, folder)), _run_folder(spark, "mart"))


@query
def mart_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Customers read back from the mart's file."""
    mart = build_mart(star_tables(spark, folder))
    path = _run_folder(spark, "mart")
    write_csv(mart.master, path + "/customers.csv")
    back = read_csv(spark, path + "/customers.csv", mart.master.columns)
    return back.select(F.col("customer_id").cast("long").alias("customer_id"), "name", "segment",
                       F.col("clv_rank").cast("int").alias("clv_rank"))


@query
def payload_months(spark: SparkSession, folder: str) -> DataFrame:
    """The months inside the mart's document."""
    document = payload(build_mart(star_tables(spark, folder)))
    kind = "monthly array<struct<month:string,revenue:double>>"
    return document.select(F.inline(F.from_json("value", kind)["monthly"]))


@query
def payload_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The segments inside the mart's document."""
    document = payload(build_mart(star_tables(spark, folder)))
    kind = "segments array<struct<segment:string,customers:bigint,revenue:double>>"
    return document.select(F.inline(F.from_json("value", kind)["segments"]))


@query
def payload_members(spark: SparkSession, folder: str) -> DataFrame:
    """The other members of the mart's document: a row per field, or per entry with its place."""
    kind = """dataset map<string,string>, kpis map<string,string>,
        geography array<struct<state:string,customers:bigint,revenue:double>>,
        categories array<struct<category:string,order_amount:double>>,
        recommendations array<struct<customer_id:bigint,action:string,reason:string,expected_value:double>>,
        data_dictionary array<array<string>>"""
    whole = F.from_json("value", kind)
    parsed = staged(payload(build_mart(star_tables(spark, folder))).select(whole.alias("d")), "document").select("d.*")
    none, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")

    def entries(name: str, label: str, detail: Column, count: Column, amount: Column) -> DataFrame:
        found = parsed.select(F.posexplode(name).alias("place", "e"))
        return found.select(F.lit(name).alias("member"), "place", F.col(label).alias("label"), detail.alias("detail"),
                            count.alias("number"), amount.alias("amount"))

    def fields(name: str) -> DataFrame:
        """Whole fields as text, numbers as amounts."""
        found = parsed.select(F.explode(name).alias("label", "text"))
        amount = F.expr("try_cast(text AS DOUBLE)")
        return found.select(F.lit(name).alias("member"), F.lit(0).alias("place"), "label",
                            F.when(amount.isNull(), F.col("text")).alias("detail"), number.alias("number"),
                            amount.alias("amount"))

    members = [
        fields("dataset"), fields("kpis"),
        entries("geography", "e.state", none, F.col("e.customers"), F.col("e.revenue")),
        entries("categories", "e.category", none, number, F.col("e.order_amount")),
        entries("recommendations", "e.action", F.col("e.reason"), F.col("e.customer_id"), F.col("e.expected_value")),
        entries("data_dictionary", "e", F.col("e")[1], number, F.lit(None).cast("double")).withColumn(
            "label", F.col("label")[0]),
    ]
    return reduce(DataFrame.unionByName, members)


@query
def segmented_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The segmented master read back from its file."""
    path = f"{_run_folder(spark, 'segmented')}/master.csv"
    tables = star_tables(spark, folder)
    segmented_export(tables, path)
    back = read_csv(spark, path, rfm_segments(customer_master(tables)).columns)
    whole = ["customer_id", "order_count", "recency_days", "rfm_score"]
    return back.select(*[F.col(name).cast("long").alias(name) for name in whole], "name", "segment",
                       F.col("total_revenue").cast("double").alias("total_revenue"))


@query
def stored_tables_months(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly revenue of tables written as Parquet and read back."""
    path, tables = _run_folder(spark, "tables"), star_tables(spark, folder)
    write_tables({name: getattr(tables, name) for name in ("customers", "products", "transactions")}, path)
    return rollups.labelled_months(rollups.monthly_revenue(load_retail(spark, path).transactions))


def _dashboard_member(name: str) -> Query:
    return lambda spark, folder: dashboard(star_tables(spark, folder))[name]


#: Members of the dashboard bundle, by its own plan, beside the queries that compute the same alone.
DASHBOARD_TWINS = {"dataset": "dataset_header", "kpis": "executive_kpis", "segments": "segment_rollup",
                   "geography": "geography", "monthly_revenue": "monthly_revenue",
                   "category_revenue": "category_revenue"}
QUERIES.update({f"dashboard_{name}": _dashboard_member(name) for name in DASHBOARD_TWINS})


@query
def mart_payload(spark: SparkSession, folder: str) -> DataFrame:
    return payload(build_mart(star_tables(spark, folder)))


# -- models ---------------------------------------------------------------------------------------

@query
def clusters(spark: SparkSession, folder: str) -> DataFrame:
    return _clusters(spark, folder).assignments


@query
def cluster_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = _clusters(spark, folder)
    return found.assignments.groupBy("cluster").agg(F.count("*").alias("customers")).withColumn(
        "silhouette", F.lit(found.silhouette).cast("double"))


@query
def cluster_features(spark: SparkSession, folder: str) -> DataFrame:
    """What the clusters are made from: standardised logarithms."""
    columns = ["customer_id", "name", *CLUSTER_FEATURES]
    rows = staged(log_features(customer_master(star_tables(spark, folder), columns=columns)), "clustering")
    values = vector_to_array("features")
    return standardised(rows).select("customer_id", *[
        rounded(values[place], 5).alias(name) for place, name in enumerate(CLUSTER_FEATURES)])


def _clusters(spark: SparkSession, folder: str) -> Clusters:
    columns = ["customer_id", "name", *CLUSTER_FEATURES]
    return cluster_customers(customer_master(star_tables(spark, folder), columns=columns))


@query
def churn_label_split(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["customer_id", "signup_date", "recency_days"]
    data = labelled(customer_master(star_tables(spark, folder), columns=columns))
    return chronological_split(data).select("customer_id", "signup_date", "churned", "part")


@query
def churn_training_check(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["customer_id", "order_count", "recency_days"]
    data = labelled(customer_master(star_tables(spark, folder), columns=columns))
    return data.groupBy("churned").agg(F.count("*").alias("customers"),
                                       F.count_if(F.col("order_count") > 0).alias("buyers"))


@query
def churn_features(spark: SparkSession, folder: str) -> DataFrame:
    """What the models learn from: imputed and scaled numbers and the codes of texts."""
    return feature_table(customer_master(star_tables(spark, folder), columns=MASTER_COLUMNS))


def _heuristics(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["customer_id", "name", "recency_days", "support_tickets", "campaign_response_rate", "order_count"]
    master = staged(customer_master(star_tables(spark, folder), columns=columns), "scored")
    return heuristic_measures({name: churn_scores(master, name) for name in ("service", "behavioral")}, labelled(master))


@query
def churn_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """All measures of both heuristics against the label, and which of them is selected."""
    return _heuristics(spark, folder)


@query
def model_runs(spark: SparkSession, folder: str) -> DataFrame:
    """A run over both heuristics, noted in the ledger and read back."""
    path = _run_folder(spark, "runs")
    found = _heuristics(spark, folder).collect()
    best = next(row["model_name"] for row in found if row["selected"])
    note_run(spark, path, str(uuid.uuid4()), best, {row["model_name"]: {name: row[name] for name in METRICS} for row in found})
    well_formed = F.col("run_id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$") & F.col("version").rlike("^[0-9]{14}$")
    return read_runs(spark, path).select("model_type", "selected_model", "model_name", "metric", "value",
                                         well_formed.alias("well_formed"))


@query
def random_split(spark: SparkSession, folder: str) -> DataFrame:
    """The split of customers that the models fall back to: a drawn part, and the rows that are not in it."""
    people = star.customers(spark, folder).select("customer_id", "state")
    train = sampled(people, "customer_id", TRAIN_SHARE)
    return train.withColumn("part", F.lit("train")).unionByName(
        rest(people, train, "customer_id").withColumn("part", F.lit("test")))


@query
def segment_silhouette(spark: SparkSession, folder: str) -> DataFrame:
    """How well the segments separate in the measures that clusters are made from."""
    tables = star_tables(spark, folder)
    columns = ["customer_id", "name", *CLUSTER_FEATURES]
    rows = staged(log_features(customer_master(tables, columns=columns)), "clustering")
    return group_silhouettes(rows, segmented_master(tables, []), "segment")


@query
def churn_models(spark: SparkSession, folder: str) -> DataFrame:
    master = customer_master(star_tables(spark, folder), columns=MASTER_COLUMNS)
    return train_models(master, _run_folder(spark)).metrics.drop("run_id")


@query
def churn_scored(spark: SparkSession, folder: str) -> DataFrame:
    """Trains all candidates, saves the best and scores everybody with what was saved."""
    master = staged(customer_master(star_tables(spark, folder), columns=MASTER_COLUMNS), "scored")
    run = train_models(master, _run_folder(spark))
    return churn_queue(score_customers(few_partitions(master, SCORED_ROWS), run.path))


def _run_folder(spark: SparkSession, label: str = "churn") -> str:
    return f"{staging_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _state_series(spark: SparkSession, folder: str) -> DataFrame:
    return revenue_series(star.transactions(spark, folder), star.customers(spark, folder))


def _total_series(spark: SparkSession, folder: str) -> DataFrame:
    return revenue_series(star.transactions(spark, folder))


@query
def total_history(spark: SparkSession, folder: str) -> DataFrame:
    return history(_total_series(spark, folder))


@query
def total_forecast_features(spark: SparkSession, folder: str) -> DataFrame:
    return head_and_tail(forecast_features(_total_series(spark, folder)))


@query
def total_moving_average(spark: SparkSession, folder: str) -> DataFrame:
    return moving_average_forecast(_total_series(spark, folder))


@query
def total_forecast_boosted(spark: SparkSession, folder: str) -> DataFrame:
    return revenue_forecast(_total_series(spark, folder)).forecast


@query
def naive_forecast_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of taking the month before, on the last quarter of every series."""
    rows = head_and_tail(forecast_features(_state_series(spark, folder))).filter(F.col("part") == "tail")
    return error_measures(rows.withColumn("prediction", F.col("lag_1")), "previous_month")


@query
def revenue_history(spark: SparkSession, folder: str) -> DataFrame:
    return history(_state_series(spark, folder))


@query
def forecast_features_by_state(spark: SparkSession, folder: str) -> DataFrame:
    return head_and_tail(forecast_features(_state_series(spark, folder)))


@query
def forecast_moving_average(spark: SparkSession, folder: str) -> DataFrame:
    return moving_average_forecast(_state_series(spark, folder))


@query
def forecast_boosted(spark: SparkSession, folder: str) -> DataFrame:
    return revenue_forecast(_state_series(spark, folder)).forecast


@query
def forecast_errors(spark: SparkSession, folder: str) -> DataFrame:
    return backtest(staged(head_and_tail(forecast_features(_state_series(spark, folder))), "forecast"))
