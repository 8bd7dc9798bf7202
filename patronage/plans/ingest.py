"""The load job: find new files, clean them, upsert them, and note them in the ledger."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from patronage.operators.cleaning import Cleaned, cleaned_and_counted
from patronage.operators.loading import (
    allowed_columns,
    compare_with_ledger,
    file_checksums,
    merged_batches,
    new_files,
    upsert_brought,
)
from patronage.operators.profiling import profile
from patronage.schemas import DEFAULTS, SCHEMAS, empty_table
from patronage.session import at_once, path_exists, staged
from patronage.sinks import buckets
from patronage.sources.files import cast_to, csv_header, read_csv, read_parquet


class Loaded(NamedTuple):
    """Outcome per file with rows and quality report, and the folder of the dataset (``None`` if nothing changed)."""

    files: DataFrame
    version: str | None


def last_batch(spark: SparkSession, root: str, dataset: str) -> str | None:
    """The last completed batch of a dataset, which names its version; None before the first."""
    ledger = read_ledger(spark, root)
    return ledger.filter(F.col("dataset_type") == dataset).agg(F.max_by("batch_id", "created_at")).first()[0]


def latest_version(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """The dataset as of the last completed ledger entry; empty before the first."""
    version = last_batch(spark, root, dataset)
    if version is None:
        return empty_table(spark, dataset)
    folder = f"{root}/{dataset}"
    rows = buckets.read_buckets(spark, folder, buckets.read_layout(spark, folder, version))
    return empty_table(spark, dataset) if rows is None else cast_to(rows, dataset)


def read_ledger(spark: SparkSession, root: str) -> DataFrame:
    """The ledger; it has no rows until the first batch is noted."""
    path = f"{root}/ingestion_batches"
    if not path_exists(spark, path):
        return empty_table(spark, "ingestion_batches")
    return spark.read.schema(SCHEMAS["ingestion_batches"]).parquet(path)


def load_files(spark: SparkSession, root: str, dataset: str, path: str, formats: Sequence[str] = (),
               multiline: bool = True, bucket_count: int = buckets.BUCKETS) -> Loaded:
    """Load the files at ``path`` that were not loaded before.

    Each new file is read and cleaned once, as a batch of its own, and counted while the
    cleaned rows are written; several files are cleaned at the same time. Then all are
    merged, later files over earlier ones cell by cell, and upserted together into the
    buckets of the dataset that their keys fall into; no other bucket is read or
    written. The ledger entries, one per file, are appended last. A run that dies in
    between leaves no entry and the dataset as it was, and is simply repeated. One load
    of a dataset runs at a time. ``formats`` are date formats read besides ISO;
    ``bucket_count`` counts for the first load of a dataset.
    """
    ledger = staged(read_ledger(spark, root), "ledger")
    files = staged(file_checksums(spark, path), "checksums")
    outcome = staged(compare_with_ledger(files, ledger), "outcome")
    entries = new_files(files, ledger).orderBy("file_path").collect()  # one row per new file
    if not entries:
        return Loaded(outcome, None)

    def read(entry: Row) -> DataFrame:
        name = entry["file_path"]
        if name.lower().endswith(".parquet"):
            return read_parquet(spark, name)
        return read_csv(spark, name, csv_header(spark, name), multiline)

    cleaned = at_once([lambda entry=entry: cleaned_and_counted(read(entry), dataset, formats=formats) for entry in entries])
    batches = [allowed_columns(each.rows, dataset) for each in cleaned]
    version = upsert_files(spark, root, dataset, batches, entries[-1]["checksum"][:32], bucket_count)

    reports = at_once([lambda each=each, batch=batch: quality_report(each, batch, dataset)
                       for each, batch in zip(cleaned, batches, strict=True)])
    # entries of one run differ in time by their order, so that the last one names the version
    noted = spark.createDataFrame(
        [(number, entry["checksum"][:32], dataset, entry["file_name"], entry["checksum"], each.standardized, "completed", report)
         for number, (entry, each, report) in enumerate(zip(entries, cleaned, reports, strict=True))],
        "number long, batch_id string, dataset_type string, file_name string, checksum string, row_count long, "
        "status string, quality_report string")  # one row per file
    created = (F.localtimestamp() + F.make_dt_interval(secs=F.col("number") / 1_000_000)).alias("created_at")
    noted = staged(noted.select(*[name for name in noted.columns if name != "number"], created), "noted")
    noted.coalesce(1).write.mode("append").parquet(f"{root}/ingestion_batches")
    counts = noted.select("checksum", F.col("row_count").alias("_count"), "quality_report")
    return Loaded(outcome.join(counts, "checksum", "left").withColumn(
        "rows_loaded", F.coalesce("rows_loaded", "_count")).drop("_count"), version)


def upsert_files(spark: SparkSession, root: str, dataset: str, batches: Sequence[DataFrame], version: str,
                 bucket_count: int = buckets.BUCKETS) -> str:
    """Write the buckets of a dataset that rows of the batches fall into, as a new version; returns its folder."""
    folder, key = f"{root}/{dataset}", batches[0].columns[0]
    last = last_batch(spark, root, dataset)
    layout = buckets.Layout(bucket_count, {}) if last is None else buckets.read_layout(spark, folder, last)
    # stored: its keys tell the buckets, then it is merged into them
    merged = staged(merged_batches(batches, key), "merged")
    touched = buckets.touched_buckets(merged, key, layout)
    held = buckets.read_buckets(spark, folder, layout, touched)
    target = empty_table(spark, dataset) if held is None else cast_to(held, dataset)
    buckets.write_version(upsert_brought(target, merged, key, DEFAULTS[dataset]), key, folder, version, layout, touched)
    return f"{folder}/{version}"


def quality_report(cleaned: Cleaned, batch: DataFrame, dataset: str) -> str:
    """JSON: row counts of the cleaning and the profile of its result, one entry per column."""
    columns = [{name: value for name, value in row.asDict().items() if value is not None and name != "column_count"}
               for row in profile(batch).orderBy("column_name").collect()]  # one row per column
    return json.dumps({"counts": cleaned.report(dataset, batch.columns), "columns": columns})
