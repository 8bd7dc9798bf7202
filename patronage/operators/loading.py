"""Keyed upsert and the ledger of loaded files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.schemas import DEFAULTS, SCHEMAS

COMPLETED, DUPLICATE = "completed", "duplicate"
WHOLE_FILE, CHUNK = 1 << 26, 1 << 23


def allowed_columns(batch: DataFrame, dataset: str) -> DataFrame:
    """The columns the dataset knows, cast to its types, in its order."""
    fields = T._parse_datatype_string(SCHEMAS[dataset]).fields
    return batch.select(*[F.col(field.name).cast(field.dataType).alias(field.name)
                          for field in fields if field.name in batch.columns])


def upsert(target: DataFrame, batch: DataFrame, key: str, defaults: dict | None = None) -> DataFrame:
    """``target`` after the batch: rows with a known key updated, the others added.

    Only columns the batch brings are changed, also to null; for new rows the rest
    take their default. Both sides hold a key once.
    """
    brought = [name for name in batch.columns if name in target.columns and name != key]
    return upsert_brought(target, batch.select(key, *[F.struct(F.col(name).alias("value")).alias(name)
                                                      for name in brought]), key, defaults)


def upsert_brought(target: DataFrame, batch: DataFrame, key: str, defaults: dict | None = None) -> DataFrame:
    """``upsert`` with every cell of the batch a struct of its ``value``, null where the row does not bring it."""
    brought = [name for name in batch.columns if name in target.columns and name != key]
    incoming = batch.select(key, *[F.col(name).alias(f"_new_{name}") for name in brought])
    joined = target.withColumn("_in_target", F.lit(True)).join(incoming, key, "full_outer")

    def value(name: str):
        if name == key:
            return F.col(key)
        kind = target.schema[name].dataType
        default = (defaults or {}).get(name)
        old = F.col(name) if default is None else F.when(
            F.col("_in_target").isNull(), F.lit(default).cast(kind)).otherwise(F.col(name))
        if name in brought:
            new = F.col(f"_new_{name}")
            old = F.when(new.isNotNull(), new.getField("value").cast(kind)).otherwise(old)
        return old.alias(name)

    return joined.select(*[value(name) for name in target.columns])


def merged_batches(batches: Sequence[DataFrame], key: str) -> DataFrame:
    """One row per key from batches in order of arrival: of every column the last cell that any of them brings.

    Cells are structs as ``upsert_brought`` takes them. Each batch holds a key once.
    """
    names = list(dict.fromkeys(name for batch in batches for name in batch.columns if name != key))
    marked = [batch.select(key, F.lit(number).alias("_batch"), *[F.struct(F.col(name).alias("value")).alias(name)
                                                                for name in batch.columns if name != key])
              for number, batch in enumerate(batches)]
    together = reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), marked)
    last = [F.max_by(name, F.when(F.col(name).isNotNull(), F.col("_batch"))).alias(name) for name in names]
    return together.groupBy(key).agg(*last) if last else together.select(key).distinct()


def upsert_dataset(target: DataFrame, batch: DataFrame, dataset: str) -> DataFrame:
    known = allowed_columns(batch, dataset)
    return upsert(target, known, known.columns[0], DEFAULTS[dataset])


def _streaming(chunk: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Adds the checksums of files read in pieces; a closure, so that executors need not have this package."""
    def streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sums = []
            for path in batch["file_path"]:
                files, name = fs.FileSystem.from_uri(path)
                digest = hashlib.sha256()
                with files.open_input_stream(name) as stream:
                    while part := stream.read(chunk):
                        digest.update(part)
                sums.append(digest.hexdigest())
            yield batch.assign(checksum=sums)
    return streamed


def file_checksums(spark: SparkSession, path: str, whole: int = WHOLE_FILE) -> DataFrame:
    """Name and SHA-256 of every file under ``path``, one task per file.

    Files of up to ``whole`` bytes, small ones, are read by Spark as one value, from
    wherever Spark reads; larger ones are streamed in pieces, as the digest of a file
    needs all of it in order.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("file_name")
    small = files.filter(F.col("length") <= whole).select(
        name, F.col("path").alias("file_path"), F.sha2("content", 256).alias("checksum"))
    large = files.filter(F.col("length") > whole).select(name, F.col("path").alias("file_path"))
    return small.unionByName(large.mapInPandas(
        _streaming(CHUNK), "file_name string, file_path string, checksum string"))


def compare_with_ledger(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files with the batch they belong to and whether they are new.

    The same bytes under several names are one batch, that of the first name. The
    batch id is taken from the checksum, so a repeated run names it the same.
    """
    first = files.groupBy("checksum").agg(F.min("file_path").alias("_first"))
    known = ledger.select("checksum", F.col("batch_id").alias("_old_id"), F.col("row_count").alias("_old_rows"))
    seen = F.col("_old_id").isNotNull() | (F.col("file_path") != F.col("_first"))
    return (
        files.join(first, "checksum").join(known, "checksum", "left")
        .select(
            "file_name",
            "file_path",
            "checksum",
            F.coalesce("_old_id", F.substring("checksum", 1, 32)).alias("batch_id"),
            F.when(seen, DUPLICATE).otherwise(COMPLETED).alias("status"),
            F.col("_old_rows").alias("rows_loaded"),
        )
    )


def new_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """The files to load: bytes not in the ledger, each once."""
    first = files.groupBy("checksum").agg(F.min_by(F.struct("file_name", "file_path"), "file_path").alias("f"))
    return first.join(ledger.select("checksum"), "checksum", "left_anti").select("checksum", "f.*")
