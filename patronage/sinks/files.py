"""File sinks and the dataset manifest."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.functions.dates import month_label
from patronage.sources.files import CSV

MONTH = "order_month"


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df``, and the number of its rows as ``rows``, counted by the tasks that write it."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def write_csv(df: DataFrame, path: str) -> int:
    """CSV with a header; quotes are doubled, nested columns are written as JSON. Returns the number of rows."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    flat = df.select(*[F.to_json(field.name).alias(field.name) if isinstance(field.dataType, nested)
                       else F.col(field.name) for field in df.schema.fields])
    rows, seen = counted(flat)
    rows.write.mode("overwrite").options(
        **CSV, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return seen.get.get("rows", 0)


def write_tables(tables: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """One Parquet folder per table, as the readers name them; transactions are partitioned by order month.

    Returns the manifest, counted while the tables are written.
    """
    written = {}
    for name, df in tables.items():
        if "order_date" in df.columns:
            # rows of a month go to as many tasks as its size calls for, not to one
            dated = df.withColumn(MONTH, F.coalesce(month_label("order_date"), F.lit("unknown")))
            rows, seen = counted(dated.hint("rebalance", MONTH))
            rows.write.mode("overwrite").partitionBy(MONTH).parquet(f"{folder}/{name}.parquet")
        else:
            rows, seen = counted(df)
            rows.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        written[name] = (seen.get.get("rows", 0), len(df.columns))
    return manifest_of(next(iter(tables.values())).sparkSession, written)


def manifest_of(spark: SparkSession, written: Mapping[str, tuple[int, int]]) -> DataFrame:
    """The manifest of tables whose rows and columns are known."""
    return spark.createDataFrame([(name, *numbers) for name, numbers in written.items()],
                                 "table string, rows long, columns int")


def manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and columns per table."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"))
        for name, df in tables.items()
    ])
