"""File and database sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.errors import DataValidationError
from patronage.functions.dates import NAIVE
from patronage.functions.text import known_text
from patronage.schemas import RAW_RETAIL, SCHEMAS, Tables, empty_table

SEQUENCE = "ingest_seq"
CSV = {"quote": '"', "escape": '"'}
_MALFORMED = "_malformed"


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], multiline: bool = True) -> DataFrame:
    """A CSV file as text columns, with the place of every row in its file.

    ``columns`` is the header in file order. A quote inside a quoted cell is doubled.
    Cells that stand for a missing value are null. Rows with fewer cells than the
    header are filled up with nulls; a row with more raises. Types are given later, by
    the cleaning rules. ``ingest_seq`` orders rows as the file does however the scan
    is split: by path, by the start of the block, by the row in the block.

    With ``multiline`` a quoted cell may hold line breaks, and a file is read by one
    task; pass False for large files without such cells, which are then split.
    """
    if not path.lower().endswith((".csv", ".csv.gz")):
        raise DataValidationError("only CSV and Parquet files are read")
    schema = T.StructType([T.StructField(name, T.StringType()) for name in [*columns, _MALFORMED]])
    scan = spark.read.schema(schema).options(**CSV, header=True, enforceSchema=False, multiLine=multiline,
                                             columnNameOfCorruptRecord=_MALFORMED).csv(path)
    # a malformed row is too short or too long: read again with one column more, only the long one fills it
    wider = ", ".join([f"c{i} STRING" for i in range(len(columns) + 1)] + [f"{_MALFORMED} STRING"])
    again = F.from_csv(F.col(_MALFORMED), F.lit(wider), {**CSV, "columnNameOfCorruptRecord": _MALFORMED})
    long = F.col(_MALFORMED).isNotNull() & (again.getField(_MALFORMED).isNull()
                                            | again.getField(f"c{len(columns)}").isNotNull())
    problem = F.raise_error(F.concat(F.lit("row with more cells than the header: "), F.col(_MALFORMED)))
    # Spark reads malformed rows only beside a real column, also where a count needs none
    there = F.length(F.coalesce(F.col(f"`{columns[0]}`"), F.lit(""))) >= 0
    rows = with_sequence(scan).filter(F.when(long, problem.cast("boolean")).otherwise(there))
    return rows.select(*[known_text(F.col(f"`{name}`")).alias(name) for name in columns], SEQUENCE)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return with_sequence(spark.read.parquet(path))


def with_sequence(rows: DataFrame) -> DataFrame:
    """Must be applied directly on a file scan."""
    return rows.select(
        "*",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias(SEQUENCE),
    )


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names from the first line; no data row is read."""
    return spark.read.options(**CSV, header=True, inferSchema=False).csv(path).columns


def read_raw_retail(sheets: Sequence[DataFrame]) -> DataFrame:
    """Stack sheets whose columns mean the same by position.

    If all sheets know the order of their rows (``ingest_seq``), so does the result:
    sheet after sheet, row after row.
    """
    ordered = all(SEQUENCE in sheet.columns for sheet in sheets)

    def named(number: int, sheet: DataFrame) -> DataFrame:
        cells = [F.col(f"`{name}`").alias(own) for name, own in
                 zip([name for name in sheet.columns if name != SEQUENCE], RAW_RETAIL, strict=True)]
        place = [F.struct(F.lit(number).alias("sheet"), F.col(SEQUENCE).alias("place")).alias(SEQUENCE)]
        return sheet.select(*cells, *(place if ordered else []))

    return reduce(DataFrame.unionByName, [named(i, sheet) for i, sheet in enumerate(sheets)])


def cast_to(rows: DataFrame, name: str) -> DataFrame:
    """The columns of a domain table, cast to its types; absent ones become null."""
    fields = T._parse_datatype_string(SCHEMAS[name]).fields

    def typed(field: T.StructField) -> Column:
        if field.name not in rows.columns:
            return F.lit(None).cast(field.dataType).alias(field.name)
        kind = rows.schema[field.name].dataType
        if isinstance(kind, T.DecimalType) and isinstance(field.dataType, T.DoubleType):
            return F.col(field.name)
        return F.col(field.name).cast(field.dataType).alias(field.name)

    return rows.select(*[typed(field) for field in fields])


def load_tables(spark: SparkSession, location: str | Mapping[str, str]) -> Tables:
    """Domain tables from a folder of Parquet files or a mapping to catalog tables.

    Tables that are not named become empty ones.
    """
    def one(name: str) -> DataFrame:
        if isinstance(location, str):
            return cast_to(spark.read.parquet(f"{location}/{name}.parquet"), name)
        if name not in location:
            return empty_table(spark, name)
        return cast_to(spark.table(location[name]), name)

    return Tables(*[one(name) for name in Tables._fields])


def load_retail(spark: SparkSession, folder: str) -> Tables:
    """The three prepared retail tables; marketing and support do not exist there."""
    read = {name: spark.read.parquet(f"{folder}/{name}.parquet")
            for name in ("customers", "products", "transactions")}
    read["transactions"] = read["transactions"].withColumn("order_date", F.col("order_date").cast(NAIVE))
    return Tables(
        *[cast_to(read[name], name) if name in read else empty_table(spark, name) for name in Tables._fields]
    )


def read_database(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int],
                  slices: int, properties: Mapping[str, str] | None = None) -> DataFrame:
    """A database table, read in ``slices`` ranges of its key at the same time."""
    return spark.read.jdbc(url=url, table=table, column=key, lowerBound=bounds[0], upperBound=bounds[1],
                           numPartitions=slices, properties=dict(properties or {}))
