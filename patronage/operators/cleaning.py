"""Standardising uploaded rows: headers, keys, types, texts, money and required values.

Rows arrive as text with an ordering column that tells which of several rows with
the same key came last in the file.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from patronage.errors import DataValidationError
from patronage.functions.dates import parsed_moment
from patronage.functions.numbers import floored_money, number
from patronage.functions.text import header_name, stripped, tidy_gender, tidy_title, truth
from patronage.operators.selection import median
from patronage.schemas import (
    BOOLEANS,
    DATES,
    MOMENTS,
    REPORT_NUMBERS,
    REQUIRED,
    SCHEMAS,
    STRICT_MONEY,
    TITLES,
)
from patronage.session import staged
from patronage.sources.files import SEQUENCE

AGE_RANGE = (16, 110)
_RECEIVED = "_received"


def normalised(rows: DataFrame) -> DataFrame:
    return rows.toDF(*[header_name(name) for name in rows.columns])


def check_columns(columns: Sequence[str], dataset: str) -> list[str]:
    """The required columns of a dataset type, if the type is known and none is missing."""
    if dataset not in REQUIRED:
        raise DataValidationError(f"Unknown dataset type: {dataset}")
    missing = sorted(set(REQUIRED[dataset]) - set(columns))
    if missing:
        raise DataValidationError(f"Missing required columns: {', '.join(missing)}")
    return REQUIRED[dataset]


def last_per_key(rows: DataFrame, key: str, sequence: str, count: str | None = None) -> DataFrame:
    """One row per key, the one with the highest sequence; a null key counts as a key.

    An aggregate rather than a window: rows of a frequent key are thinned out
    before the shuffle. ``count`` names a column for the number of rows of the key.
    """
    others = [name for name in rows.columns if name not in (key, sequence)]
    newest = F.max_by(F.struct(F.lit(True).alias("_there"), *others), F.col(sequence))
    picked = rows.groupBy(key).agg(newest.alias("_row"), F.count("*").alias(count or "_count"))
    return picked.select(*[F.col(key) if name == key else F.col(f"_row.{name}").alias(name)
                           for name in rows.columns if name != sequence], *([count] if count else []))


def standardise(rows: DataFrame, dataset: str, mode: str = "strict", sequence: str = SEQUENCE,
                formats: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """The cleaning rules that look at one row at a time, after the last row per key is chosen.

    ``mode='strict'`` also canonicalises gender, booleans and age and floors money
    at 0; ``mode='report'`` leaves those as they are and unreadable numbers null.
    ``count`` names a column for the number of rows that had the key.
    """
    rows = normalised(rows)
    key = check_columns(rows.columns, dataset)[0]
    wholes = _whole_numbers(dataset)
    if key in wholes:  # 7, 07 and 7.0 are the same key
        rows = rows.withColumn(key, F.coalesce(whole(F.col(key), wholes[key]).cast("string"), stripped(F.col(key))))
    cleaned = last_per_key(rows, key, sequence, count)
    have = set(cleaned.columns) - {count}
    changes: dict[str, Column] = {}

    def moments(names: Sequence[str], kind: str) -> None:
        for name in have.intersection(names):
            changes[name] = parsed_moment(F.col(name), formats).cast(kind)

    moments(MOMENTS.get(dataset, []), "timestamp_ntz")
    moments(DATES.get(dataset, []), "date" if mode == "strict" else "timestamp_ntz")
    for name in have.intersection(TITLES):
        changes[name] = tidy_title(F.col(name))
    if mode == "strict":
        for name in have.intersection(BOOLEANS.get(dataset, [])):
            changes[name] = truth(F.col(name))
        if "gender" in have:
            changes["gender"] = tidy_gender(F.col("gender"))
        for name in have.intersection(STRICT_MONEY):
            changes[name] = floored_money(F.col(name))
        if "age" in have:
            changes["age"] = F.when(number(F.col("age")).between(*AGE_RANGE), number(F.col("age")))
    else:
        for name in have.intersection(REPORT_NUMBERS):
            changes[name] = number(F.col(name))
    for name in have.intersection(wholes):
        changes[name] = whole(F.col(name), wholes[name])
    return cleaned.withColumns(changes)


def whole(text: Column, kind: str) -> Column:
    """Whole number from text such as ``7`` or ``7.0``; null where it does not parse or has a fraction."""
    value = number(text)
    return F.coalesce(stripped(text).try_cast(kind), F.when(value == F.rint(value), value).try_cast(kind))


def _whole_numbers(dataset: str) -> dict[str, str]:
    """Columns of the schema holding whole numbers, keys first of all."""
    fields = [field.split() for field in SCHEMAS[dataset].replace("\n", " ").split(",")]
    return {name: kind.lower() for name, kind in fields if kind in ("BIGINT", "INT") and name != "age"}


def with_imputed_age(rows: DataFrame, middle: float | None) -> DataFrame:
    """Unknown ages become ``middle``, their median; an all-unknown column stays null."""
    return rows.withColumn("age", F.bround(F.coalesce("age", F.lit(middle).cast("double")), 0).cast("int"))


class Cleaned(NamedTuple):
    """Cleaned rows, stored, and what was counted while they were written."""

    rows: DataFrame
    received: int
    standardized: int
    nulls: dict[str, int]  # per column

    def report(self, dataset: str, names: Sequence[str] | None = None) -> dict[str, int]:
        """The counts of ``cleaning_report``, for the named columns."""
        names = self.rows.columns if names is None else names
        return {"rows_received": self.received, "duplicates_removed": self.received - self.standardized,
                "columns": len(names), "rows_standardized": self.standardized,
                "missing_values": sum(self.nulls[name] for name in names),
                **{f"invalid_{name}": self.nulls[name] for name in REQUIRED[dataset]}}


def cleaned_and_counted(rows: DataFrame, dataset: str, sequence: str = SEQUENCE, formats: Sequence[str] = ()) -> Cleaned:
    """Cleaned rows, or an error naming the required values that are missing or unreadable.

    ``rows`` is read once: how many rows came in is summed from the rows per key, and
    everything is counted in the tasks that write the result, of which each counts once
    even if executors are lost.
    """
    cleaned = standardise(rows, dataset, "strict", sequence, formats, _RECEIVED)
    names = [name for name in cleaned.columns if name != _RECEIVED]
    seen = Observation()
    observed = cleaned.observe(seen, F.sum(_RECEIVED).alias("received"), F.count(F.lit(1)).alias("standardized"),
                               *[F.count_if(F.col(name).isNull()).alias(f"null {name}") for name in names])
    stored = staged(observed.drop(_RECEIVED), "cleaned")
    counts = seen.get
    nulls = {name: counts.get(f"null {name}") or 0 for name in names}
    invalid = {name: nulls[name] for name in REQUIRED[dataset] if nulls[name]}
    if invalid:
        raise DataValidationError(f"Invalid required values: {invalid}")
    if "age" in names:
        middle = median(stored, "age")
        stored = with_imputed_age(stored, middle)
        if middle is not None:
            nulls["age"] = 0
    return Cleaned(stored, counts.get("received") or 0, counts.get("standardized") or 0, nulls)


def clean_strict(rows: DataFrame, dataset: str, sequence: str = SEQUENCE, formats: Sequence[str] = ()) -> DataFrame:
    """Cleaned rows, or an error naming the required values that are missing or unreadable."""
    return cleaned_and_counted(rows, dataset, sequence, formats).rows


def clean_report(rows: DataFrame, dataset: str, sequence: str = SEQUENCE, formats: Sequence[str] = ()) -> DataFrame:
    """Cleaned rows with whatever is invalid left as null."""
    return standardise(rows, dataset, "report", sequence, formats)


def cleaning_report(rows: DataFrame, cleaned: DataFrame, dataset: str) -> DataFrame:
    """Rows in and out, duplicates removed, columns, nulls in all and per required column."""
    names = cleaned.columns
    nulls = {name: F.count_if(F.col(name).isNull()) for name in names}
    received = rows.agg(F.count("*")).scalar()
    counts = cleaned.agg(
        F.count("*").alias("rows_standardized"),
        sum(nulls.values(), F.lit(0)).alias("missing_values"),
        *[nulls[name].alias(f"invalid_{name}") for name in REQUIRED[dataset]],
    )
    metrics = ["rows_standardized", "missing_values"] + [f"invalid_{name}" for name in REQUIRED[dataset]]
    with_rest = counts.withColumns({
        "rows_received": received,
        "duplicates_removed": received - F.col("rows_standardized"),
        "columns": F.lit(len(names)).cast("bigint"),
    })
    return long_form(with_rest, ["rows_received", "duplicates_removed", "columns"] + metrics)


def long_form(one_row: DataFrame, metrics: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(name).cast("bigint").alias("value"))
                      for name in metrics])
    return one_row.select(F.inline(pairs))
