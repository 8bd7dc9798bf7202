"""Features for models: numbers imputed and scaled, texts coded by number.

What is learnt from the training rows is three numbers per column and a table of the
texts with their numbers. That table may be of any size: it is numbered in sorted runs
and joined, no list of texts comes to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.operators.ranking import global_row_number
from patronage.operators.selection import middle_ranks, ranked_values
from patronage.session import staged

CODES = "column string, value string, code double"


class Scale(NamedTuple):
    """Median, and mean and standard deviation after the median has been filled in."""

    middle: float
    mean: float
    deviation: float


class Coding(NamedTuple):
    scales: dict[str, Scale]
    modes: dict[str, str]  # what a missing text becomes
    sizes: dict[str, int]  # different texts; also the code of one that was not seen
    codes: DataFrame  # column, value, code


def frequent_values(train: DataFrame, names: Sequence[str], default: str = "Unknown") -> dict[str, str]:
    """Most frequent text per column, the smallest among equals."""
    found = {}
    for name in names:
        counts = train.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
        found[name] = counts.agg(F.min_by(name, F.struct(-F.col("n"), name))).first()[0] or default
    return found


def fit_coding(train: DataFrame, numbers: Sequence[str], texts: Sequence[str]) -> Coding:
    """Learn from the training rows. A column without any number counts as all 0."""
    ranked = ranked_values(train, numbers, middle_ranks)
    middles = {}
    for name, found in ranked.items():
        middle = [found.values[rank] for rank in middle_ranks(found.size)]
        middles[name] = sum(middle) / 2 if middle else 0.0
    filled = {name: F.coalesce(F.col(name).cast("double"), F.lit(middles[name])) for name in numbers}
    moments = train.agg(*[pick(filled[name]).alias(f"{label} {name}") for name in numbers
                          for label, pick in (("mean", F.avg), ("deviation", F.stddev_samp))]).first()
    scales = {name: Scale(middles[name], moments[f"mean {name}"] or 0.0, moments[f"deviation {name}"] or 0.0)
              for name in numbers}

    def numbered(name: str) -> DataFrame:
        seen = train.filter(F.col(name).isNotNull()).select(F.col(name).alias("value")).distinct()
        return global_row_number(seen, ["value"], "_number").select(
            F.lit(name).alias("column"), "value", (F.col("_number") - 1).cast("double").alias("code"))

    codes = staged(reduce(DataFrame.unionByName, map(numbered, texts)), "codes")
    sizes = dict.fromkeys(texts, 0) | {row["column"]: row["n"] for row in
                                       codes.groupBy("column").agg(F.count("*").alias("n")).collect()}
    return Coding(scales, frequent_values(train, texts), sizes, codes)


def coded(rows: DataFrame, coding: Coding) -> DataFrame:
    """``rows`` with ``<number>_scaled``, and ``<text>_code``, the number of the text.

    A missing text counts as the most frequent one; a text that was not seen has the
    number after the last.
    """
    scaled = {f"{name}_scaled": ((F.coalesce(F.col(name).cast("double"), F.lit(scale.middle)) - scale.mean)
                                 / scale.deviation if scale.deviation else F.lit(0.0))
              for name, scale in coding.scales.items()}
    found = rows.withColumns(scaled)
    for name, size in coding.sizes.items():
        own = coding.codes.filter(F.col("column") == name).select(
            F.col("value").alias(f"{name}_value"), F.col("code").alias(f"{name}_code"))
        text = F.coalesce(F.col(name), F.lit(coding.modes[name]))
        found = found.join(own, text == F.col(f"{name}_value"), "left").drop(f"{name}_value").withColumn(
            f"{name}_code", F.coalesce(f"{name}_code", F.lit(float(size))))
    return found


def as_json(coding: Coding) -> Mapping:
    return {"scales": coding.scales, "modes": coding.modes, "sizes": coding.sizes}


def from_json(found: Mapping, codes: DataFrame) -> Coding:
    return Coding({name: Scale(*scale) for name, scale in found["scales"].items()}, found["modes"], found["sizes"], codes)
