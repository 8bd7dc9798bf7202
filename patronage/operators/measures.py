"""How well scores tell two classes apart, and how well groups separate.

All measures come from counts and sums that Spark aggregates; no list of scores or of
rows reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patronage.functions.numbers import rounded
from patronage.operators.ranking import RUN, sorted_runs

MEASURES = ["accuracy", "precision", "recall", "f1", "roc_auc"]
_WHOLE = "decimal(38,0)"


def area_under_curve(scored: DataFrame, label: str, score: str, by: str) -> DataFrame:
    """``by`` and roc_auc: the share of pairs of a 1 and a 0 that the score puts in order, ties counting half.

    It follows from the ranks of the ones, tied scores sharing the mean of theirs. Scores
    are counted first, so a tie of any size is one row; the distinct scores stand in
    sorted runs, and the zeros below a run are added to those within it. Null where one
    of the classes does not occur; rows without a score or label are left out.
    """
    known = scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    counts = known.groupBy(by, score).agg(F.count_if(F.col(label) == 1).alias("ones"),
                                          F.count_if(F.col(label) == 0).alias("zeros"))
    runs = sorted_runs(counts, by, score)
    # a row per run, and one more where a run holds the seam between two groups
    totals = runs.groupBy(by, RUN).agg(F.sum("zeros").alias("zeros"))
    before = F.sum("zeros").over(W.partitionBy(by).orderBy(RUN)) - F.col("zeros")
    starts = totals.select(by, RUN, before.alias("_before"))
    upto = F.sum("zeros").over(W.partitionBy(by, RUN).orderBy(score).rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = runs.withColumn("_upto", upto).join(F.broadcast(starts), [by, RUN])
    # twice the zeros below a score, and once those at it, per one
    halves = F.col("ones").cast(_WHOLE) * (2 * (F.col("_before") + F.col("_upto")) - F.col("zeros"))
    sums = placed.groupBy(by).agg(F.sum(halves).alias("halves"), F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    pairs = 2 * F.col("ones").cast("double") * F.col("zeros")
    return sums.select(by, F.try_divide(F.col("halves").cast("double"), pairs).alias("roc_auc"))


def measures(scored: DataFrame, label: str, prediction: str, score: str, by: str) -> DataFrame:
    """One row per group: accuracy, precision, recall, F1 (0 where undefined) and area under the ROC curve."""
    yes, hit = F.col(label) == 1, F.col(prediction) == 1
    counts = scored.groupBy(by).agg(F.count_if(yes & hit).alias("tp"), F.count_if(~yes & hit).alias("fp"),
                                    F.count_if(yes & ~hit).alias("fn"), F.count_if(~yes & ~hit).alias("tn"))
    tp, fp, fn, tn = (F.col(name) for name in ("tp", "fp", "fn", "tn"))

    def ratio(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    found = counts.join(area_under_curve(scored, label, score, by), by, "left").select(
        by, ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), "roc_auc")
    return found.withColumns({name: rounded(F.col(name), 4) for name in MEASURES})


def with_selected(measured: DataFrame, by: str) -> DataFrame:
    """Mark the group with the largest area, the first by name among equals; there are few groups."""
    first = F.struct(-F.coalesce("roc_auc", F.lit(-1.0)), F.col(by))
    return measured.withColumn("selected", F.row_number().over(W.orderBy(first)) == 1)


def silhouettes(rows: DataFrame, group: str, values: Sequence[str]) -> DataFrame:
    """``rows`` with the silhouette of each in its group, by squared Euclidean distances.

    The mean squared distance from a row to a group follows from the group's size, sum
    of vectors and sum of squared lengths: one pass for these, one row per group, and a
    projection. A row alone in its group has 0, a single group none (null). Rows without
    a group or a value are left out.
    """
    known = rows.filter(F.col(group).isNotNull()).dropna(subset=list(values))
    square = sum((F.col(name) * F.col(name) for name in values), F.lit(0.0))
    groups = known.groupBy(F.col(group).alias("group")).agg(
        F.count("*").cast("double").alias("n"), F.sum(square).alias("squares"),
        F.array(*[F.sum(name) for name in values]).alias("sums"))
    table = groups.agg(F.collect_list(F.struct("group", "n", "squares", "sums"))).scalar()  # one entry per group

    def spread(other: Column) -> Column:
        """Sum of the squared distances from the row to all rows of a group."""
        product = sum((F.col(name) * other["sums"][i] for i, name in enumerate(values)), F.lit(0.0))
        return other["n"] * square + other["squares"] - 2 * product

    own = F.filter("_groups", lambda other: other["group"] == F.col(group))[0]
    others = F.filter("_groups", lambda other: other["group"] != F.col(group))
    near = F.array_min(F.transform(others, lambda other: spread(other) / other["n"]))
    within = F.greatest(spread(own), F.lit(0.0)) / (own["n"] - 1)
    value = F.when(own["n"] == 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(near - within, F.greatest(near, within)), F.lit(0.0)))
    return known.withColumn("_groups", table).withColumn(
        "silhouette", F.when(F.size("_groups") > 1, value)).drop("_groups")
