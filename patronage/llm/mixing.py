"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected as often as the source's target is larger
than the source. The expected copies are summed along the source, one random offset
in [0, 1) is added, and a document is emitted once for every integer that its
stretch of the sum passes. The documents of a source stand in order of size, so the
copies taken spread evenly over all sizes and the words taken differ from the target
by less than the longest document.

The running sum needs each document's place in its source. Documents are range
partitioned by (source, size, id), rows alike in these by where they were read, which
spreads a hot source, and rows that repeat, over many tasks; a task numbers its own
stretch, and counts per stretch, a few per source, give the rest. The counts of sources
never come to the driver.

Null source: a source of its own, last in order. Null text: size 0. Null ids are
ordered first; repeated rows are documents of their own, told apart by nothing, so
that it does not matter which of them is taken. No documents: no rows. Only the
columns named are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patronage.llm.common import WORD, fresh, staged
from patronage.operators.ranking import PLACE, RUN, global_row_number, sorted_runs

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 17
_HEX_DIGITS = 8


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the source and the seed alone."""
    digits = F.substring(F.md5(F.coalesce(F.concat(F.lit(f"{seed}:"), source), F.lit(f"{seed}"))), 1, _HEX_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16 ** _HEX_DIGITS))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``target`` for sources given as (source, source_size).

    Sources by code point, null last, take the weights in turn and share the sum of
    all sizes. A target stops at ``most`` times its source; what is left over goes to
    the others by weight, until no target is above its stop. Sources without words
    get 0.
    """
    spark = sizes.sparkSession
    ordered = global_row_number(sizes, [F.col("source").isNull(), "source"], "_number")
    turn = ((F.col("_number") - 1) % len(weights)).cast("int")
    weighted = ordered.select("source", "source_size",
                              F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long").alias("_weight"))
    stop = F.col("source_size") * most
    total = weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all")).first()["all"]
    level = 0.0
    while True:
        # one row: stopped sources give what they have, the others share the rest
        stopped = stop.cast("double") <= F.lit(level) * F.col("_weight")
        state = weighted.agg(F.coalesce(F.sum(F.when(stopped, stop)), F.lit(0)).alias("given"),
                             F.sum(F.when(~stopped, F.col("_weight"))).alias("weight")).first()
        if not state["weight"]:
            break
        raised = (total - state["given"]) / state["weight"]
        if raised <= level:
            break
        level = raised
    target = F.least(stop.cast("double"), F.lit(level) * F.col("_weight"))
    return weighted.select("source", "source_size", target.alias("target"))


def mixed(documents: DataFrame, doc_id: str, source: str, size: Column, weights: Sequence[int] = WEIGHTS,
          most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """One row per document with how often the mix takes it.

    Columns: doc_id, source, size, source_size, target, ``copies`` and ``taken``
    (copies times size). ``size`` is a whole number >= 0 per document, null counts as 0.
    """
    sized = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                             F.coalesce(size, F.lit(0)).cast("long").alias("size"),
                             F.monotonically_increasing_id().alias("_read"))
    # sorting samples its input first: the texts are read and counted once only
    runs = sorted_runs(staged(sized, "sizes"), "source", "size", "doc_id", "_read")
    # a source lies in neighbouring runs: as many rows as sources and runs together
    parts = runs.groupBy("source", RUN).agg(F.count("*").alias("_count"), F.min(PLACE).alias("_begin"),
                                            F.sum("size").alias("_words"))
    targets = source_targets(parts.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, most)
    before = (F.sum("_count").over(W.partitionBy("source").orderBy(RUN)) - F.col("_count")).alias("_before")
    parts = (parts.select("source", RUN, "_begin", before).alias("p")
             .join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
             .select("p.*", "t.source_size", "t.target"))
    joined = runs.alias("r").join(parts.alias("p"), (F.col(f"r.{RUN}") == F.col(f"p.{RUN}"))
                                  & F.col("r.source").eqNullSafe(F.col("p.source")))
    number = F.col(f"r.{PLACE}") - F.col("p._begin") + F.col("p._before")
    expected = F.when(F.col("p.source_size") > 0, F.col("p.target") / F.col("p.source_size")).otherwise(0.0)
    begin = offset(F.col("r.source"), seed)
    crossed = F.floor(begin + (number + 1) * expected) - F.floor(begin + number * expected)
    copies = F.least(crossed.cast("long"), F.lit(most).cast("long"))
    return joined.select("r.doc_id", "r.source", "r.size", "p.source_size", "p.target", copies.alias("copies"),
                         (copies * F.col("r.size")).alias("taken"))


def emitted(documents: DataFrame, copies: Column) -> DataFrame:
    """Every row as often as ``copies`` says."""
    copy = fresh("copy")
    return documents.withColumn(copy, F.explode(F.array_repeat(F.lit(True), copies.cast("int")))).drop(copy)
