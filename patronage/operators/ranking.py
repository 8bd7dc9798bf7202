"""Ranks over a whole table without moving it into one task.

A window without a partition key sorts everything in a single task. Here rows are
range-partitioned on the sort key, so that every task holds one run of the order,
and written once with the number of their run and their place in it. What crosses
to the driver is one count per run and the few rows that were asked for.

Sort keys end in a unique column wherever equal values may be frequent, so that a
value shared by a third of the rows is spread over several runs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.session import staged

RUN, PLACE = "_run", "_place"
_PLACE_BITS = 33  # monotonically_increasing_id keeps the row's place in its lower 33 bits


#: Rows of a chunk that is numbered by itself.
CHUNK = 1 << 20


class Picked(NamedTuple):
    """The size of a group and its rows at the ranks asked for."""

    size: int
    rows: dict[int, Row]


def sorted_runs(df: DataFrame, *keys: Column | str, kept: Sequence[str] | None = None) -> DataFrame:
    """``df``, or the columns ``kept`` of it, in sorted runs, stored with run number and place within the run."""
    at = F.col("_at")
    placed = (
        df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn(RUN, F.shiftright(at, _PLACE_BITS).cast("int"))
        .withColumn(PLACE, at.bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
        .drop("_at")
    )
    return staged(placed if kept is None else placed.select(*kept, RUN, PLACE), "runs")


def global_row_number(df: DataFrame, keys: Sequence[Column | str], name: str,
                      kept: Sequence[str] | None = None) -> DataFrame:
    """Number rows 1..N along ``keys``; with ``kept`` these columns alone are stored and returned."""
    runs = sorted_runs(df, *keys, kept=kept)
    sizes = runs.groupBy(RUN).agg(F.count("*").alias("size")).orderBy(RUN).collect()  # one row per run
    starts, start = [], 0
    for size in sizes:
        starts.append((size[RUN], start))
        start += size["size"]
    offsets = df.sparkSession.createDataFrame(starts, f"{RUN} INT, _start BIGINT")
    return (
        runs.join(F.broadcast(offsets), RUN)  # as many rows as there are runs
        .withColumn(name, F.col("_start") + F.col(PLACE) + 1)
        .drop(RUN, PLACE, "_start")
    )


def _leaves(column: Column, kind: T.DataType) -> list[Column]:
    if not isinstance(kind, T.StructType):
        return [column]
    return [leaf for field in kind.fields for leaf in _leaves(column[field.name], field.dataType)]


def numbered_blocks(df: DataFrame, sequence: str) -> DataFrame:
    """``sequence`` with one number in place of the fields that tell the blocks of files apart and order them.

    Paths are long; afterwards a row carries two numbers through joins and shuffles.
    """
    *block, row = _leaves(F.col(sequence), df.schema[sequence].dataType)
    keys = [f"_block{i}" for i in range(len(block))]
    placed = df.withColumns(dict(zip([*keys, "_row"], [*block, row], strict=True)))
    numbers = placed.select(*keys).distinct().withColumn("_block", F.row_number().over(W.orderBy(*keys)))
    found = placed.join(F.broadcast(numbers), keys)  # a row per block
    return found.withColumn(sequence, F.struct(F.col("_block").alias("block"), F.col("_row").alias("row"))).drop(
        *keys, "_block", "_row")


def file_order_number(df: DataFrame, sequence: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """Number rows 1..N as they stand in their files, without a sort of the whole.

    The last field of ``sequence`` grows along the rows of a block, the fields before it
    tell the blocks apart and order them. Blocks are cut into chunks of at most ``chunk``
    places. Rows are counted per chunk, the counts summed along the chunks, and every
    chunk is numbered by itself, so neither a block nor a frequent value fills a task.
    The first number of a chunk stands for it from then on, so rows are moved by that.
    ``df`` is read twice and not stored; it must give the same rows both times.
    """
    *block, row = _leaves(F.col(sequence), df.schema[sequence].dataType)
    keys = [f"_block{i}" for i in range(len(block))] + ["_chunk"]
    placed = df.withColumns(dict(zip([*keys, "_row"], [*block, F.floor(row / chunk), row], strict=True)))
    counts = placed.groupBy(*keys).agg(F.count("*").alias("_n"))
    # a row per chunk
    starts = counts.withColumn("_start", F.sum("_n").over(W.orderBy(*keys)) - F.col("_n")).drop("_n")
    within = F.row_number().over(W.partitionBy("_start").orderBy("_row"))
    return placed.join(F.broadcast(starts), keys).drop(*keys).withColumn(name, F.col("_start") + within).drop(
        "_start", "_row")


def global_dense_rank(df: DataFrame, value: str, tie: str, name: str) -> DataFrame:
    """Dense rank of ``value``, largest first; equal values share a rank across runs, null has none."""
    runs = sorted_runs(df, F.col(value).desc(), F.col(tie).asc())
    edges = (
        runs.groupBy(RUN)
        .agg(F.max(value).alias("first"), F.min(value).alias("last"), F.count_distinct(value).alias("levels"))
        .orderBy(RUN).collect()  # one row per run
    )
    starts, seen, last = [], 0, None
    for edge in edges:
        shared = 1 if last is not None and edge["first"] == last else 0
        starts.append((edge[RUN], seen - shared))
        seen += edge["levels"] - shared
        last = edge["last"]
    offsets = df.sparkSession.createDataFrame(starts, f"{RUN} INT, _start BIGINT")
    within = F.dense_rank().over(W.partitionBy(RUN).orderBy(F.col(value).desc()))
    return (
        runs.withColumn("_within", within)
        .join(F.broadcast(offsets), RUN)  # as many rows as there are runs
        .withColumn(name, F.when(F.col(value).isNotNull(), F.col("_start") + F.col("_within")).cast("int"))
        .drop(RUN, PLACE, "_start", "_within")
    )


def rows_at_ranks(df: DataFrame, group: str, keys: Sequence[Column | str],
                  wanted: Callable[[int], Sequence[int]], weight: str | None = None) -> dict[int, Picked]:
    """The rows at given 0-based ranks of each group.

    ``group`` is an integer column with few values, ``wanted`` names the ranks for
    a group of n rows. With ``weight`` a row stands for that many equal ones.
    """
    runs = sorted_runs(df, group, *keys)
    size = F.sum(weight) if weight else F.count("*")
    # one row per run, and one more where a run holds the seam between two groups
    totals = runs.groupBy(group, RUN).agg(size.alias("size"), F.min(PLACE).alias("begin")).collect()
    pieces = defaultdict(list)
    for total in sorted(totals, key=lambda row: (row[group], row[RUN])):
        pieces[total[group]].append(total)

    picked = {number: Picked(sum(part["size"] for part in parts), {}) for number, parts in pieces.items()}
    targets = []
    for number, parts in pieces.items():
        for rank in sorted(set(wanted(picked[number].size))):
            passed = 0
            for part in parts:
                if rank < passed + part["size"]:
                    targets.append((number, part[RUN], rank, rank - passed, part["begin"] + rank - passed))
                    break
                passed += part["size"]
    if not targets:
        return picked

    asked = F.broadcast(df.sparkSession.createDataFrame(  # one row per rank asked for
        targets, f"{group} INT, {RUN} INT, _rank BIGINT, _ahead BIGINT, {PLACE} BIGINT"))
    touched = runs.filter(F.col(RUN).isin(sorted({target[1] for target in targets})))
    if weight is None:
        found = touched.join(asked, [group, RUN, PLACE])
    else:
        upto = F.sum(weight).over(W.partitionBy(group, RUN).orderBy(PLACE)
                                  .rowsBetween(W.unboundedPreceding, W.currentRow))
        counted = touched.withColumn("_upto", upto).join(asked.drop(PLACE), [group, RUN])
        found = counted.filter((F.col("_ahead") < F.col("_upto"))
                               & (F.col("_ahead") >= F.col("_upto") - F.col(weight)))
    for row in found.collect():  # as many rows as ranks asked for
        picked[row[group]].rows[row["_rank"]] = row
    return picked
