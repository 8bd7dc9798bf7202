"""Exact values at given ranks of whole columns, without sorting or storing them.

A histogram of every column between its least and largest value tells in which bin a
rank lies; the next histogram covers that bin alone, between the least and largest
value found in it, and so on until the bin holds one value. Every round is one pass over
the columns that are still open: the rows are counted under several grouping sets, one
per column, so what is shuffled is a row per bin and task, and what reaches the driver a
row per bin. Once the open bins hold ``FEW`` values in all, these are fetched and the
ranks counted off. A round divides the values in question by the number of bins, so one
round does for a million rows of spread values, two for a billion. Where one bin of equal width holds nearly all of them, the next round cuts it by powers
of two instead, so that values of any magnitude are apart after a few rounds. A value
shared by many rows costs nothing extra.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

BINS = 1024
#: So many values are fetched rather than counted once more.
FEW = 50_000
#: Cuts by powers of two, of the positive and of the negative numbers each.
CUTS = 32
_INFINITE = float("inf")
_STRIDE = 1 << 16  # codes of different spans are so far apart


class Ranked(NamedTuple):
    """How many values a column has, and those at the 0-based ranks asked for."""

    size: int
    values: dict[int, float]


class _Span(NamedTuple):
    """An interval that holds some of the ranks asked for: its ends are values, ``before`` lie below it."""

    low: float
    high: float
    before: int
    size: int
    ranks: list[int]
    even: bool = True  # whether the next bins are of equal width


def extent(names: Sequence[str]) -> list[Column]:
    """Aggregates that ``ranked_values`` starts from, to be taken along in a pass that is made anyway."""
    found = []
    for i, name in enumerate(names):
        value = F.col(name).cast("double")
        finite = F.when(F.abs(value) < _INFINITE, value)
        found += [F.count_if(value == -_INFINITE).alias(f"_below{i}"), F.count(finite).alias(f"_within{i}"),
                  F.count_if(value == _INFINITE).alias(f"_above{i}"), F.count(value).alias(f"_all{i}"),
                  F.min(finite).alias(f"_least{i}"), F.max(finite).alias(f"_most{i}")]
    return found


def ranked_values(df: DataFrame, names: Sequence[str], wanted: Callable[[int], Sequence[int]],
                  known: Row | None = None) -> dict[str, Ranked]:
    """Values of numeric columns at the ranks that ``wanted`` names for a column of n values.

    Nulls are no values; NaN counts as the largest one. ``known`` is the row of
    ``extent`` for the same columns, if it has been computed before.
    """
    names = list(names)
    if not names:
        return {}
    known = known if known is not None else df.agg(*extent(names)).first()
    result: dict[str, Ranked] = {}
    open_: dict[str, list[_Span]] = {}
    for i, name in enumerate(names):
        below, within, above, size = (known[f"_{part}{i}"] for part in ("below", "within", "above", "all"))
        result[name] = Ranked(size, {})
        inside = []
        for rank in sorted({rank for rank in wanted(size) if 0 <= rank < size}):
            if below <= rank < below + within:
                inside.append(rank)
            else:
                result[name].values[rank] = (-_INFINITE if rank < below else
                                             _INFINITE if rank < below + within + above else float("nan"))
        if inside:
            open_[name] = [_Span(known[f"_least{i}"], known[f"_most{i}"], below, within, inside)]
    while open_ := _settled(open_, result):
        if sum(span.size for spans in open_.values() for span in spans) <= FEW:
            _fetched(df, open_, result)
            break
        open_ = _narrowed(df, open_)
    return result


def _fetched(df: DataFrame, open_: Mapping[str, list[_Span]], result: dict[str, Ranked]) -> None:
    """Count the ranks off in the values of the open spans, which are few."""
    entries = []
    for i, (name, spans) in enumerate(open_.items()):
        value = F.col(name).cast("double")
        inside = reduce(lambda one, other: one | other, [value.between(span.low, span.high) for span in spans])
        entries.append(F.when(inside, F.struct(F.lit(i).alias("column"), value.alias("value"))))
    found = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy("e.column", "e.value").agg(
        F.count("*").alias("n")).collect()
    for i, (name, spans) in enumerate(open_.items()):
        values = sorted((row["value"], row["n"]) for row in found if row["column"] == i)
        for span in spans:
            passed, ranks = span.before, list(span.ranks)
            for value, n in values:
                if span.low <= value <= span.high:
                    passed += n
                    while ranks and ranks[0] < passed:
                        result[name].values[ranks.pop(0)] = value


def _settled(open_: Mapping[str, list[_Span]], result: dict[str, Ranked]) -> dict[str, list[_Span]]:
    """Write down the ranks of spans that hold one value; the others stay open."""
    rest: dict[str, list[_Span]] = {}
    for name, spans in open_.items():
        for span in spans:
            if span.low == span.high:
                result[name].values.update(dict.fromkeys(span.ranks, span.low))
            else:
                rest.setdefault(name, []).append(span)
    return rest


def _bin(value: Column, span: _Span) -> Column:
    """Number of the bin, growing with the value; the two ends of the span are in different bins."""
    if not span.even:
        return _place(value, _cuts(span), 0)
    width = span.high / 2 - span.low / 2  # halves, as the difference may be too large for a number
    at = (value / 2 - span.low / 2) / width if width > 0 else F.when(value > span.low, 1.0).otherwise(0.0)
    return F.least(F.floor(at * BINS), F.lit(BINS - 1)).cast("int")


def _cuts(span: _Span) -> list[float]:
    """Powers of two evenly between the smallest and the largest magnitude of the span on each side of zero."""
    cuts = {span.high}
    for sign, most, least in ((1, span.high, span.low), (-1, -span.low, -span.high)):
        if most > 0:
            first, last = (math.log2(max(end, 5e-324)) for end in (least, most))
            cuts |= {sign * 2.0 ** min(first + (last - first) * i / CUTS, 1023) for i in range(CUTS + 1)}
    return sorted(cut for cut in cuts if span.low < cut <= span.high)


def _place(value: Column, cuts: list[float], passed: int) -> Column:
    """How many of the cuts do not exceed the value, by halving."""
    if not cuts:
        return F.lit(passed)
    half = len(cuts) // 2
    return F.when(value < cuts[half], _place(value, cuts[:half], passed)).otherwise(
        _place(value, cuts[half + 1:], passed + half + 1))


def _narrowed(df: DataFrame, open_: Mapping[str, list[_Span]]) -> dict[str, list[_Span]]:
    """The bins that hold the ranks, each as a span of its own."""
    columns = []
    for i, (name, spans) in enumerate(open_.items()):
        value = F.col(name).cast("double")
        code = F.lit(None).cast("int")
        for number, span in enumerate(spans):
            code = F.when(value.between(span.low, span.high), _bin(value, span) + number * _STRIDE).otherwise(code)
        columns += [code.alias(f"_code{i}"), value.alias(f"_value{i}")]
    codes = [f"_code{i}" for i in range(len(open_))]
    rows = df.select(*columns).filter(F.coalesce(*codes, F.lit(None)).isNotNull())
    found = rows.groupingSets([[code] for code in codes], *codes).agg(
        F.count("*").alias("n"), *[pick(f"_value{i}").alias(f"{label}{i}") for i in range(len(open_))
                                   for label, pick in (("low", F.min), ("high", F.max))])
    bins: dict[str, list[Row]] = {code: [] for code in codes}
    for row in found.collect():  # at most a row per open span and bin
        for code in codes:
            if row[code] is not None:
                bins[code].append(row)
    narrowed: dict[str, list[_Span]] = {}
    for i, (name, spans) in enumerate(open_.items()):
        for number, span in enumerate(spans):
            own = sorted((row for row in bins[f"_code{i}"] if row[f"_code{i}"] // _STRIDE == number),
                         key=lambda row, i=i: row[f"_code{i}"])
            passed, ranks = span.before, list(span.ranks)
            for row in own:
                inside = [rank for rank in ranks if rank < passed + row["n"]]
                ranks = ranks[len(inside):]
                if inside:
                    crowded = span.even and 4 * row["n"] > span.size
                    narrowed.setdefault(name, []).append(
                        _Span(row[f"low{i}"], row[f"high{i}"], passed, row["n"], inside, not crowded))
                passed += row["n"]
    return narrowed


def middle_ranks(size: int) -> list[int]:
    """The one or two ranks whose mean is the median."""
    return [(size - 1) // 2, size // 2] if size else []


def median(df: DataFrame, name: str) -> float | None:
    """The exact median of a column, None without a value."""
    found = ranked_values(df, [name], middle_ranks)[name]
    middle = [found.values[rank] for rank in middle_ranks(found.size)]
    return sum(middle) / 2 if middle else None
