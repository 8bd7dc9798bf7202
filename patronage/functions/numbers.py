"""Number expressions.

Money is summed as ``DECIMAL`` so that a total does not depend on the order in
which partitions arrive, and turned into a double at the output.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from patronage.functions.text import stripped

MONEY = "decimal(18,6)"  # amounts below a trillion, to a millionth
EXACT = "decimal(38,8)"


def money(amount: Column | str) -> Column:
    return (F.col(amount) if isinstance(amount, str) else amount).cast(MONEY)


def rounded(value: Column, digits: int) -> Column:
    """Half-up on the decimal value, as a double."""
    return F.round(value.cast(EXACT), digits).cast("double")


def clipped(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds on a value; null stays null (``greatest`` alone would return the bound)."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(value.isNotNull(), bounded)


def exact_mean(value: Column) -> Column:
    """Mean that does not depend on row order: decimal sum over the count."""
    return F.try_divide(F.sum(value.cast(EXACT)).cast("double"), F.count(value).cast("double"))


def number(text: Column) -> Column:
    """Double from text, null where it does not parse or is no number."""
    parsed = stripped(text).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def floored_money(text: Column) -> Column:
    """Double from text; unreadable becomes 0 and negatives become 0."""
    return F.greatest(F.coalesce(number(text), F.lit(0.0)), F.lit(0.0))


def band(value: Column, edges: list[tuple[float, str]]) -> Column:
    """Label by right-closed intervals: the first edge the value does not exceed."""
    choice = None
    for edge, label in edges:
        hit = value <= F.lit(edge)
        choice = F.when(hit, label) if choice is None else choice.when(hit, label)
    return choice
