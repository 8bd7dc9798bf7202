"""Date expressions; timestamps carry no zone."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from patronage.functions.text import stripped

NAIVE = "timestamp_ntz"


def naive(moment: Column | str) -> Column:
    return (F.col(moment) if isinstance(moment, str) else moment).cast(NAIVE)


def moment_literal(moment: dt.datetime) -> Column:
    """The wall-clock time as it stands; a datetime literal would pass through two time zones."""
    return F.lit(moment.replace(tzinfo=None).isoformat(sep=" ")).cast(NAIVE)


def whole_days(later: Column, earlier: Column) -> Column:
    """Full 24-hour days between two moments (calendar days would count 13:00 to 12:00 as one)."""
    return F.extract(F.lit("DAY"), naive(later) - naive(earlier)).cast("int")


def month_start(moment: Column | str) -> Column:
    return F.trunc(naive(moment).cast("date"), "month")


def month_label(moment: Column | str) -> Column:
    return F.date_format(naive(moment).cast("date"), "yyyy-MM")


def iso_text(moment: Column) -> Column:
    return F.replace(naive(moment).cast("string"), F.lit(" "), F.lit("T"))


def parsed_moment(text: Column, formats: Sequence[str] = ()) -> Column:
    """Timestamp from ISO text or one of ``formats``; null where nothing fits."""
    attempts = [stripped(text).try_cast(NAIVE)]
    attempts += [F.try_to_timestamp(stripped(text), F.lit(form)).cast(NAIVE) for form in formats]
    return F.coalesce(*attempts)
