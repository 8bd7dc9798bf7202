"""Periodic runs of words: stretches that repeat a few words over and over.

A run of period q is a longest stretch in which every word equals the one q words
before it, q being the smallest such number. It is reported from ``LEAST`` words and
``EXPONENT`` periods on.

Along the diagonal of lag q, the match length at a word is one more than at the word
before if the word equals the one q back, else nothing; a diagonal that ends with a
match length of (exponent - 1) * q or more emits its run at once. Were every earlier
occurrence of a word to lengthen its diagonal, frequent words would cost the square of
their number. So the diagonals are kept sparse, exactly: a run of period q in
(size / 2, size] is seen through windows of ``size`` words. Inside such a run the
nearest earlier occurrence of a window is q words back, since a word sequence with
smallest period q meets itself nowhere else, and at the ends of the run it is not. So
each window lengthens one diagonal, that of its nearest earlier occurrence, and the
diagonals that last are the runs, none missing and none with a multiple of its period.
Windows double in size (1, 2, 4, ...); those that occur once in their document cannot
be part of longer ones that repeat, and are left out. Work is a sort per size over what
still repeats, whatever the words are.

Null, empty and blank texts have no words and no runs; the collapsed text is empty.
Long texts are used whole, one at a time. Two runs may overlap; they are ordered by
start, then period, and no two have both alike. Repeated rows and rows without an id
are treated like any other, each by itself. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.llm.common import Index, fresh, parts, words_of

#: A run has so many words at least, and so many times its period.
LEAST, EXPONENT = 6, 4
#: Bytes of text whose words a worker holds at a time.
PART = 1_000_000
RUNS = T.ArrayType(T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")]))


def _diagonals(at: np.ndarray, lag: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of neighbouring windows on one diagonal of this size's lags: first window, number of windows, lag."""
    active = np.flatnonzero((lag > size // 2) & (lag <= size))
    if not len(active):
        return active, active, active
    place, lags = at[active], lag[active]
    begins = np.concatenate(([True], (np.diff(place) != 1) | (np.diff(lags) != 0)))
    first = np.flatnonzero(begins)
    return place[first], np.diff(np.append(first, len(place))), lags[first]


def runs_of(words: np.ndarray, starts: np.ndarray, least: int = LEAST, exponent: int = EXPONENT
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (place in ``words``), length and period of all runs, by start, then period.

    ``words`` numbers the words of all documents one after the other, equal words
    alike; ``starts`` says where each document begins, and ends with their number.
    """
    if exponent < 3:
        raise ValueError("windows of a size see runs of three periods and more")
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(words))
    key = owner * (words.max(initial=0) + 1) + words
    found: list[tuple[np.ndarray, ...]] = []
    size = 1
    while True:
        # a document must be long enough for a run of this size's smallest period
        long_enough = sizes[owner[at]] >= max(least, exponent * (size // 2 + 1))
        at, key = at[long_enough], key[long_enough]
        if not len(at):
            break
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([True], np.diff(key[order]) != 0))
        place = at[order]
        lag = np.zeros(len(at), np.int64)
        lag[order[1:]] = np.where(new[1:], 0, np.diff(place))
        first, count, period = _diagonals(at, lag, size)
        # the match length is that of the windows and the words of the last one
        enough = count + size - 1 + period >= np.maximum(least, exponent * period)
        found.append((first[enough] - period[enough], (count + size - 1 + period)[enough], period[enough]))

        repeats = ~new | ~np.append(new[1:], True)
        name = np.full(len(words) + size, -1, np.int64)
        name[place[repeats]] = (np.cumsum(new) - 1)[repeats]
        at = at[name[at] >= 0]
        at = at[name[at + size] >= 0]
        at = at[owner[at] == owner[np.minimum(at + size, len(words) - 1)]]
        key = name[at] * np.int64(len(words)) + name[at + size]
        size *= 2
    start, length, period = (np.concatenate([part[i] for part in found] or [np.zeros(0, np.int64)]) for i in range(3))
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _collapsed(words: list[bytes], starts: np.ndarray, start: np.ndarray, length: np.ndarray,
               period: np.ndarray) -> list[bytes]:
    """The documents without the words that stand in a run after its first period."""
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    dropped = np.cumsum(edges)[:-1] > 0
    before = np.concatenate(([0], np.cumsum(dropped)))
    texts = []
    for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if before[begin] == before[end]:
            texts.append(b" ".join(words[begin:end]))
        else:
            texts.append(b" ".join([words[begin + i] for i in np.flatnonzero(~dropped[begin:end])]))
    return texts


def analysed(texts: Sequence[str | None], least: int = LEAST, exponent: int = EXPONENT) -> list[pa.Array]:
    """Number of words, runs (starts count from the text's first word) and collapsed text of every text."""
    words, starts = words_of(texts)
    index = Index()
    numbers = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    start, length, period = runs_of(numbers, starts, least, exponent)
    bounds = np.searchsorted(start, starts)
    bounds[0], bounds[-1] = 0, len(start)
    of = np.searchsorted(starts, start, side="right") - 1
    runs = pa.StructArray.from_arrays([pa.array(start - starts[of]), pa.array(length), pa.array(period)],
                                      ["start", "length", "period"])
    collapsed = _collapsed(words, starts, start, length, period)
    return [pa.array(np.diff(starts)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), runs),
            pa.array(collapsed, pa.binary()).cast(pa.string())]


def periodic_runs(documents: DataFrame, text: str, keep: Sequence[str] = (), least: int = LEAST,
                  exponent: int = EXPONENT) -> DataFrame:
    """The columns ``keep`` of every row with n_words, runs and collapsed, the text without repeated periods.

    Words of the collapsed text are joined by one blank. One pass without a shuffle.
    """
    body = fresh("text")
    narrow = documents.select(F.col(text).alias(body), *keep)
    kept = narrow.select(*keep).schema

    def analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            for texts in parts(batch.column(0), PART):
                rest = [batch.column(i)[begin:begin + len(texts)] for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, *analysed(texts, least, exponent)],
                                                 [*keep, "n_words", "runs", "collapsed"])
                begin += len(texts)

    schema = kept.add("n_words", "long").add("runs", RUNS).add("collapsed", "string")
    return narrow.mapInArrow(analyse, schema)
