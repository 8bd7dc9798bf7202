"""Helpers shared by the operators of this folder.

A word is a run of characters other than the six ASCII white-space characters,
``[^\\x20\\x09-\\x0D]+``: what ``bytes.split()`` yields on UTF-8. Python tasks work on
a batch in slices of bounded size, so that a worker holds few words at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.session import staged

WORD = r"[^\x20\x09-\x0D]+"
SLICE_CHARS = 1_500_000

__all__ = ["Index", "SLICE_CHARS", "WORD", "fresh", "held_out", "letters", "parts", "read", "slices", "staged",
           "word_hashes", "words_of"]


def read(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table of the data folder, with the named columns only."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def held_out(doc_id: Column | str) -> Column:
    """True for the quarter of the ids that no label is learnt from; a null id is not held out."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return F.coalesce(F.crc32(text.cast("binary")) % 4 == 2, F.lit(False))


def fresh(label: str) -> str:
    """A column name no input table has."""
    return f"_{label}_{uuid.uuid4().hex[:8]}"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(point).isalpha() for point in range(0x110000)), bool, 0x110000)


class Index(dict):
    """Numbers pieces of text in the order in which they are first asked for."""

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        return number


def slices(texts: Sequence[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of slices of about ``limit`` characters; a longer text is a slice of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        length = len(text) if text is not None else 0
        if i > start and size + length > limit:
            yield start, i
            start, size = i, 0
        size += length
    if start < len(texts):
        yield start, len(texts)


def parts(texts: pa.Array, limit: int = SLICE_CHARS) -> Iterator[list[str | None]]:
    """The texts of an Arrow column in lists of about ``limit`` bytes, so that few are Python strings at once.

    After the last one Arrow gives back the memory it keeps for reuse.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        passed = ends[begin - 1] if begin else 0
        end = max(int(np.searchsorted(ends, passed + limit, side="right")), begin + 1)
        yield texts[begin:end].to_pylist()
        begin = end
    pa.default_memory_pool().release_unused()


def words_of(texts: Sequence[str | None], lower: bool = False) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts in one list, and where each text's words start; null has none.

    ``lower`` turns A-Z into a-z and leaves every other character alone.
    """
    words: list[bytes] = []
    starts = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        if text is not None:
            raw = text.encode("utf-8", "surrogatepass")
            words += (raw.lower() if lower else raw).split()
        starts[i + 1] = len(words)
    return words, starts


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of every word, the same in every task."""
    if not words:
        return np.zeros(0, np.uint64)
    values = np.empty(len(words), object)
    values[:] = words
    return pd.util.hash_array(values, categorize=False)
