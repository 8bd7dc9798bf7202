"""Byte-pair encoding and decoding in batched numpy merge rounds.

A text is cut into pieces by the byte-level pattern, special tokens first. The
symbols of many distinct pieces lie in one flat array. In every round each piece
looks up the ranks of its neighbouring symbols by binary search over the sorted
pair keys, merges all places of its lowest rank, and leaves the array when no pair
is left. Merging all places of one rank at a time gives the same symbols as merging
them one by one, because each merge makes a symbol of its own, so that whatever
uses that symbol ranks after it.

Nothing is moved between rows: encoding and decoding are columns.

Null text counts as empty text and has no ids; decoding null gives the empty text.
Long texts are encoded whole, in a slice of their own. Ties between places of one rank
do not arise, as all are merged. Repeated rows and clashing column names do not matter:
the functions take columns. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import Index, slices

# fixed values: how byte-level vocabularies cut text into pieces
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# \s of the pattern is Unicode white space, which leaves out the four separators U+001C to U+001F
SPACE = r"\t\n\x0B\f\r \x85\xA0  -     　"
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
# the same pieces for texts of ASCII and Latin-1 letters only, by the faster of the two pattern libraries
PLAIN_PIECES = re.compile(rf" ?[{LATIN}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+", re.ASCII)
NOT_PLAIN = re.compile(rf"[^\x00-\x7F{LATIN}]")
NONE = np.int64(1) << 40
KNOWN_PIECES = 100_000
SLICE = 500_000


def _byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is visible, else one from U+0100 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = iter(range(256, 512))
    shown = set(visible)
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    """Merge table and byte strings of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        characters = _byte_characters()
        byte = {character: bytes([b]) for b, character in enumerate(characters)}
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ", 1)) for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        if len(np.unique(made)) != len(made):
            raise ValueError("two merges make the same symbol")
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.base = np.array([vocab[character] for character in characters], np.int64)

        self.special = {}
        for token in spec.get("added_tokens") or []:
            if token.get("lstrip") or token.get("rstrip") or token.get("single_word"):
                raise ValueError(f"added token {token['content']!r} asks for matching that is not supported")
            self.special[token["content"]] = token["id"]
        self.strings = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, number in vocab.items():
            known = all(character in byte for character in token)
            self.strings[number] = b"".join(map(byte.get, token)) if known else token.encode()
        for token, number in self.special.items():
            self.strings[number] = token.encode()
        pattern = PIECES.replace(r"[^\s", rf"[^{SPACE}").replace(r"\S", rf"[^{SPACE}]").replace(r"\s", rf"[{SPACE}]")
        self.pattern = regex.compile(pattern)
        names = sorted(self.special, key=len, reverse=True)
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.known, self.symbols, self.bounds = Index(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def merged(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all pieces, one after the other, and the number of symbols of each."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.base[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            inner = owner[1:] == owner[:-1]
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbols), NONE)
            rank[:-1] = np.where(inner & (self.keys[at] == key), self.ranks[at], NONE)
            first = np.flatnonzero(np.concatenate(([True], ~inner)))
            sizes = np.diff(np.append(first, len(symbols)))
            lowest = np.minimum.reduceat(rank, first)
            open_ = np.repeat(lowest < NONE, sizes)
            done.append((owner[~open_], symbols[~open_]))
            chosen = open_ & (rank == np.repeat(lowest, sizes))
            # equal symbols in a row pair up from the left
            run = np.flatnonzero(chosen & ~np.concatenate(([False], chosen[:-1])))
            place = np.arange(len(symbols))
            begin = np.zeros(len(symbols), np.int64)
            begin[run] = run
            chosen &= (place - np.maximum.accumulate(begin)) % 2 == 0
            symbols[chosen] = self.made[rank[chosen]]
            keep = open_.copy()
            keep[1:] &= ~chosen[:-1]
            symbols, owner = symbols[keep], owner[keep]
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(pieces), np.int64)
        owners, found = (np.concatenate(part) for part in zip(*done, strict=True))
        order = np.argsort(owners, kind="stable")
        return found[order].astype(np.int32), np.bincount(owners, minlength=len(pieces))

    def _numbered(self, text: str) -> list[int]:
        """The pieces of a text by their numbers in ``known``."""
        cut = (self.pattern if NOT_PLAIN.search(text) else PLAIN_PIECES).findall
        if self.splitter is None or not any(name in text for name in self.special):
            return list(map(self.known.__getitem__, cut(text)))
        numbers: list[int] = []
        for i, part in enumerate(self.splitter.split(text)):
            if i % 2:
                numbers.append(-1 - self.special[part])
            elif part:
                numbers += map(self.known.__getitem__, cut(part))
        return numbers

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of every text."""
        if len(self.known) > KNOWN_PIECES:  # what a worker remembers stays bounded; results do not depend on it
            self.known, self.symbols, self.bounds = Index(), np.zeros(0, np.int32), np.zeros(1, np.int64)
        before = len(self.known)
        numbered = [np.array(self._numbered(text) if text else [], np.int64) for text in texts]
        new = [piece.encode() for piece in list(self.known)[before:]]
        if new:
            symbols, counts = self.merged(new)
            self.symbols = np.concatenate((self.symbols, symbols))
            self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(counts)))
        return [self._ids(numbers) for numbers in numbered]

    def _ids(self, numbers: np.ndarray) -> np.ndarray:
        special = numbers < 0
        piece = np.where(special, 0, numbers)
        if special.all():
            return (-1 - numbers).astype(np.int32)
        start = self.bounds[piece]
        count = np.where(special, 1, self.bounds[piece + 1] - start)
        ends = np.cumsum(count)
        at = np.arange(ends[-1]) - np.repeat(ends - count - start, count)
        ids = self.symbols[np.minimum(at, len(self.symbols) - 1)]
        ids[(ends - count)[special]] = (-1 - numbers[special]).astype(np.int32)
        return ids

    def decode(self, ids: Sequence[int] | np.ndarray | None) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        if ids is None or len(ids) == 0:
            return ""
        return b"".join(map(self.strings.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once per Python worker."""
    return Vocabulary(path)


def encoded(text: Column, path: str) -> Column:
    """Ids of a text column as ``array<int>``, special tokens recognised, none added."""

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        vocab, values = vocabulary(path), texts.tolist()
        out: list[np.ndarray] = []
        for begin, end in slices(values, SLICE):
            out += vocab.encode(values[begin:end])
        return pd.Series(out, index=texts.index, dtype=object)

    return encode(text)


def decoded(ids: Column, path: str) -> Column:
    """Text of an ``array<int>`` column; special tokens are kept as text."""

    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        vocab = vocabulary(path)
        return pd.Series([vocab.decode(row) for row in rows], index=rows.index, dtype=object)

    return decode(ids)


def round_trip(documents: DataFrame, text: str, path: str, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep``, the ids of the text, and the text that the ids decode to.

    One pass through Python for both, which hands on a slice of texts at a time.
    """
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            values = batch.column(len(keep))
            lengths = [value.as_py() for value in pa.compute.binary_length(values)]
            for begin, end in slices([range(length or 0) for length in lengths], SLICE):
                rows = vocab.encode(values[begin:end].to_pylist())
                offsets = np.concatenate(([0], np.cumsum(list(map(len, rows)), dtype=np.int32))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows).astype(np.int32)))
                back = pa.array([vocab.decode(row) for row in rows], pa.string())
                part = [batch.column(i)[begin:end] for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*part, ids, back], [*keep, "ids", "decoded"])

    kept = documents.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join([f"`{field.name}` {field.dataType.simpleString()}" for field in kept.schema[:-1]]
                       + ["ids array<int>", "decoded string"])
    return kept.mapInArrow(both, schema)
