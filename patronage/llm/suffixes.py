"""Passages that repeat across and within documents, by a sparse suffix array.

Of all suffixes only those are kept that begin at a minimiser: of 16 neighbouring
five-word grams the one with the smallest hash. Which positions that are depends on
the words around them alone, so any two copies of a passage keep suffixes at the same
places of it, and every window of ``LENGTH`` words has one among its first 16 places.

1. The kept suffixes are sorted by their first 35 words (as hashes), in ranges over
   all tasks; ties are spread by document and place. Equal neighbours are matches.
2. Matches are extended to the left and to the right: every window of ``LENGTH``
   words around a matching suffix is hashed (96 bits) and sorted with its document
   and place. The first in order is the source; all after it are repeats.
3. Overlapping repeats of a document join into spans.

So a span is reported exactly where each of its words lies in a window of ``LENGTH``
words that occurs earlier, in a smaller document or further up in the same one; the
first occurrence is never reported. Documents whose word sequences are equal are
sorted once, for the smallest id.

Null, empty and short texts have no spans. Rows without an id are left out. Of rows
that repeat an id one counts (of those with ``LENGTH`` words the smallest by its hashes).
Texts are used whole, however long. Of equal windows the one in the smallest document,
and furthest up in it, is the source. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patronage.llm.common import parts, staged, word_hashes, words_of

#: Words of the shortest passage that counts as repeated.
LENGTH = 50
GRAM, NEAR = 5, 16
_WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ values >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ values >> np.uint64(33)


class Rolling:
    """Hashes of any stretch of a sequence in constant time, by prefix sums modulo 2**64."""

    def __init__(self, values: np.ndarray, base: int):
        size = len(values) + 1
        powers = np.full(size, base, np.uint64)
        inverse = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        powers[0] = inverse[0] = 1
        self.powers = np.cumprod(powers, dtype=np.uint64)
        self.inverse = np.cumprod(inverse, dtype=np.uint64)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * self.powers[:-1], dtype=np.uint64)))

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[begin]) * self.inverse[begin])


class Words:
    """The words of some texts as hashes."""

    def __init__(self, texts: list[str | None]):
        words, self.starts = words_of(texts)
        self.hashes = word_hashes(words)
        self.rolling = [Rolling(_mixed(self.hashes + np.uint64(i)), base) for i, base in enumerate(_BASES)]

    def digests(self) -> list[np.ndarray]:
        return [rolling.of(self.starts[:-1], self.starts[1:]).view(np.int64) for rolling in self.rolling]

    def windows(self, length: int) -> np.ndarray:
        """Where a window of ``length`` words within one text begins."""
        counts = np.maximum(np.diff(self.starts) - length + 1, 0)
        return np.arange(counts.sum()) + np.repeat(self.starts[:-1] - np.cumsum(counts) + counts, counts)

    def minimisers(self, begins: np.ndarray, gram: int, near: int) -> np.ndarray:
        """For windows beginning there, the place of the smallest of their first ``near`` grams."""
        size = len(self.hashes) - gram + 1
        if size < near or not len(begins):
            return np.zeros(0, np.int64)
        at = np.arange(size)
        value, place, width = self.rolling[0].of(at, at + gram), at, 1
        while width < near:
            step = min(width, near - width)
            other, other_place = value[step:], place[step:]
            value, place = value[:len(other)], place[:len(other)]
            right = other < value  # of equal grams the left one counts
            value, place = np.where(right, other, value), np.where(right, other_place, place)
            width += step
        return place[begins]


def _suffixes(length: int):
    """(doc_id, text) to number of words, digests, and the kept suffixes with the hash of what they begin with."""
    head = length - NEAR + 1

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, end = batch.column(0), 0
            for texts in parts(batch.column(1)):
                begin, end = end, end + len(texts)
                words = Words(texts)
                kept = np.unique(words.minimisers(words.windows(length), GRAM, NEAR))
                keys = words.rolling[0].of(kept, kept + head).view(np.int64)
                bounds = np.searchsorted(kept, words.starts).astype(np.int32)
                places = kept - np.repeat(words.starts[:-1], np.diff(bounds))
                suffix = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(keys)], ["place", "key"])
                one, two = words.digests()
                yield pa.RecordBatch.from_arrays(
                    [ids[begin:end], pa.array(np.diff(words.starts)), pa.array(one), pa.array(two),
                     pa.ListArray.from_arrays(pa.array(bounds), suffix)],
                    ["doc_id", "n_words", "digest", "digest2", "suffixes"])
    return keep


def _matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, doc_id, place) to the rows whose neighbour has the same key.

    The first and the last row of a run may match rows of another run, so they stay;
    the next step looks at whole windows and drops what has no match.
    """
    held: tuple | None = None  # the last row seen, and whether it is already known to match
    for batch in batches:
        key, doc, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(key):
            continue
        known = True if held is None else held[3] or held[0] == key[0]
        if held is not None and known:
            yield _rows([held[1]], [held[2]])
        same = np.zeros(len(key), bool)
        same[1:] = key[1:] == key[:-1]
        match = same.copy()
        match[:-1] |= same[1:]
        match[0] |= held is None or held[0] == key[0]
        yield _rows(doc[:-1][match[:-1]], place[:-1][match[:-1]])
        held = key[-1], doc[-1], place[-1], bool(match[-1])
    if held is not None:
        yield _rows([held[1]], [held[2]])


def _rows(docs, places) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(places, pa.int32())], ["doc_id", "place"])


def _extended(length: int):
    """(doc_id, text, places of matching suffixes) to all windows of ``length`` words that begin near one.

    Two more columns have the digests of the row that counts, for ids of several rows.
    """
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places, end = batch.column(0).to_numpy(), batch.column(2), 0
            for texts in parts(batch.column(1)):
                begin, end = end, end + len(texts)
                words = Words(texts)
                windows = words.windows(length)
                found = words.minimisers(windows, GRAM, NEAR)
                matched = np.zeros(len(words.hashes) + 1, bool)
                digests = [digest.tolist() for digest in words.digests()]
                for i in range(begin, end):
                    wanted = tuple(batch.column(3 + j)[i].as_py() for j in range(2))
                    if wanted in ((None, None), (digests[0][i - begin], digests[1][i - begin])):
                        matched[words.starts[i - begin] + places[i].values.to_numpy()] = True
                windows = windows[matched[found]]
                owner = np.searchsorted(words.starts, windows, "right") - 1
                one, two = (rolling.of(windows, windows + length) for rolling in words.rolling)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array((two >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                     pa.array(ids[begin:end][owner]), pa.array((windows - words.starts[owner]).astype(np.int32))],
                    ["h", "h2", "doc_id", "start"])
    return extend


_LATER = "doc_id long, start int, source long, source_start int, run int, head boolean, h long, h2 int, edge boolean"


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (h, h2, doc_id, start, run) to all rows but the first of each window, with that first as source.

    A window may have begun in an earlier run: rows of a run's first window are marked
    ``head`` and its very first row is kept. One ``edge`` row per run tells its last
    window and where that was first seen.
    """
    names = [field.split()[0] for field in _LATER.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.bool_()]

    def out(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    first = last = run = None  # (h, h2) of the run's first window; (h, h2, doc, start) where the last was first seen
    for batch in batches:
        h, h2, doc, start, runs = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        if not len(h):
            continue
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
        new[0] = last is None or (h[0], h2[0]) != last[:2]
        at = np.where(new, np.arange(len(h)), -1)
        at = np.maximum.accumulate(at)
        source, source_start = doc[np.maximum(at, 0)].copy(), start[np.maximum(at, 0)].copy()
        if not new[0]:
            source[at < 0], source_start[at < 0] = last[2], last[3]
        opening = first is None
        if opening:
            first, run = (h[0], h2[0]), int(runs[0])
        head = (h == first[0]) & (h2 == first[1])
        keep = ~new
        keep[0] |= opening
        count = int(keep.sum())
        yield out(doc[keep], start[keep], source[keep], source_start[keep], np.full(count, run), head[keep], h[keep],
                  h2[keep], np.zeros(count, bool))
        last = h[-1], h2[-1], source[-1], source_start[-1]
    if last is not None:
        only = bool(last[0] == first[0] and last[1] == first[1])
        yield out([None], [None], [last[2]], [last[3]], [run], [only], [last[0]], [last[1]], [True])


def _carried(later: DataFrame) -> DataFrame:
    """Per run whose first window began in an earlier run, where it was first seen: one row per run at most."""
    edges = later.filter("edge").select("run", "h", "h2", "source", "source_start").orderBy("run").collect()
    firsts = {row["run"]: (row["h"], row["h2"]) for row in
              later.filter("head AND NOT edge").groupBy("run").agg(F.first("h").alias("h"), F.first("h2").alias("h2"))
              .collect()}
    carried, before = [], None
    for edge in edges:
        window = edge["h"], edge["h2"]
        seen = (edge["source"], edge["source_start"])
        if before is not None and firsts.get(edge["run"]) == before[0]:
            carried.append((edge["run"], *before[1]))
            if window == before[0]:
                seen = before[1]
        before = window, seen
    return later.sparkSession.createDataFrame(carried, "run int, _source long, _source_start int")


def repeated_spans(documents: DataFrame, doc_id: str, text: str, length: int = LENGTH) -> DataFrame:
    """One row per span of a document that repeats earlier text.

    doc_id, start_word, n_words, and source_doc_id and source_start: where the span's
    first window occurs first.
    """
    if length < NEAR + GRAM - 1:
        raise ValueError(f"length must be at least {NEAR + GRAM - 1} words")
    texts = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(
        F.col("doc_id").isNotNull())
    sketch = "doc_id long, n_words long, digest long, digest2 long, suffixes array<struct<place:int,key:long>>"
    all_rows = staged(texts.mapInArrow(_suffixes(length), sketch), "suffixes")
    long_ = all_rows.filter(F.col("n_words") >= length)
    least = F.min(F.when(F.col("n_words") >= length, F.struct("digest", "digest2", "n_words")))
    one = staged(all_rows.groupBy("doc_id").agg(least.alias("_d"), F.count("*").alias("_rows"))
                 .filter("_d IS NOT NULL").select("doc_id", "_d.*", "_rows"), "digests")
    # the row that counts, of ids that have several
    counting = staged(one.filter("_rows > 1").select("doc_id", F.col("digest").alias("_one"), F.col("digest2").alias("_two")),
                      "counting")
    # stored, so that Spark splits the join where one text has very many copies
    copies = staged(one.groupBy("digest", "digest2", "n_words")
                    .agg(F.min("doc_id").alias("rep"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "copies")
    copied = staged(one.join(copies, ["digest", "digest2", "n_words"]).filter("doc_id <> rep")
                    .select("doc_id", "n_words", "rep"), "copied")

    counts = F.col("_one").isNull() | (F.col("_one") == F.col("digest")) & (F.col("_two") == F.col("digest2"))
    kept = (long_.join(copied.select("doc_id"), "doc_id", "left_anti").join(counting, "doc_id", "left").filter(counts)
            .select("doc_id", F.inline("suffixes")))
    order = ["key", "doc_id", "place"]
    matching = (kept.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
                .mapInArrow(_matching, "doc_id long, place int"))
    near = matching.groupBy("doc_id").agg(F.collect_set("place").alias("places")).join(counting, "doc_id", "left")
    windows = staged(texts.join(near, "doc_id").select("doc_id", "text", "places", "_one", "_two").mapInArrow(
        _extended(length), "h long, h2 int, doc_id long, start int"), "windows")
    order = ["h", "h2", "doc_id", "start"]
    runs = (windows.repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("run", F.spark_partition_id()))
    later = staged(runs.mapInArrow(_later, _LATER), "later")
    carried = F.broadcast(_carried(later))  # at most one row per run
    repeats = (later.filter("NOT edge").join(carried, "run", "left")
               .withColumn("_from", F.when(F.col("head"), F.col("_source")))
               .select("doc_id", "start", F.coalesce("_from", "source").alias("source"),
                       F.when(F.col("_from").isNotNull(), F.col("_source_start")).otherwise(F.col("source_start"))
                       .alias("source_start"))
               .filter((F.col("doc_id") != F.col("source")) | (F.col("start") != F.col("source_start"))))

    by_start = W.partitionBy("doc_id").orderBy("start")
    apart = F.coalesce(F.col("start") > F.lag("start").over(by_start) + length, F.lit(True))
    islands = repeats.withColumn("_apart", apart.cast("int")).withColumn("_island", F.sum("_apart").over(by_start))
    spans = staged(islands.groupBy("doc_id", "_island").agg(
        F.min("start").alias("start_word"), (F.max("start") - F.min("start") + length).alias("n_words"),
        F.min(F.struct("start", "source", "source_start")).alias("_s")).select(
        "doc_id", F.col("start_word").cast("long"), F.col("n_words").cast("long"),
        F.col("_s.source").alias("source_doc_id"), F.col("_s.source_start").cast("long").alias("source_start")), "spans")
    opening = spans.filter("start_word = 0").select(F.col("doc_id").alias("rep"), "source_doc_id", "source_start")
    whole = copied.join(opening, "rep", "left").select(
        "doc_id", F.lit(0).cast("long").alias("start_word"), "n_words",
        F.coalesce("source_doc_id", "rep").alias("source_doc_id"),
        F.coalesce("source_start", F.lit(0)).cast("long").alias("source_start"))
    return spans.unionByName(whole)


def cut(text: Column, spans: Column) -> Column:
    """``text`` without spans given as ``array<struct<start_word,n_words>>``; no spans, no change."""

    @F.arrow_udf("string")
    def without(texts: pa.Array, rows: pa.Array) -> pa.Array:
        done, end = [], 0
        for some in parts(texts):
            begin, end = end, end + len(some)
            done.append(pa.array([_without(one, cuts) for one, cuts in
                                  zip(some, rows[begin:end].to_pylist(), strict=True)], pa.string()))
        return pa.concat_arrays([*done, pa.array([], pa.string())])

    # else Spark runs it once for a filter on the text and once more for the text, in two workers per task
    return without.asNondeterministic()(text, spans)


def _without(text: str | None, spans) -> str | None:
    if text is None or spans is None or len(spans) == 0:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    words = [match.span() for match in _WORD_BYTES.finditer(raw)]
    kept, at = [], 0
    for span in sorted(spans, key=lambda row: row["start_word"]):
        begin, end = span["start_word"], span["start_word"] + span["n_words"]
        kept.append(raw[at:words[begin][0]])
        at = words[end][0] if end < len(words) else len(raw)
        if at == len(raw):
            kept[-1] = kept[-1].rstrip()
    kept.append(raw[at:])
    return b"".join(kept).decode("utf-8", "surrogatepass")
