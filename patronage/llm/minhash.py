"""Near-duplicate documents: universal hash minima, banding, verification, components.

Every document becomes its set of five-word shingles (64-bit hashes). 128 universal
hash functions keep one minimum each; bands of four minima are bucket keys, so that
two documents of similarity 0.75 meet in at least one of 32 bands with a probability
of 1 - 5e-6, and more surely the more alike they are.

Documents with equal sets are one node, the smallest id, before anything is compared.
In a bucket every node is linked to the smallest one; the links are checked by their
signatures and then on the full sets. Components of the confirmed links are found by
alternating large-star and small-star steps. That settles nearly all buckets; where a
bucket still holds several components, the pairs across components are compared too,
so that no link is lost: sets of such buckets are cut into blocks, a task compares
two blocks at a time and returns confirmed links only.

Null or empty text and text without a word: empty set, linked with nothing. Fewer
words than a shingle: the whole sequence is the only shingle. Rows that repeat an id
are one document whose links are those of all its rows. Rows without an id link
nothing and are a component of their own (null). Long texts are used whole. Ties: of a
component the smallest id is kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import parts, staged, word_hashes, words_of
from patronage.llm.components import components

SHINGLE = 5
#: Similar: 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 32, 4
#: A longer signature, of one byte a minimum, decides which sets are compared at all.
CHECK, SLACK = 256, 0.12
BLOCK = 2048
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_HIGH = np.uint64(32)


def _mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    values = (values ^ values >> np.uint64(30)) * _MIX
    values = (values ^ values >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return values ^ values >> np.uint64(31)


def shingle_sets(texts: list[str | None], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle hashes, sorted within each text, and where each text's begin."""
    words, starts = words_of(texts, lower=True)
    hashes, counts = word_hashes(words), np.diff(starts)
    owner = np.repeat(np.arange(len(texts)), counts)
    size = len(hashes) - shingle + 1
    key = np.zeros(max(size, 0), np.uint64)
    for step in range(shingle if size > 0 else 0):
        key = key * _STEP + hashes[step:step + size]
    inside = owner[:size] == owner[shingle - 1:] if size > 0 else np.zeros(0, bool)
    keys, of = [_mixed(key[inside])], [owner[:max(size, 0)][inside]]
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    whole = [int(np.bitwise_xor.reduce(_mixed(hashes[starts[i]:starts[i + 1]] * _STEP
                                              + np.arange(1, counts[i] + 1, dtype=np.uint64)))) for i in short]
    keys.append(_mixed(np.array(whole, np.uint64) + np.uint64(shingle)))
    of.append(short)
    key, of = np.concatenate(keys), np.concatenate(of)
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    key, of = key[new], of[new]
    return key, np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(texts)))))


def hash_functions(count: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and terms of ``count`` universal hash functions on 64 bits."""
    draw = np.random.default_rng(seed).integers(0, 2 ** 63, (2, count), np.uint64, endpoint=True)
    return draw[0] << np.uint64(1) | np.uint64(1), draw[1]


def signatures(keys: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """The upper 32 bits of every function's minimum, one row per non-empty set."""
    begin = starts[:-1][np.diff(starts) > 0]
    minima = np.empty((len(begin), count), np.uint32)
    if len(begin):
        for i, (factor, term) in enumerate(zip(*hash_functions(count), strict=True)):
            minima[:, i] = np.minimum.reduceat(keys * factor + term, begin) >> _HIGH
    return minima


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to set size, set digest and band keys; the keys of an empty set are null."""
    for batch in batches:
        ids, end = batch.column(0), 0
        for texts in parts(batch.column(1)):
            begin, end = end, end + len(texts)
            keys, starts = shingle_sets(texts)
            sizes = np.diff(starts)
            filled = sizes > 0
            minima = signatures(keys, starts, BANDS * ROWS).reshape(-1, BANDS, ROWS).astype(np.uint64)
            bands = np.zeros(minima.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for row in range(ROWS):
                bands = _mixed(bands ^ minima[:, :, row] * _STEP)
            digests = np.zeros((2, end - begin), np.uint64)
            if filled.any():
                first = starts[:-1][filled]
                digests[0][filled] = np.add.reduceat(_mixed(keys ^ _STEP), first)
                digests[1][filled] = np.add.reduceat(_mixed(keys * _MIX), first)
            offsets = pa.array(np.concatenate(([0], np.cumsum(filled * BANDS))), pa.int32())
            yield pa.RecordBatch.from_arrays([
                ids[begin:end], pa.array(sizes, pa.int64()), pa.array(digests[0].view(np.int64)),
                pa.array(digests[1].view(np.int64)),
                pa.ListArray.from_arrays(offsets, pa.array(bands.ravel().view(np.int64))),
            ], ["doc_id", "n_shingles", "digest", "digest2", "bands"])


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to the full set and its longer signature, both as bytes; empty sets are left out."""
    for batch in batches:
        ids, end = batch.column(0), 0
        for texts in parts(batch.column(1)):
            begin, end = end, end + len(texts)
            keys, starts = shingle_sets(texts)
            filled = np.flatnonzero(np.diff(starts) > 0)
            short = signatures(keys, starts, CHECK).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([
                ids[begin:end].take(pa.array(filled)),
                pa.array([row.tobytes() for row in short], pa.binary()),
                pa.array([keys[starts[i]:starts[i + 1]].tobytes() for i in filled], pa.binary()),
            ], ["rep", "signature", "shingles"])


def _similar(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the other sorted sets are similar to the one, on all elements."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    common = np.add.reduceat((one[at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
    return 100 * common >= percent * (len(one) + sizes - common)


def _candidates(signature: np.ndarray, size: int, signatures_: np.ndarray, sizes: np.ndarray,
                percent: int) -> np.ndarray:
    """Whose size and signature allow for similarity."""
    alike = 100 * np.minimum(size, sizes) >= percent * np.maximum(size, sizes)
    alike[alike] = (signatures_[alike] == signature).mean(axis=1) >= percent / 100 - SLACK
    return np.flatnonzero(alike)


def _confirmed(percent: int):
    """Keep the links whose two sets are similar."""
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("signature_a", "shingles_a", "signature_b",
                                                                   "shingles_b")]
            keep = []
            for sig_a, set_a, sig_b, set_b in zip(*columns, strict=True):
                one, other = np.frombuffer(set_a, np.uint64), np.frombuffer(set_b, np.uint64)
                sigs = np.frombuffer(sig_a, np.uint8), np.frombuffer(sig_b, np.uint8)[None]
                keep.append(len(_candidates(sigs[0], len(one), sigs[1], np.array([len(other)]), percent)) > 0
                            and bool(_similar(one, [other], percent)[0]))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)],
                                             ["a", "b"])
    return confirm


def _compare_tile(rows: list[dict], percent: int) -> list[tuple[int, int]]:
    """Links between different components in one tile: within block one, or between blocks one and two."""
    left = [row for row in rows if row["side"] == 0]
    right = [row for row in rows if row["side"] == 1]
    within = not right
    right = right or left
    sets = [np.frombuffer(row["shingles"], np.uint64) for row in right]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    short = np.frombuffer(b"".join(row["signature"] for row in right), np.uint8).reshape(len(right), -1)
    parts = np.array([row["component"] for row in right])
    links = []
    for i, row in enumerate(left):
        own = np.frombuffer(row["shingles"], np.uint64)
        after = i + 1 if within else 0
        other = after + np.flatnonzero(parts[after:] != row["component"])
        near = other[_candidates(np.frombuffer(row["signature"], np.uint8), len(own), short[other], sizes[other],
                                 percent)]
        if len(near):
            found = near[_similar(own, [sets[j] for j in near], percent)]
            links += [(row["rep"], right[j]["rep"]) for j in found]
    return links


def _compared(percent: int):
    """Compare tile by tile; the rows of a tile follow one another."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, []

        def links() -> pa.RecordBatch:
            found = _compare_tile(rows, percent) if rows else []
            return pa.RecordBatch.from_arrays([pa.array([link[0] for link in found], pa.int64()),
                                               pa.array([link[1] for link in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for row in batch.to_pylist():
                at = row["key"], row["tile"]
                if at != tile:
                    yield links()
                    tile, rows = at, []
                rows.append(row)
        yield links()
    return compare


def _crossing(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that share a bucket.

    ``rows`` has key, rep, component and blocks for buckets of several components. A
    bucket is cut into its number of blocks; every pair of blocks is a tile.
    """
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    placed = (rows.withColumn("block", block).withColumn("with", F.explode(others))
              .withColumn("side", F.when(F.col("block") <= F.col("with"), 0).otherwise(1))
              .withColumn("tile", F.least("block", "with").cast("long") * F.col("blocks") + F.greatest("block", "with")))
    full = placed.select("key", "tile", "side", "rep", "component").join(sets, "rep")
    ordered = full.repartition("key", "tile").sortWithinPartitions("key", "tile")
    return ordered.mapInArrow(_compared(percent), "a long, b long").distinct()


def near_duplicates(documents: DataFrame, doc_id: str, text: str, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the document is its component's smallest) of every row."""
    texts = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = staged(texts.mapInArrow(
        _sketched, "doc_id long, n_shingles long, digest long, digest2 long, bands array<long>"), "sketches")
    filled = F.col("n_shingles") > 0
    # what meets a hot key again is stored first: Spark splits large partitions of a join, not of a join on an aggregate
    copies = staged(sketches.filter(filled & F.col("doc_id").isNotNull()).groupBy("n_shingles", "digest", "digest2")
                    .agg(F.min("doc_id").alias("_rep"), F.count("*").alias("_copies")).filter("_copies > 1"), "copies")
    rep = F.coalesce("_rep", "doc_id")
    nodes = staged(sketches.join(copies, ["n_shingles", "digest", "digest2"], "left").select(
        "doc_id", "n_shingles", rep.alias("rep"), F.when(rep == F.col("doc_id"), F.col("bands")).alias("bands")),
        "nodes")

    banded = nodes.filter(F.col("bands").isNotNull()).select("rep", F.explode("bands").alias("key"))
    shared = staged(banded.groupBy("key").agg(F.min("rep").alias("_min"), F.max("rep").alias("_max"),
                                              F.count("*").alias("size")).filter("_min < _max").select("key", "size"),
                    "shared")
    buckets = staged(banded.join(shared, "key"), "buckets")
    # the more company a node has in its buckets, the nearer it is to the middle of its group
    company = staged(buckets.groupBy("rep").agg(F.sum("size").alias("company")), "company")
    sets = staged(texts.join(company.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
                  .mapInArrow(_with_sets, "rep long, signature binary, shingles binary"), "sets")

    leaders = (buckets.join(company, "rep").groupBy("key")
               .agg(F.max(F.struct(F.col("company"), -F.col("rep"))).alias("_top"))
               .select("key", (-F.col("_top").getField("col2")).alias("b")))
    stars = (buckets.join(leaders, "key").filter("rep <> b")
             .select(F.greatest("rep", "b").alias("a"), F.least("rep", "b").alias("b")).distinct())

    def side(name: str) -> DataFrame:
        return sets.select(F.col("rep").alias(name), F.col("signature").alias(f"signature_{name}"),
                           F.col("shingles").alias(f"shingles_{name}"))

    links = staged(stars.join(side("a"), "a").join(side("b"), "b").mapInArrow(_confirmed(percent), "a long, b long"),
                   "links")
    labels = components(links, "a", "b").withColumnRenamed("node", "rep")
    labelled = buckets.join(labels, "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component"))
    open_ = staged(labelled.groupBy("key").agg(
        F.min("component").alias("_min"), F.max("component").alias("_max"),
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("_min < _max").select("key", "blocks"), "open")
    crossing = _crossing(labelled.join(open_, "key"), sets, percent)

    copied = nodes.filter("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    whole = components(links.union(crossing).union(copied), "a", "b").select(
        F.col("node").alias("doc_id"), F.col("component").alias("_component"))
    component = F.coalesce("_component", "doc_id")
    return nodes.select("doc_id", "n_shingles").join(whole, "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
