"""Near-duplicate documents by SimHash fingerprints and pivot distance tables.

A text becomes its three-word shingles (repeats included), each hashed to 64 bits; a bit
of the fingerprint is set if it is set in over half of them. Documents whose
fingerprints differ in at most ``FAR`` bits are linked, and linked documents, directly
or over others, are one component.

Equal fingerprints are one node. For every node its Hamming distances to ``PIVOTS``
reference fingerprints are computed once and stored. Two fingerprints that differ in
``FAR`` bits have distances to any reference that differ by ``FAR`` at most; so a pair is
discarded as soon as one coordinate of its two rows in the table differs by more, and
what survives is verified by its bits.

The distances of unlike fingerprints to a reference lie close around 32, so no range of
one coordinate is a small part of the table, and a table alone would have all pairs to
discard. Which pairs meet is therefore told by the bits: of five parts of a fingerprint
two at least are equal where three bits differ, which makes ten keys per node, of 25
bits and more. Keys that one node has alone are dropped before any table is moved.
A key's nodes are cut into blocks; a task takes two blocks at a time and hands on a
spanning forest of their links, never all pairs.

Null, empty and blank texts have fingerprint zero, linked like any other; with fewer
words than a shingle the whole sequence is the only one. Long texts are used whole.
Rows that repeat an id are one document whose links are those of all its rows. Rows
without an id have a fingerprint, link nothing and are in no component (null). Ties: the
smallest id names a component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import parts, staged, words_of
from patronage.llm.components import components

SHINGLE, SEED = 3, 42
#: Fingerprints are linked that differ in so many bits at most.
FAR = 3
#: Reference fingerprints; every other bit pattern is as good, these are drawn once.
PIVOTS = np.random.default_rng(64).integers(0, (1 << 64) - 1, 32, np.uint64, endpoint=True)
#: First bit and length of the parts of a fingerprint.
PARTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
BLOCK = 2048
#: Bytes of text, and hashes, that a worker takes apart at a time.
PART, HASHES = 1_000_000, 1 << 17
_HASH = partial(xxhash.xxh64_intdigest, seed=SEED)


def shingle_hashes(texts: list[str | None], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles of all texts, and the number of each text's."""
    words, starts = words_of(texts, lower=True)
    counts = np.diff(starts)
    if len(words) >= shingle:
        grams = map(b" ".join, zip(*(words[step:] for step in range(shingle)), strict=False))
        hashes = np.fromiter(map(_HASH, grams), np.uint64, len(words) - shingle + 1)
    else:
        hashes = np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(texts)), counts)
    inside = owner[:len(hashes)] == owner[shingle - 1:shingle - 1 + len(hashes)]
    hashes, owner = hashes[inside], owner[:len(hashes)][inside]
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    whole = np.array([_HASH(b" ".join(words[starts[i]:starts[i + 1]])) for i in short], np.uint64)
    hashes, owner = np.concatenate((hashes, whole)), np.concatenate((owner, short))
    order = np.argsort(owner, kind="stable")
    return hashes[order], np.bincount(owner, minlength=len(texts))


def fingerprints(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """The bits that are set in over half of the shingles' hashes; zero without a shingle."""
    hashes, counts = shingle_hashes(texts, shingle)
    owner = np.repeat(np.arange(len(texts)), counts)
    ones = np.zeros((len(texts), 64), np.int64)
    for begin in range(0, len(hashes), HASHES):
        bits = np.unpackbits(hashes[begin:begin + HASHES, None].view(np.uint8), axis=1, bitorder="little")
        of = owner[begin:begin + HASHES]
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        ones[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def pivot_distances(prints: np.ndarray) -> np.ndarray:
    """A row per fingerprint: its Hamming distance to every reference."""
    return np.bitwise_count(prints[:, None] ^ PIVOTS)


def _fingerprinted(shingle: int):
    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin = 0
            for texts in parts(batch.column(1), PART):
                found = fingerprints(texts, shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin:begin + len(texts)], pa.array(found)],
                                                 ["doc_id", "fingerprint"])
                begin += len(texts)
    return fingerprint


def _tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with their row of the table."""
    for batch in batches:
        table = pivot_distances(batch.column(1).to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([row.tobytes() for row in table], pa.binary())],
                                         [*batch.schema.names, "distances"])


def keys(fingerprint: Column) -> Column:
    """A key per two parts of the fingerprint: which parts, and their bits."""
    part = [F.shiftrightunsigned(fingerprint, begin).bitwiseAND(F.lit((1 << length) - 1).cast("long"))
            for begin, length in PARTS]
    return F.array(*[
        F.shiftleft(F.lit(number).cast("long"), 32).bitwiseOR(F.shiftleft(part[one], 16)).bitwiseOR(part[other])
        for number, (one, other) in enumerate(combinations(range(len(PARTS)), 2))])


def survivors(one: int, others: np.ndarray, table: np.ndarray, far: int) -> np.ndarray:
    """Those of ``others`` whose row of the table differs from that of ``one`` by ``far`` at most in every coordinate."""
    for begin in range(0, table.shape[1], 4):  # most are gone after a few coordinates
        gap = np.abs(table[others, begin:begin + 4] - table[one, begin:begin + 4])
        others = others[(gap <= far).all(axis=1)]
    return others


def forest(prints: np.ndarray, table: np.ndarray, far: int = FAR) -> list[tuple[int, int]]:
    """Links that connect what pairs of at most ``far`` bits connect, one less than nodes per component."""
    order = np.argsort(table[:, 0], kind="stable")  # who is near in the first coordinate follows one another
    prints, table = prints[order], table[order].astype(np.int8)
    first = table[:, 0]
    left = np.ones(len(order), bool)  # not reached yet
    links = []
    for seed in range(len(order)):
        if not left[seed]:
            continue
        left[seed] = False
        open_ = [seed]
        while open_:
            one = open_.pop()
            begin, end = np.searchsorted(first, (first[one] - far, first[one] + far + 1))
            near = survivors(one, begin + np.flatnonzero(left[begin:end]), table, far)
            near = near[np.bitwise_count(prints[near] ^ prints[one]) <= far]
            left[near] = False
            open_ += near.tolist()
            links += [(int(order[one]), other) for other in order[near].tolist()]
    return links


def _linked(far: int):
    """The rows of a tile, which follow one another, to a spanning forest of their links."""
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, []

        def links() -> pa.RecordBatch:
            reps = np.concatenate([np.zeros(0, np.int64), *[rows[0] for rows in held]])
            prints = np.concatenate([np.zeros(0, np.uint64), *[rows[1] for rows in held]])
            table = np.concatenate([np.zeros((0, len(PIVOTS)), np.uint8), *[rows[2] for rows in held]])
            pairs = np.array(forest(prints, table, far), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(reps[pairs[:, 0]]), pa.array(reps[pairs[:, 1]])], ["a", "b"])

        for batch in batches:
            place = np.stack([batch.column(i).to_numpy() for i in (0, 1)])
            reps, prints = batch.column(2).to_numpy(), batch.column(3).to_numpy().view(np.uint64)
            table = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, len(PIVOTS))
            cuts = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if begin == end:
                    continue
                at = place[0, begin], place[1, begin]
                if at != tile:
                    yield links()
                    tile, held = at, []
                held.append((reps[begin:end], prints[begin:end], table[begin:end]))
        yield links()
    return link


def near_duplicates(documents: DataFrame, doc_id: str, text: str, far: int = FAR, shingle: int = SHINGLE,
                    block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (long) and component_id of every row.

    ``far`` is at most the number of parts less two; ``block`` bounds the nodes that a
    task compares with each other, two blocks at a time.
    """
    if not 0 <= far <= len(PARTS) - 2:
        raise ValueError("of the parts of a fingerprint two must stay equal")
    texts = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = staged(texts.mapInArrow(_fingerprinted(shingle), "doc_id long, fingerprint long"), "fingerprints")
    named = rows.filter(F.col("doc_id").isNotNull())
    # what meets a hot fingerprint is stored, so that Spark can split the join
    nodes = staged(named.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")).select("rep", "fingerprint")
                   .mapInArrow(_tabled, "rep long, fingerprint long, distances binary"), "nodes")

    banded = nodes.select("rep", "fingerprint", F.explode(keys(F.col("fingerprint"))).alias("key"))
    shared = staged(banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
                    .select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "shared")
    placed = banded.join(shared, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # nodes of a single block meet there; else every block meets every other, and thereby itself
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block")))
    tile = F.least("block", "_with").cast("long") * F.col("blocks") + F.greatest("block", "_with")
    tiles = (placed.withColumn("_with", F.explode(others)).select("key", tile.alias("tile"), "rep")
             .join(nodes, "rep").select("key", "tile", "rep", "fingerprint", "distances"))
    near = tiles.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(
        _linked(far), "a long, b long")

    # an id with several fingerprints links them
    several = staged(named.groupBy("doc_id").agg(F.min("fingerprint").alias("_min"), F.max("fingerprint").alias("_max"))
                     .filter("_min < _max").select("doc_id"), "several")
    own = named.join(several, "doc_id").distinct().join(nodes, "fingerprint").select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(reduce(DataFrame.union, [near, own]), "a", "b")
    labels = staged(nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "fingerprint", F.coalesce("component", "rep").alias("component_id")), "labels")
    joined = rows.join(labels, "fingerprint", "left")
    return joined.select("doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
                         .alias("component_id"))


def as_hex(fingerprint: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
