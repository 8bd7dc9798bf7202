"""Nearest neighbours by vantage-point trees, one per shard.

Nearness is the inner product. One more coordinate makes all vectors of a shard
equally long, and then the nearest by Euclidean distance are those with the largest
inner product, so that the triangle inequality holds. A tree halves its vectors again
and again by their distance to a vantage point. A search leaves out the half that no
point within reach can lie in; ``factor`` stretches the distance to the border before
it is compared with the reach. Factor 1 leaves out only what cannot hold a neighbour
and is exact; larger factors leave out more and may miss some. They suit vectors of
about equal length; where lengths differ much, distances say less about products.

Every vector is in the tree of one shard, dealt out evenly whatever its id. Queries are packed
into blocks, and every shard is sent every block: the stated queries against all
vectors, block by block. A task holds one tree and one block at a time; per shard and
query only the best ``k`` come out. Equal
vectors are one point of a tree, which keeps the smallest ids it can need.

Vectors that are null, zero, or hold null or non-finite components take no part, nor
do rows without an id or with another number of dimensions than most have. Rows that
repeat an id are candidates each, never for a query of their own id. Ties go to the
smaller id. No vectors or no queries: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARD = 8192
BLOCK = 512
LEAF = 512
_NEAR = 1e-9


class Tree:
    """A vantage-point tree over distinct vectors; ``ids[i]`` are the ids of vector i, smallest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        rank = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
        keep = rank <= k  # one more than asked for, as a query's own id does not count
        point = np.cumsum(new)[keep] - 1
        vectors = vectors[new]
        self.k = k
        squares = (vectors ** 2).sum(axis=1)
        self.top = squares.max()
        self.lifted = np.concatenate((vectors, np.sqrt(np.maximum(self.top - squares, 0))[:, None]), axis=1)
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple] = []
        self.root = self._grow(0, len(vectors), np.random.default_rng(len(vectors)))
        place = np.empty(len(vectors), np.int64)
        place[self.order] = np.arange(len(vectors))
        by_place = np.argsort(place[point], kind="stable")
        self.ids = ids[keep][by_place]
        self.bounds = np.searchsorted(place[point][by_place], np.arange(len(vectors) + 1))
        self.vectors, self.lifted = vectors[self.order], self.lifted[self.order]

    def _grow(self, begin: int, end: int, draw: np.random.Generator) -> int:
        number = len(self.nodes)
        self.nodes.append((begin, end, None, 0.0, -1, -1))
        if end - begin > LEAF:
            rows = self.order[begin:end]
            vantage = self.lifted[rows[draw.integers(len(rows))]]
            distance = np.linalg.norm(self.lifted[rows] - vantage, axis=1)
            half = len(rows) // 2
            parted = np.argpartition(distance, half)
            self.order[begin:end] = rows[parted]
            border = float(distance[parted[half]])
            inner = self._grow(begin, begin + half, draw)
            outer = self._grow(begin + half, end, draw)
            self.nodes[number] = (begin, end, vantage, border, inner, outer)
        return number

    def search(self, query_ids: np.ndarray, queries: np.ndarray, factor: float) -> tuple[np.ndarray, ...]:
        """(query row, id, score) of the best ``k`` per query."""
        self.queries, self.query_ids, self.factor = queries, query_ids, factor
        self.lifted_queries = np.concatenate((queries, np.zeros((len(queries), 1))), axis=1)
        self.lengths = (queries ** 2).sum(axis=1)
        self.scores = np.full((len(queries), self.k), -np.inf)
        self.found = np.full((len(queries), self.k), np.iinfo(np.int64).max)
        self._visit(self.root, np.arange(len(queries)))
        row, column = np.nonzero(self.scores > -np.inf)
        return row, self.found[row, column], self.scores[row, column]

    def _reach(self, rows: np.ndarray) -> np.ndarray:
        """Distance within which a lifted vector would still be among the best."""
        worst = self.scores[rows, -1]
        squared = self.lengths[rows] + self.top - 2 * worst
        return np.where(worst > -np.inf, np.sqrt(np.maximum(squared, 0)) + _NEAR, np.inf)

    def _visit(self, number: int, rows: np.ndarray) -> None:
        begin, end, vantage, border, inner, outer = self.nodes[number]
        if not len(rows):
            return
        if vantage is None:
            self._compare(begin, end, rows)
            return
        gap = np.linalg.norm(self.lifted_queries[rows] - vantage, axis=1) - border
        inside = gap < 0
        self._visit(inner, rows[inside])
        self._visit(outer, rows[~inside])
        again = self.factor * np.abs(gap) <= self._reach(rows)
        self._visit(outer, rows[inside & again])
        self._visit(inner, rows[~inside & again])

    def _compare(self, begin: int, end: int, rows: np.ndarray) -> None:
        rough = self.queries[rows] @ self.vectors[begin:end].T
        row, point = np.nonzero(rough >= self.scores[rows, -1][:, None] - _NEAR)
        if not len(row):
            return
        score = exact_products(self.queries[rows[row]], self.vectors[begin + point])
        counts = self.bounds[begin + point + 1] - self.bounds[begin + point]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1]) - np.repeat(ends - counts - self.bounds[begin + point], counts)
        row, score, ids = np.repeat(rows[row], counts), np.repeat(score, counts), self.ids[at]
        other = ids != self.query_ids[row]
        row, score, ids = row[other], score[other], ids[other]
        touched = np.unique(row)
        row = np.concatenate((row, np.repeat(touched, self.k)))
        score = np.concatenate((score, self.scores[touched].ravel()))
        ids = np.concatenate((ids, self.found[touched].ravel()))
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        first = np.searchsorted(row, touched)
        best = first[:, None] + np.arange(self.k)
        self.scores[touched], self.found[touched] = score[best], ids[best]


def exact_products(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Row-wise inner products, added up in the order of the components wherever they are computed."""
    total = np.zeros(len(one))
    for i in range(one.shape[1]):
        total += one[:, i] * other[:, i]
    return total


def _usable(vector: Column) -> Column:
    """Not null, every component finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _packed(size: int):
    """Rows of a group (key, id, vector), which follow one another, to rows of at most ``size`` vectors as bytes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors = None, [], []

        def out() -> pa.RecordBatch:
            rows = [key] if ids else []
            return pa.RecordBatch.from_arrays([
                pa.array(rows, pa.int64()),
                pa.array([np.array(ids, np.int64).tobytes()] if ids else [], pa.binary()),
                pa.array([np.concatenate(vectors).tobytes()] if ids else [], pa.binary()),
            ], ["key", "ids", "vectors"])

        for batch in batches:
            keys, numbers = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            flat, offsets = batch.column(2).values.to_numpy(), batch.column(2).offsets.to_numpy()
            for i, (own, number) in enumerate(zip(keys, numbers, strict=True)):
                if own != key or len(ids) >= size:
                    yield out()
                    key, ids, vectors = own, [], []
                ids.append(number)
                vectors.append(flat[offsets[i]:offsets[i + 1]])
        yield out()
    return pack


def _searched(k: int, factor: float):
    """Per shard its vectors, then blocks of queries, to the best of the shard for each query."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = tree = None
        for batch in batches:
            for i in range(batch.num_rows):
                number, asks, raw_ids, raw = (batch.column(j)[i].as_py() for j in range(4))
                ids = np.frombuffer(raw_ids, np.int64)
                vectors = np.frombuffer(raw, np.float64).reshape(len(ids), -1)
                if not asks:
                    shard, tree = number, Tree(ids, vectors, k)
                elif number == shard:
                    row, found, score = tree.search(ids, vectors, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(found), pa.array(score)],
                                                     ["query_id", "id", "score"])
    return search


def nearest(vectors: DataFrame, id_: str, vector: str, is_query: Column, k: int, factor: float = 1.0,
            shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, id and score of the ``k`` rows nearest to every row that ``is_query`` holds for.

    ``shard`` and ``block`` are the number of vectors in a tree and of queries in a block.
    """
    usable = vectors.filter(F.col(id_).isNotNull() & _usable(F.col(vector))).select(
        F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("_asks"))
    sizes = usable.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n"), F.sum(F.col("_asks").cast("long")
                                                            ).alias("q")).orderBy(F.desc("n"), "d").first()
    empty = "query_id long, rank int, id long, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], empty)
    shards = -(-sizes["n"] // shard)
    blocks = max(-(-sizes["q"] // block), 1)
    same = usable.filter(F.size("vector") == sizes["d"])

    def grouped(rows: DataFrame, count: int, size: int) -> DataFrame:
        # by the place of the row, as any number of rows may share an id
        place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count)).cast("long")
        keyed = rows.select(place.alias("key"), "id", "vector")
        return keyed.repartition("key").sortWithinPartitions("key", "id").mapInArrow(
            _packed(size), "key long, ids binary, vectors binary")

    trees = grouped(same, shards, 1 << 40).select(F.col("key").alias("shard"), F.lit(False).alias("asks"), "ids",
                                                  "vectors")
    every = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))
    asking = grouped(same.filter("_asks"), blocks, 2 * block).select(
        F.explode(every).alias("shard"), F.lit(True).alias("asks"), "ids", "vectors")
    # a shard's tree comes first, then all blocks of queries: each is sent to a task once
    met = trees.unionByName(asking).repartition("shard").sortWithinPartitions("shard", "asks")
    best = met.mapInArrow(_searched(k, factor), "query_id long, id long, score double")
    entry = F.struct((-F.col("score")).alias("s"), F.col("id").alias("i"))
    # at most k rows per query and shard
    top = best.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, k).alias("_top"))
    return top.select("query_id", F.posexplode("_top").alias("_at", "_e")).select(
        "query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_e.i").alias("id"),
        (-F.col("_e.s")).alias("score"))
