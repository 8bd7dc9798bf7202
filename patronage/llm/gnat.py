"""Hard negatives by multiway hyperplane trees (GNAT).

An anchor's positives are the rows of its label with the largest inner products, its
hard negatives rows of other labels whose product lies in a window set by a positive's.
By the cosine law a window of products is, for rows of known lengths, a ring of
distances around the anchor; rings are what the trees are searched with.

A node holds a few split points that lie far apart; every row goes to the nearest one,
so the borders are hyperplanes. For every split point and every child the node stores
the range of distances between the point and the child's rows. With the anchor's distance to a
point, the range bounds the distance between anchor and rows; the tightest bounds over
all points either meet the ring or the child is left out. Leaves are compared exactly.

The first level of the tree is the table itself: its split points are a bounded sample,
all rows are dealt to the nearest, and the ranges of that level are aggregated in
Spark. The rows of a split point are cut into shards of bounded size, each with a tree of
its own. Anchors are sent, in blocks, to the shards whose ranges meet their ring alone:
first to those of their own split point, whose k-th best then narrows the ring for the
others. Vectors without structure leave nothing out; the work is then anchors times
rows, block by block.

Rows without id, label or vector, with null or non-finite components, or with another
number of dimensions than most, take no part. Of rows that repeat an id the one with the
smallest label, then vector, counts. Equal products go by the smaller id. Fewer rows than
asked for: all there are. No rows or no anchors: no rows. Products of whole-number components
are exact below 2**53 and stay between -2**63 and 2**63 - 1.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patronage.llm.common import staged

#: Rows per shard, anchors per block, split points of the first level (at most) and of a node, rows of a leaf.
SHARD, BLOCK, TOP, FANOUT, LEAF = 4096, 256, 256, 8, 256
POSITIVES, NEGATIVES = 5, 10
#: A negative has between so many and so many percent of the positive's product.
WINDOW = (30, 90)
_EXACT = 2.0 ** 53
_SLACK = 1e-7


class Asks(NamedTuple):
    """Searches: (anchor, positive) of each, its label, lowest and highest product, and the anchor's vector."""

    ids: np.ndarray
    labels: np.ndarray
    rings: np.ndarray
    vectors: np.ndarray


def products(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Inner products of all rows of one with all rows of the other, exact for whole numbers."""
    lengths = [np.sqrt((each ** 2).sum(axis=1).max(initial=0)) for each in (one, other)]
    if lengths[0] * lengths[1] < _EXACT:
        return one @ other.T
    whole = [np.array([[int(x) for x in row] for row in each], object).reshape(each.shape) for each in (one, other)]
    limit = 2 ** 63 - 1
    return np.clip(whole[0] @ whole[1].T, -limit - 1, limit)


def distances(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    squares = (one ** 2).sum(axis=1)[:, None] + (other ** 2).sum(axis=1) - 2 * (one @ other.T)
    return np.sqrt(np.maximum(squares, 0))


def far_apart(vectors: np.ndarray, count: int) -> np.ndarray:
    """Places of up to ``count`` different vectors, each the farthest from those before it."""
    chosen = [0]
    gap = distances(vectors, vectors[:1])[:, 0]
    while len(chosen) < count and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, distances(vectors, vectors[chosen[-1:]])[:, 0])
    return np.array(chosen)


def bounds(gaps: np.ndarray, low: np.ndarray, high: np.ndarray, squares: np.ndarray, least: np.ndarray,
           most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest product that an anchor can have with a row of each child.

    ``gaps`` are the anchors' distances to the split points, ``low`` and ``high`` the
    ranges of split points (rows) and children (columns), ``squares`` the anchors'
    squared lengths, ``least`` and ``most`` those of the children's rows.
    """
    near = np.maximum(np.maximum(low[None] - gaps[:, :, None], gaps[:, :, None] - high[None]).max(axis=1), 0)
    far = (gaps[:, :, None] + high[None]).min(axis=1)
    slack = _SLACK * (squares[:, None] + most + 1)  # distances are rounded, products are not
    return ((squares[:, None] + least - far ** 2) / 2 - slack, (squares[:, None] + most - near ** 2) / 2 + slack)


class Gnat:
    """A tree over rows of one shard."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.squares = (vectors ** 2).sum(axis=1)
        self.root = self._grow(np.arange(len(ids)))

    def _grow(self, rows: np.ndarray) -> tuple:
        if len(rows) <= LEAF:
            return (rows,)
        sample = rows[:: -(-len(rows) // (8 * FANOUT))]
        points = self.vectors[sample[far_apart(self.vectors[sample], FANOUT)]]
        gaps = distances(self.vectors[rows], points)
        own = np.argmin(gaps, axis=1)
        parts = [np.flatnonzero(own == child) for child in range(len(points))]
        parts = [part for part in parts if len(part)]
        if len(parts) < 2:  # alike, or as good as
            return (rows,)
        low = np.stack([gaps[part].min(axis=0) for part in parts], axis=1)
        high = np.stack([gaps[part].max(axis=0) for part in parts], axis=1)
        least, most = (np.array([pick(self.squares[rows[part]]) for part in parts]) for pick in (np.min, np.max))
        return points, low, high, least, most, [self._grow(rows[part]) for part in parts]

    def search(self, asks: Asks, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the search, id, product) of the first ``k`` rows of the same or of other labels in each ring."""
        self.asks, self.k, self.same, self.compared = asks, k, same, 0
        self.lengths = (asks.vectors ** 2).sum(axis=1)
        self.best = np.full((len(asks.ids), k), -np.inf)
        self.found = np.full((len(asks.ids), k), np.iinfo(np.int64).max)
        self._visit(self.root, np.arange(len(asks.ids)))
        row, column = np.nonzero(self.best > -np.inf)
        return row, self.found[row, column], self.best[row, column]

    def _floor(self, rows: np.ndarray) -> np.ndarray:
        """The product that a row needs to be among the first of the ring."""
        return np.maximum(self.asks.rings[rows, 0], self.best[rows, -1])

    def _visit(self, node: tuple, rows: np.ndarray) -> None:
        if len(node) == 1:
            self._compare(node[0], rows)
            return
        points, low, high, least, most, children = node
        lowest, highest = bounds(distances(self.asks.vectors[rows], points), low, high, self.lengths[rows], least, most)
        # the nearest children first, as what they hold narrows the ring
        for child in np.argsort(-highest.mean(axis=0)):
            meets = (highest[:, child] >= self._floor(rows)) & (lowest[:, child] <= self.asks.rings[rows, 1])
            if meets.any():
                self._visit(children[child], rows[meets])

    def _compare(self, points: np.ndarray, rows: np.ndarray) -> None:
        self.compared += len(points) * len(rows)
        score = products(self.asks.vectors[rows], self.vectors[points])
        alike = self.asks.labels[rows][:, None] == self.labels[points]
        ring = self.asks.rings[rows]
        fits = ((alike == self.same) & (self.asks.ids[rows, 0][:, None] != self.ids[points])
                & (score >= self._floor(rows)[:, None]) & (score <= ring[:, 1:]))
        row, point = np.nonzero(fits)
        if not len(row):
            return
        touched = np.unique(rows[row])
        ask = np.concatenate((rows[row], np.repeat(touched, self.k)))
        value = np.concatenate((score[row, point].astype(float), self.best[touched].ravel()))
        ids = np.concatenate((self.ids[points[point]], self.found[touched].ravel()))
        order = np.lexsort((ids, -value, ask))
        first = np.searchsorted(ask[order], touched)
        top = order[first[:, None] + np.arange(self.k)]
        self.best[touched], self.found[touched] = value[top], ids[top]


# rows that travel to a shard: its own (asks is false) or searches, arrays as bytes
_PAYLOAD = "shard long, asks boolean, ids binary, labels binary, rings binary, vectors binary"


def _payload(shards: Sequence[int], asks: bool, parts: Sequence[Asks]) -> pa.RecordBatch:
    columns = [pa.array([np.ascontiguousarray(array).tobytes() for array in arrays], pa.binary())
               for arrays in (list(zip(*parts, strict=True)) or [[]] * 4)]
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array([asks] * len(shards), pa.bool_()), *columns],
                                      [field.split()[0] for field in _PAYLOAD.split(", ")])


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a shard (shard, id, label, vector), which follow one another, in one row."""
    shard, held = None, []

    def out() -> pa.RecordBatch:
        if not held:
            return _payload([], False, [])
        ids, labels, vectors = (np.concatenate([part[i] for part in held]) for i in range(3))
        return _payload([shard], False, [Asks(ids, labels, np.zeros(0), vectors)])

    for batch in batches:
        numbers = batch.column(0).to_numpy()
        columns = batch.column(1).to_numpy(), batch.column(2).to_numpy(), _matrix(batch.column(3))
        cuts = (np.flatnonzero(np.diff(numbers)) + 1).tolist()
        for begin, end in zip([0, *cuts], [*cuts, len(numbers)], strict=True):
            if begin == end:
                continue
            if numbers[begin] != shard:
                yield out()
                shard, held = int(numbers[begin]), []
            held.append([column[begin:end] for column in columns])
    yield out()


def _searched(k: int, same: bool):
    """Per shard its rows, then blocks of searches, to the first rows of the shard for each search."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = tree = None
        for batch in batches:
            for i in range(batch.num_rows):
                number, asks, ids, labels, rings, vectors = (column[i].as_py() for column in batch.columns)
                labels = np.frombuffer(labels, np.int64)
                vectors = np.frombuffer(vectors, float).reshape(len(labels), -1)
                if not asks:
                    shard, tree = number, Gnat(np.frombuffer(ids, np.int64), labels, vectors)
                elif number == shard:
                    pairs = np.frombuffer(ids, np.int64).reshape(-1, 2)
                    row, found, score = tree.search(
                        Asks(pairs, labels, np.frombuffer(rings, float).reshape(-1, 2), vectors), k, same)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(pairs[row, 0]), pa.array(pairs[row, 1]), pa.array(found),
                         pa.array(np.clip(score, -2.0 ** 63, 2.0 ** 63 - 1024).astype(np.int64))],
                        ["anchor_id", "positive_id", "id", "score"])
    return search


class Index(NamedTuple):
    """All rows in shards, and the ranges of the first level."""

    shards: DataFrame  # shard and arrays as bytes
    points: np.ndarray  # split points
    low: np.ndarray  # ranges of distances, split points by children
    high: np.ndarray
    least: np.ndarray  # squared lengths per child
    most: np.ndarray
    numbers: list[range]  # shards of every child

    def sent(self, asks: DataFrame, own: bool) -> DataFrame:
        """Searches (anchor_id, positive_id, label, low, high, vector) as blocks per shard that can hold a row.

        ``own`` sends them to the shards of the nearest split point only, else to all other ones.
        """
        points, low, high, least, most, numbers = self[1:]

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for begin in range(0, whole.num_rows, BLOCK):
                    batch = whole.slice(begin, BLOCK)
                    part = Asks(np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1), batch.column(2).to_numpy(),
                                np.stack([batch.column(i).to_numpy() for i in (3, 4)], axis=1), _matrix(batch.column(5)))
                    gaps = distances(part.vectors, points)
                    lowest, highest = bounds(gaps, low, high, (part.vectors ** 2).sum(axis=1), least, most)
                    meets = (highest >= part.rings[:, :1]) & (lowest <= part.rings[:, 1:])
                    nearest = np.argmin(gaps, axis=1)[:, None] == np.arange(len(points))
                    meets &= nearest if own else ~nearest
                    for child in np.flatnonzero(meets.any(axis=0)).tolist():
                        some = Asks(*[array[meets[:, child]] for array in part])
                        for number in numbers[child]:
                            yield _payload([number], True, [some])

        return asks.select("anchor_id", "positive_id", "label", "low", "high", "vector").mapInArrow(send, _PAYLOAD)

    def search(self, asks: DataFrame, k: int, same: bool, own: bool) -> DataFrame:
        """anchor_id, positive_id, id, score: at most ``k`` rows per search and shard."""
        met = self.shards.unionByName(self.sent(asks, own)).repartition("shard").sortWithinPartitions("shard", "asks")
        return met.mapInArrow(_searched(k, same), "anchor_id long, positive_id long, id long, score long")


def usable(vector: Column) -> Column:
    """Not null, every component there and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def usable_rows(rows: DataFrame, id_: str, label: str, vector: str) -> DataFrame:
    """id, label and vector (doubles) of the rows that take part, an id once; stored."""
    named = rows.select(F.col(id_).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                        F.col(vector).cast("array<double>").alias("vector"))
    whole = staged(named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))), "usable")
    sizes = whole.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    same = whole.filter(F.size("vector") == (sizes["d"] if sizes else 0))
    again = staged(same.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "again")
    once = (same.join(again, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r"))
            .select("id", "r.label", "r.vector"))
    return same.join(again, "id", "left_anti").unionByName(once)


def index(rows: DataFrame, shard: int = SHARD, top: int = TOP) -> Index | None:
    """Deal rows (id, label, vector) to split points and shards; None without rows.

    The split points are ``top`` rows at most, drawn by a hash of the id; every row is dealt out.
    """
    count = rows.count()
    if not count:
        return None
    drawn = rows.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(min(top, -(-count // shard))).select("vector").collect()
    points = np.unique(np.array([row["vector"] for row in drawn], float), axis=0)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [] if not batch.num_rows else np.argmin(distances(_matrix(batch.column(2)), points), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], ["id", "label", "vector", "child"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers, squared lengths and distances to the split points per child, of the rows of a task."""
        count = np.zeros(len(points), np.int64)
        low, high = np.full((len(points),) * 2, np.inf), np.zeros((len(points),) * 2)
        least, most = np.full(len(points), np.inf), np.zeros(len(points))
        for batch in batches:
            if not batch.num_rows:
                continue
            child, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1))
            gaps, squares = distances(vectors, points), (vectors ** 2).sum(axis=1)
            np.add.at(count, child, 1)
            for pick, into, values in ((np.minimum, least, squares), (np.maximum, most, squares),
                                       (np.minimum, low, gaps), (np.maximum, high, gaps)):
                pick.at(into, child, values)
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(count[seen]), pa.array(least[seen]), pa.array(most[seen]),
             *[pa.array(list(each[seen]), pa.list_(pa.float64())) for each in (low, high)]],
            ["child", "n", "least", "most", "low", "high"])

    dealt = staged(rows.select("id", "label", "vector").mapInArrow(
        deal, "id long, label long, vector array<double>, child long"), "dealt")
    at = range(len(points))
    ranges = dealt.select("child", "vector").mapInArrow(
        measure, "child long, n long, least double, most double, low array<double>, high array<double>").groupBy(
        "child").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"),
                     F.array(*[F.min(F.col("low")[i]) for i in at]).alias("low"),
                     F.array(*[F.max(F.col("high")[i]) for i in at]).alias("high")).collect()  # one row per split point
    low, high, least, most = (np.zeros(shape) for shape in [(len(points),) * 2] * 2 + [len(points)] * 2)
    sizes = [0] * len(points)  # a split point without a row has no shard to be sent to
    for row in ranges:
        child = row["child"]
        low[:, child], high[:, child], least[child], most[child] = row["low"], row["high"], row["least"], row["most"]
        sizes[child] = -(-row["n"] // shard)
    ends = np.cumsum(sizes).tolist()
    numbers = [range(end - size, end) for end, size in zip(ends, sizes, strict=True)]
    begin = F.array(*[F.lit(each.start).cast("long") for each in numbers])
    several = F.array(*[F.lit(max(size, 1)).cast("long") for size in sizes])
    child = F.col("child").cast("int")
    number = F.get(begin, child) + F.pmod(F.xxhash64("id", F.lit(5)), F.get(several, child))
    shards = staged(dealt.select(number.alias("shard"), "id", "label", "vector").repartition("shard")
                    .sortWithinPartitions("shard", "id").mapInArrow(_packed, _PAYLOAD), "shards")
    return Index(shards, points, low, high, least, most, numbers)


def first(found: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """The ``k`` rows of every group with the largest score, ties by id, with their rank."""
    order = W.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, id_: str, label: str, vector: str, is_anchor: Column, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, shard: int = SHARD) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``is_anchor`` is a condition on the column ``id``; components are whole numbers.
    """
    taking = usable_rows(rows, id_, label, vector)
    found = index(taking, shard)
    if found is None:
        return rows.sparkSession.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    none, all_ = F.lit(float("-inf")), F.lit(float("inf"))
    anchors = staged(taking.filter(F.coalesce(is_anchor, F.lit(False))).select(
        F.col("id").alias("anchor_id"), F.col("id").alias("positive_id"), "label", "vector"), "anchors")

    near = staged(first(found.search(anchors.withColumns({"low": none, "high": all_}), positives, True, True),
                        ["anchor_id"], positives), "near")
    reached = near.filter(F.col("rank") == positives).select("anchor_id", F.col("score").cast("double").alias("_low"))
    narrowed = anchors.join(reached, "anchor_id", "left").withColumns({"low": F.coalesce("_low", none), "high": all_})
    rest = found.search(narrowed, positives, True, False)
    best = staged(first(near.drop("rank").unionByName(rest), ["anchor_id"], positives).select(
        "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    product = F.col("positive_score").cast("double")
    rings = best.withColumns({"low": F.ceil(product * window[0] / 100).cast("double"),
                              "high": F.floor(product * window[1] / 100).cast("double")})
    asks = staged(rings.filter("low <= high").join(anchors.drop("positive_id"), "anchor_id"), "asks")
    by = ["anchor_id", "positive_id"]
    near = staged(first(found.search(asks, negatives, False, True), by, negatives), "near")
    reached = near.filter(F.col("rank") == negatives).select(*by, F.col("score").cast("double").alias("_low"))
    narrowed = asks.join(reached, by, "left").withColumn("low", F.coalesce("_low", "low"))
    rest = found.search(narrowed, negatives, False, False)
    ranked = first(near.drop("rank").unionByName(rest), by, negatives)
    return ranked.join(best, by).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
                                        "positive_score", F.col("score").alias("negative_score"))
