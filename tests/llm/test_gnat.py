"""Hard negatives against plain Python, what the ranges leave out, hot vectors and odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.llm.gnat import Asks, Gnat, bounds, distances, hard_negatives, index, products

NAN, INF = float("nan"), float("inf")


def by_hand(rows: list[tuple], step: int, positives: int = 5, negatives: int = 10) -> list[tuple]:
    """rows are (id, label, vector), each id once."""
    out = []
    for anchor, label, vector in rows:
        if anchor % step:
            continue
        scores = [(-int(sum(int(x) * int(y) for x, y in zip(vector, other, strict=True))), i, own)
                  for i, own, other in rows if i != anchor]
        for score, positive, _ in sorted(row for row in scores if row[2] == label)[:positives]:
            fits = sorted((s, i) for s, i, own in scores if own != label and 30 * -score <= 100 * -s <= 90 * -score)
            out += [(anchor, positive, rank, i, -score, -s) for rank, (s, i) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def clusters(seed: int, count: int, size: int = 12, spread: int = 12) -> list[tuple]:
    draw = random.Random(seed)
    middles = [[draw.randrange(-200, 200) for _ in range(size)] for _ in range(9)]
    rows = []
    for i in range(count):
        middle = middles[draw.randrange(9)]
        rows.append((i, draw.randrange(4), [float(x + draw.randrange(-spread, spread + 1)) for x in middle]))
    return rows


@pytest.fixture
def table(spark):
    def make(rows: list[tuple], partitions: int = 3):
        full = [(*row, "x", 1) for row in rows]
        return spark.createDataFrame(full, "key long, label int, v array<double>, id string, shard int").repartition(
            partitions)
    return make


def found(frame, step: int, **limits) -> list[tuple]:
    return sorted(map(tuple, hard_negatives(frame, "key", "label", "v", F.col("id") % step == 0, **limits).collect()))


@pytest.mark.parametrize(("shard", "spread"), [(4096, 12), (64, 12), (64, 300)])
def test_against_all_pairs(table, shard, spread):
    rows = clusters(shard, 700, spread=spread)
    got = found(table(rows), 20, shard=shard)
    assert got == by_hand(rows, 20) and len(got) > 500


def test_hot_vector_and_ties(table):
    """A third of the rows are one vector; products tie by id."""
    rows = [(i, label, [3.0, 4.0] if i % 3 == 0 else vector[:2]) for i, label, vector in clusters(2, 500)]
    assert found(table(rows, 6), 50, shard=32) == by_hand(rows, 50)


def test_odd_rows(table):
    rows = clusters(4, 60, size=3)
    odd = [(None, 1, [1.0, 2.0, 3.0]), (1000, None, [1.0, 2.0, 3.0]), (1001, 1, None), (1002, 1, [1.0, None, 3.0]),
           (1003, 1, [1.0, NAN, 3.0]), (1004, 2, [INF, 0.0, 0.0]), (1005, 2, [1.0]), (1006, 2, []),
           (1007, 3, [0.0, 0.0, 0.0]), (-10, 1, [5.0, 6.0, 7.0])]
    # of a repeated id the smallest label, then vector, counts
    again = [(rows[3][0], 9, [1.0, 1.0, 1.0]), (rows[10][0], *rows[10][1:]), (rows[20][0], rows[20][1], [900.0] * 3)]
    assert found(table([*rows, *odd, *again]), 10) == by_hand([*rows, *odd[-2:]], 10)
    assert found(table([]), 10) == [] and found(table(odd[:3]), 10) == []
    assert found(table([(0, 1, [1.0]), (1, 1, [2.0])]), 10) == []  # no other label
    assert found(table([(0, 1, [2.0]), (1, 1, [5.0]), (2, 2, [3.0]), (3, 2, [1.0])]), 10) == [(0, 1, 1, 2, 10, 6)]


def test_zero_and_negative_products(table):
    """Next to a positive at a right angle only negatives at right angles fit; beyond it none."""
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.0, 5.0]), (2, 1, [-3.0, 0.0]), (3, 2, [0.0, 7.0]), (4, 2, [-2.0, 0.0])]
    assert found(table(rows), 10) == [(0, 1, 1, 3, 0, 0)]


def test_products_of_large_numbers():
    one = np.array([[2.0 ** 40, 3.0], [1.0, 1.0]])
    assert products(one, one).tolist() == [[2 ** 63 - 1, 2 ** 40 + 3], [2 ** 40 + 3, 2]]
    small = np.arange(12.0).reshape(3, 4)
    assert (products(small, small) == small @ small.T).all()


def test_ranges_hold_and_leave_out():
    rows = clusters(8, 3_000)
    ids, labels = np.arange(3_000), np.array([row[1] for row in rows])
    vectors = np.array([row[2] for row in rows])
    tree = Gnat(ids, labels, vectors)

    def below(node: tuple) -> np.ndarray:
        return node[0] if len(node) == 1 else np.concatenate([below(child) for child in node[5]])

    def check(node: tuple) -> None:
        if len(node) == 1:
            return
        points, low, high, least, most, children = node
        gaps = distances(vectors[:40], points)
        lowest, highest = bounds(gaps, low, high, (vectors[:40] ** 2).sum(axis=1), least, most)
        for j, child in enumerate(children):
            score = vectors[:40] @ vectors[below(child)].T
            assert (score >= lowest[:, j:j + 1]).all() and (score <= highest[:, j:j + 1]).all()
            check(child)

    check(tree.root)
    assert sorted(below(tree.root).tolist()) == ids.tolist()
    pairs = np.stack([ids[:50], ids[:50]], axis=1)
    ring = np.sort(vectors[:50] @ vectors.T, axis=1)[:, [2_800, 2_900]]  # a ring of a hundred rows
    tree.search(Asks(pairs, labels[:50], ring, vectors[:50]), 10, False)
    assert tree.compared < 0.5 * 50 * 3_000


def test_first_level_leaves_shards_out(table):
    """Anchors are sent to the shards only that their rings meet."""
    rows = clusters(11, 2_000)
    frame = table(rows).select(F.col("key").alias("id"), F.col("label").cast("long").alias("label"),
                               F.col("v").alias("vector"))
    dealt = index(frame, shard=100)
    assert sum(map(len, dealt.numbers)) >= 20
    top = {i: max(sum(x * y for x, y in zip(v, w, strict=True)) for _, _, w in rows) for i, _, v in rows[:20]}
    asks = frame.filter("id < 20").select(F.col("id").alias("anchor_id"), F.col("id").alias("positive_id"), "label",
                                          *[F.element_at(F.create_map(*[F.lit(x) for pair in top.items() for x in pair]),
                                                         F.col("id").cast("int")).alias(name) for name in ("low", "high")],
                                          "vector")
    sent = dealt.sent(asks, True).unionByName(dealt.sent(asks, False)).select("shard", F.length("labels").alias("n"))
    assert sum(row["n"] for row in sent.collect()) / 8 < 0.7 * 20 * sum(map(len, dealt.numbers))
