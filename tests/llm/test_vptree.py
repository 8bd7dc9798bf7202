"""Trees against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.llm import vptree
from patronage.llm.vptree import Tree, exact_products, nearest


def brute(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, k: int) -> dict:
    out = {}
    for q in queries:
        for own in vectors[ids == q]:
            score = exact_products(np.repeat(own[None], len(ids), 0), vectors)
            order = np.lexsort((ids, -score))
            out[q] = [(int(ids[i]), float(score[i])) for i in order if ids[i] != q][:k]
    return out


def found_by(table, k, **options) -> dict:
    out = {}
    for row in sorted(nearest(table, "id", "v", F.col("id") % 10 == 0, k, **options).collect(),
                      key=lambda row: (row["query_id"], row["rank"])):
        out.setdefault(row["query_id"], []).append((row["id"], row["score"]))
        assert row["rank"] == len(out[row["query_id"]])
    return out


@pytest.fixture(scope="module")
def points():
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(12, 16))
    vectors = centres[draw.integers(0, 12, 1500)] + 0.1 * draw.normal(size=(1500, 16))
    vectors[500:900] = vectors[500]  # equal vectors
    vectors[900:910] = 2 * vectors[900]
    vectors[1000:1100] = np.round(vectors[1000:1100])  # ties
    vectors = vectors[np.linalg.norm(vectors, axis=1) > 0]
    return np.random.default_rng(2).permutation(len(vectors)) * 3 + 1, vectors


def table_of(spark, ids, vectors):
    bad = [(None, [1.0] * 16), (30, None), (40, [0.0] * 16), (50, [float("nan")] * 16), (60, [None] * 16),
           (70, [float("inf")] + [1.0] * 15), (80, [1.0, 2.0]), (90, [])]
    rows = [(int(i), [float(x) for x in v], "x") for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows + [(*row, "x") for row in bad], "id long, v array<double>, score string").repartition(5)


def test_factor_one_is_exact(spark, points):
    ids, vectors = points
    expected = brute(ids, vectors, ids[ids % 10 == 0], 20)
    assert found_by(table_of(spark, ids, vectors), 20, shard=700, block=40) == expected


def test_larger_factors_leave_out_more_and_keep_recall(points, monkeypatch):
    monkeypatch.setattr(vptree, "LEAF", 64)
    ids, vectors = points
    vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    queries = np.flatnonzero(ids % 10 == 0)
    expected = brute(ids, vectors, ids[queries], 10)
    compared, recalls = [], []
    for factor in (1.0, 1.2, 1.5, 2.0):
        tree, count = Tree(ids, vectors, 10), []
        compare = tree._compare
        tree._compare = lambda begin, end, rows: (count.append((end - begin) * len(rows)), compare(begin, end, rows))
        row, found, score = tree.search(ids[queries], vectors[queries], factor)
        hits = sum(score[i] >= expected[ids[queries[row[i]]]][-1][1] - 1e-12 for i in range(len(row)))
        recalls.append(hits / (10 * len(queries)))
        compared.append(sum(count))
    assert recalls[0] == 1 and recalls[1] >= 0.9
    assert compared == sorted(compared, reverse=True) and compared[0] > compared[-1]


def test_few_and_none(spark):
    rows = [(10, [1.0, 0.0]), (11, [0.5, 0.5]), (20, [0.0, 1.0])]
    table = spark.createDataFrame(rows, "id long, v array<double>")
    assert found_by(table, 5) == {10: [(11, 0.5), (20, 0.0)], 20: [(11, 0.5), (10, 0.0)]}
    assert found_by(table.filter("id = 10"), 5) == {} and found_by(table.limit(0), 5) == {}
    assert found_by(table.filter("id = 11"), 5) == {}


def test_repeated_ids(spark):
    rows = [(10, [1.0, 0.0]), (10, [1.0, 0.0]), (11, [1.0, 0.0]), (11, [1.0, 0.0]), (12, [0.0, 1.0])]
    found = found_by(spark.createDataFrame(rows, "id long, v array<double>"), 2)
    assert set(found) == {10} and {i for i, _ in found[10]} == {11}


def test_hot_id(spark):
    """A third of the rows share an id, which does not bring them into one shard."""
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(900, 8))
    ids = np.where(np.arange(900) % 3 == 0, 7, np.arange(900) + 10)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)]
    table = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    asked = sorted({int(i) for i in ids if i % 10 == 0})
    assert found_by(table, 5, shard=64, block=16) == brute(ids, vectors, np.array(asked), 5)
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(15))
    assert max(row["count"] for row in table.groupBy(place).count().collect()) < 2 * 900 / 15
