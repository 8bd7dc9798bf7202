"""Targets, copies and their agreement with the targets."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from patronage.llm.mixing import emitted, mixed, source_targets, word_count


def by_hand(sizes: dict, most: int = 3) -> dict:
    names = sorted((name for name in sizes if name is not None), key=lambda name: name.encode())
    names += [None] if None in sizes else []
    weights = {name: (5, 2, 1)[i % 3] for i, name in enumerate(names)}
    rest, targets = sum(sizes.values()), {}
    while True:
        open_ = [name for name in names if name not in targets]
        if not open_:
            return targets
        level = rest / sum(weights[name] for name in open_)
        stopped = [name for name in open_ if level * weights[name] >= most * sizes[name]]
        if not stopped:
            return targets | {name: level * weights[name] for name in open_}
        for name in stopped:
            targets[name] = most * sizes[name]
            rest -= targets[name]


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 50, None: 7}, {"a": 5}, {"é": 100, "z": 100, "Z": 0}, {"a": 1, "b": 1, "c": 10**6}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {row["source"]: row["target"] for row in source_targets(table).collect()}
    assert found == pytest.approx(by_hand(sizes))


def test_mix_of_a_hot_source(documents, many_runs):
    draw = random.Random(2)
    rows = []
    for i in range(900):
        source = "hot" if i % 3 else draw.choice(["a", "b", None])
        rows.append((i, " ".join(["w"] * int(draw.lognormvariate(3, 1))), source))
    rows += [(901, None, "a"), (902, "", "b"), (None, "x y", "b"), (7, rows[7][1], rows[7][2])]
    table = documents(rows, 8)
    found = mixed(table, "doc_id", "source", word_count(F.col("text"))).collect()
    assert len(found) == len(rows)
    again = mixed(table.repartition(3), "doc_id", "source", word_count(F.col("text"))).collect()
    assert sorted(found, key=repr) == sorted(again, key=repr)
    for source in ("hot", "a", "b", None):
        own = [row for row in found if row["source"] == source]
        assert sum(row["size"] for row in own) == own[0]["source_size"]
        taken, largest = sum(row["taken"] for row in own), max(row["size"] for row in own)
        assert abs(taken - own[0]["target"]) <= largest + 1e-6
        assert all(0 <= row["copies"] <= 3 and row["taken"] == row["copies"] * row["size"] for row in own)
        assert max(row["copies"] for row in own) - min(row["copies"] for row in own) <= 1


def test_words_are_counted_by_ascii_blanks(documents):
    texts = {1: "a\u00a0b c", 2: "\x1ca\x0bb\r\n", 3: None, 4: " "}
    found = documents(list(texts.items())).select("doc_id", word_count(F.col("text")).alias("n")).collect()
    assert {row["doc_id"]: row["n"] for row in found} == {1: 2, 2: 2, 3: 0, 4: 0}


def test_empty_and_wordless(documents):
    assert mixed(documents([]), "doc_id", "source", word_count(F.col("text"))).collect() == []
    rows = mixed(documents([(1, ""), (2, None)]), "doc_id", "source", word_count(F.col("text"))).collect()
    assert [(row["copies"], row["target"]) for row in rows] == [(0, 0.0)] * 2


def test_emitted(documents):
    table = documents([(1, "a"), (2, "b"), (3, "c")])
    found = emitted(table, F.col("doc_id") - 1)
    assert sorted(row["doc_id"] for row in found.collect()) == [2, 3, 3] and found.columns == table.columns
