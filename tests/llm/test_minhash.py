"""Near duplicates against all pairs of full sets, and components against a plain search."""

from __future__ import annotations

import random

import numpy as np
import pytest

from patronage.llm import minhash
from patronage.llm.components import components
from patronage.llm.minhash import near_duplicates, shingle_sets, signatures


def shingles(text: str | None) -> set:
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def least_reachable(nodes: list, links: list) -> dict:
    label = {node: node for node in nodes}
    while True:
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            return label


def by_hand(rows: list[tuple]) -> dict:
    sets = [(i, shingles(text)) for i, text in rows if i is not None]
    links = [(i, j) for a, (i, one) in enumerate(sets) for j, other in sets[a + 1:]
             if one and other and 100 * len(one & other) >= 75 * len(one | other)]
    return least_reachable([i for i, _ in sets], links)


def varied(draw: random.Random, words: list[str], changes: int) -> str:
    words = list(words)
    for _ in range(changes):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**9)}"
    return " ".join(words)


def collection(seed: int, hot: int) -> list[tuple]:
    draw = random.Random(seed)
    base = [f"w{draw.randrange(3000)}" for _ in range(150)]
    texts = [" ".join(base)] * 20  # copies
    texts += [varied(draw, base, draw.randrange(1, 9)) for _ in range(hot)]  # near copies, some too far
    step = list(base)
    for i in range(0, 140, 2):  # a chain whose ends are unlike
        step[i] = f"step{i}"
        texts.append(" ".join(step))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} " + " ".join(f"u{draw.randrange(10**9)}" for _ in range(draw.randrange(5, 60)))
              for _ in range(40)]
    texts += [" ".join(f"x{draw.randrange(10**9)}" for _ in range(draw.randrange(1, 80))) for _ in range(60)]
    texts += ["A b", "a B", "a  b\n", "a b c", None, "", " \t", "É x", "é x", "one two three four five",
              "ONE TWO THREE FOUR FIVE", "a b", " ".join(["again"] * 3000), " ".join(["again"] * 50)]
    order = list(range(len(texts)))
    draw.shuffle(order)
    return [(3 * i + 5, texts[at]) for i, at in enumerate(order)]


@pytest.mark.parametrize(("seed", "block"), [(1, 2048), (2, 16)])
def test_classes_as_by_all_pairs(documents, monkeypatch, seed, block):
    monkeypatch.setattr(minhash, "BLOCK", block)  # small blocks: several tiles per bucket
    rows = collection(seed, 120)
    rows.append(rows[0])  # a repeated row
    expected = by_hand(rows)
    found = near_duplicates(documents([*rows, (None, rows[0][1])]), "doc_id", "text").collect()
    assert len(found) == len(rows) + 1
    sizes = {i: len(shingles(text)) for i, text in rows}
    for row in found:
        i = row["doc_id"]
        if i is None:
            assert (row["component_id"], row["kept"]) == (None, True)
        else:
            assert (row["component_id"], row["kept"], row["n_shingles"]) == (expected[i], expected[i] == i, sizes[i])
    assert len(set(expected.values())) < len(rows) - 100


def test_rows_of_one_id_are_one_document(documents):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(7, one), (7, two), (8, one), (9, two), (10, "else")]
    found = near_duplicates(documents(rows), "doc_id", "text").collect()
    assert {(row["doc_id"], row["component_id"]) for row in found} == {(7, 7), (8, 7), (9, 7), (10, 10)}


def test_empty(documents):
    assert near_duplicates(documents([]), "doc_id", "text").collect() == []
    (row,) = near_duplicates(documents([(4, None)]), "doc_id", "text").collect()
    assert tuple(row) == (4, 0, 4, True)


def test_signatures_estimate_similarity():
    draw = random.Random(4)
    base = [f"w{draw.randrange(10**6)}" for _ in range(400)]
    other = base[:320] + [f"v{i}" for i in range(80)]
    texts = [" ".join(base), " ".join(other)]
    keys, starts = shingle_sets(texts)
    one, two = (set(keys[starts[i]:starts[i + 1]].tolist()) for i in range(2))
    assert len(one) == len(shingles(texts[0])) and len(one & two) == len(shingles(texts[0]) & shingles(texts[1]))
    alike = np.mean(np.equal(*signatures(keys, starts, 2000)))
    assert abs(alike - len(one & two) / len(one | two)) < 0.05


def test_components(spark):
    draw = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + draw.randrange(1, 500)) for _ in range(400)]
    edges += [(draw.randrange(2000, 2600), draw.randrange(2000, 2600)) for _ in range(280)] + [(5, 5), (9, 8), (9, 8)]
    expected = least_reachable(sorted({node for edge in edges for node in edge}), edges)
    found = components(spark.createDataFrame([*edges, (None, 3)], "a long, b long"), "a", "b").collect()
    assert {row["node"]: row["component"] for row in found} == {
        node: least for node, least in expected.items() if node != least}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
