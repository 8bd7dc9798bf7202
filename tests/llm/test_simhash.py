"""Fingerprints, links and components against plain Python, hot groups and odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from patronage.llm.queries import QUERIES
from patronage.llm.simhash import FAR, PIVOTS, as_hex, fingerprints, forest, near_duplicates, pivot_distances, survivors

FOLDER = "/root/testdata/sf0.01"


def fingerprint(text: str | None) -> int:
    words = bytes((text or ""), "utf-8").lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(gram, 42) for gram in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def classes(prints: dict[int, set[int]]) -> dict[int, int]:
    """Smallest id reachable, from the fingerprints of every id."""
    least = {i: i for i in prints}

    def root(i: int) -> int:
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(prints)
    flat = [(i, value) for i in ids for value in prints[i]]
    values = np.array([value for _, value in flat], np.uint64)
    for (i, value) in flat:
        for j in np.flatnonzero(np.bitwise_count(values ^ np.uint64(value)) <= FAR):
            a, b = root(i), root(flat[j][0])
            least[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def answer(found) -> dict:
    return {row["doc_id"]: (row["fp"], row["component_id"]) for row in
            found.select("doc_id", as_hex(found["fingerprint"]).alias("fp"), "component_id").collect()}


def expected(rows: list[tuple[int, str | None]]) -> dict:
    prints = {i: fingerprint(text) for i, text in rows}
    least = classes({i: {value} for i, value in prints.items()})
    return {i: (f"{value:016x}", least[i]) for i, value in prints.items()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aBç \t\x0b\x1c "), max_size=30)), max_size=6))
def test_fingerprints(texts):
    assert fingerprints(texts).tolist() == [fingerprint(text) for text in texts]


def test_fingerprint_of_a_long_text(monkeypatch):
    monkeypatch.setattr("patronage.llm.simhash.HASHES", 100)
    text = " ".join(f"w{i * i % 997}" for i in range(5_000))
    assert fingerprints(["a b", text, None, text.upper()]).tolist() == list(map(fingerprint, ["a b", text, None, text]))


def near_prints(seed: int, groups: int, each: int) -> np.ndarray:
    draw = random.Random(seed)
    made = set()
    for _ in range(groups):
        value = draw.getrandbits(64)
        for _ in range(draw.randrange(1, each)):
            made.add(value)
            for _ in range(draw.randrange(6)):
                value ^= 1 << draw.randrange(64)
    return np.array(sorted(made), np.uint64)


@pytest.mark.parametrize("seed", range(4))
def test_forest(seed):
    prints = near_prints(seed, 60, 12)
    links = forest(prints, pivot_distances(prints))
    least = classes({i: {int(value)} for i, value in enumerate(prints)})
    assert len(links) == len(prints) - len(set(least.values()))  # a tree per component
    assert all(np.bitwise_count(prints[a] ^ prints[b]) <= FAR and least[a] == least[b] for a, b in links)


def test_table_discards_no_near_pair_and_most_others():
    prints = np.concatenate((near_prints(9, 40, 8), np.random.default_rng(2).integers(0, 1 << 63, 2_000, np.uint64)))
    table = pivot_distances(prints).astype(np.int8)
    assert table[3].tolist() == [int(pivot ^ prints[3]).bit_count() for pivot in PIVOTS]
    left = 0
    for one in range(0, len(prints), 20):
        near = set(np.flatnonzero(np.bitwise_count(prints ^ prints[one]) <= FAR).tolist())
        kept = survivors(one, np.arange(len(prints)), table, FAR).tolist()
        assert near <= set(kept)
        left += len(kept)
    assert left < 0.01 * len(prints) ** 2 / 20


def texts_near(seed: int, groups: int) -> list[tuple[int, str]]:
    draw = random.Random(seed)
    rows = []
    for _ in range(groups):
        words = [f"v{draw.randrange(2_000)}" for _ in range(draw.randrange(1, 250))]
        for _ in range(draw.randrange(1, 6)):
            rows.append((draw.randrange(10 ** 9), " ".join(words)))
            if draw.random() < 0.7:
                words = list(words)
                words[draw.randrange(len(words))] = "changed"
    return list({i: text for i, text in rows}.items())


def test_documents_against_all_pairs(documents):
    rows = [*texts_near(5, 80), (-4, None), (17, ""), (18, " \t"), (19, "One"), (20, "one"), (21, "a b"), (22, "A\x0bB")]
    found = answer(near_duplicates(documents(rows), "doc_id", "text"))
    assert found == expected(rows)
    assert found[17] == found[18] == found[-4] == ("0" * 16, -4) and found[20][1] == 19 and found[22][1] == 21


def test_repeated_and_missing_ids(documents):
    one, two = (" ".join(f"{name}{i}" for i in range(40)) for name in "ab")
    rows = [(5, one), (5, two), (5, two), (9, two), (3, one), (12, "alone here"), (None, one), (None, None)]
    found = near_duplicates(documents(rows), "doc_id", "text").collect()
    assert len(found) == len(rows)
    assert {(row["doc_id"], row["component_id"]) for row in found} == {(5, 3), (9, 3), (3, 3), (12, 12), (None, None)}
    assert {row["fingerprint"] for row in found if row["doc_id"] is None} >= {0}
    assert near_duplicates(documents([]), "doc_id", "text").collect() == []


@pytest.mark.parametrize("block", [4, 64])
def test_hot_groups_in_blocks(documents, block):
    """A third of the rows are copies, another third near copies of one text."""
    draw = random.Random(1)
    words = [f"h{i}" for i in range(400)]
    rows = []
    for i in range(240):
        if i % 3 == 0:
            rows.append((i, "the same words over and over"))
        elif i % 3 == 1:
            near = list(words)
            near[draw.randrange(400)] = f"n{draw.randrange(20)}"
            rows.append((i, " ".join(near)))
        else:
            rows.append((i, " ".join(f"u{draw.randrange(10 ** 6)}" for _ in range(30))))
    found = answer(near_duplicates(documents(rows, 7), "doc_id", "text", block=block))
    assert found == expected(rows)
    assert len({value for value, least in found.values() if least == 1}) > 3 * 4  # the near copies need many blocks


def test_query_against_all_pairs(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    found = {row["doc_id"]: (row["fingerprint"], row["component_id"])
             for row in QUERIES["op13_simhash"](spark, FOLDER).collect()}
    assert found == expected([tuple(row) for row in table])
    assert sum(i != least for i, (_, least) in found.items()) > 10


def test_limits(documents):
    with pytest.raises(ValueError):
        near_duplicates(documents([]), "doc_id", "text", far=4)
