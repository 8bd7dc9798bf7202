"""Spans against all windows in plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from patronage.llm.suffixes import Words, cut, repeated_spans


def by_hand(rows: list[tuple], length: int = 50) -> set:
    seen, later = {}, {}
    for i, text in sorted(rows):
        words = (text or "").encode().split()
        for p in range(len(words) - length + 1):
            window = tuple(words[p:p + length])
            if window in seen:
                later.setdefault(i, []).append((p, *seen[window]))
            else:
                seen[window] = (i, p)
    spans = set()
    for i, places in later.items():
        begin = last = None
        for p, source, at in [*places, (None, None, None)]:
            if begin is not None and (p is None or p > last + length):
                spans.add((i, begin[0], last - begin[0] + length, begin[1], begin[2]))
                begin = None
            if p is not None:
                begin, last = begin or (p, source, at), p
    return spans


def collection(seed: int) -> list[tuple]:
    draw = random.Random(seed)

    def words(n: int) -> list[str]:
        return [f"w{draw.randrange(10**6)}" for _ in range(n)]

    passages = [words(n) for n in (50, 51, 60, 80, 200, 49)]
    texts = []
    for _ in range(80):
        parts = [words(draw.randrange(0, 40))]
        for _ in range(draw.randrange(0, 3)):
            passage = draw.choice(passages)
            begin = draw.choice([0, 0, 0, 1, 5])
            parts += [passage[begin:], words(draw.choice([0, 0, 1, 30]))]
        texts.append(draw.choice([" ", "\n", "  "]).join(word for part in parts for word in part))
    hot = " ".join(passages[4])
    texts += [hot] * 25 + [f"{hot} {i}" for i in range(15)]  # a very common text, and near copies
    texts += [" ".join(["same"] * n) for n in (49, 50, 51, 400)] + ["a b " * 300]
    texts += [None, "", "short", texts[0], texts[0].replace(" ", "\t")]
    order = list(range(len(texts)))
    draw.shuffle(order)
    return [(2 * i, texts[at]) for i, at in enumerate(order)]


@pytest.mark.parametrize("seed", [1, 2])
def test_spans_as_by_all_windows(documents, many_runs, seed):
    rows = collection(seed)
    found = repeated_spans(documents([*rows, (None, rows[0][1])], 7), "doc_id", "text").collect()
    spans = [(row["doc_id"], row["start_word"], row["n_words"], row["source_doc_id"], row["source_start"]) for row in found]
    assert len(set(spans)) == len(spans)
    assert set(spans) == by_hand(rows)


def test_repeated_id_and_empty(documents):
    text = " ".join(map(str, range(70)))
    (row,) = repeated_spans(documents([(1, text), (1, text), (2, text)]), "doc_id", "text").collect()
    assert tuple(row) == (2, 0, 70, 1, 0)
    assert repeated_spans(documents([]), "doc_id", "text").collect() == []
    with pytest.raises(ValueError, match="length"):
        repeated_spans(documents([]), "doc_id", "text", 10)


def test_other_length(documents):
    rows = [(1, " ".join(map(str, range(40)))), (2, "x " + " ".join(map(str, range(10, 35))))]
    (row,) = repeated_spans(documents(rows), "doc_id", "text", 24).collect()
    assert tuple(row) == (2, 1, 25, 1, 10)


def test_cut(spark):
    kinds = "i int, text string, spans array<struct<start_word:long,n_words:long>>"
    rows = [(1, " a b\n c  d e ", [(3, 1), (1, 1)], " a c  e "), (2, "a b c", [(1, 2)], "a"), (3, "a b", [(0, 2)], ""),
            (4, "a b", None, "a b"), (5, None, [(0, 1)], None), (6, "é x y z", [(0, 1)], "y z")]
    table = spark.createDataFrame([row[:3] for row in rows], kinds)
    found = table.select("i", cut(F.col("text"), F.col("spans")).alias("t")).collect()
    assert {row["i"]: row["t"] for row in found} == {row[0]: row[3] for row in rows}


def test_rows_of_an_id_with_other_texts(documents):
    """Only the row that counts is compared: a shorter one has no such places, a longer one other words at them."""
    first, second = (" ".join(f"{name}{i}" for i in range(300)) for name in "ab")
    one, two = Words([first, second]).digests()
    counting, other = (first, second) if (one[0], two[0]) < (one[1], two[1]) else (second, first)
    for partitions in (1, 3):
        rows = [(2, f"x {counting}"), (3, f"y {other}"), (1, first), (1, second), (1, "short"), (1, None), (1, "z")]
        found = repeated_spans(documents(rows, partitions), "doc_id", "text").collect()
        assert [tuple(row) for row in found] == [(2, 1, 300, 1, 0)]
