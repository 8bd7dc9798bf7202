"""Runs against their definition word by word, the planted texts, and odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from patronage.llm.queries import QUERIES
from patronage.llm.runs import periodic_runs, runs_of

FOLDER = "/root/testdata/sf0.01"


def by_hand(words: list, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """All runs: per lag the stretches that match, less those whose words have a smaller period."""
    n, found = len(words), []
    for period in range(1, n // exponent + 1):
        i = period
        while i < n:
            if words[i] != words[i - period]:
                i += 1
                continue
            end = i
            while end < n and words[end] == words[end - period]:
                end += 1
            start, length = i - period, end - i + period
            if length >= max(least, exponent * period) and not any(
                    all(words[j] == words[j - smaller] for j in range(start + smaller, end))
                    for smaller in range(1, period)):
                found.append((start, length, period))
            i = end
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed_by_hand(words: list[str], found: list[tuple[int, int, int]]) -> str:
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(word for i, word in enumerate(words) if i not in gone)


def numbered(documents: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.cumsum([len(words) for words in documents]))).astype(np.int64)
    return np.array([word for words in documents for word in words], np.int64), starts


def expected(documents: list[list[int]], **limits) -> list[tuple[int, int, int]]:
    starts = numbered(documents)[1].tolist()
    return [(start + begin, length, period) for begin, words in zip(starts, documents, strict=False)
            for start, length, period in by_hand(words, **limits)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_runs_of_few_words(documents):
    assert list(zip(*map(np.ndarray.tolist, runs_of(*numbered(documents))), strict=True)) == expected(documents)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=17), st.integers(1, 9), st.integers(0, 16)),
                max_size=6), st.integers(3, 6), st.integers(1, 12))
def test_runs_of_repeated_stretches(stretches, exponent, least):
    words = [word for stretch, times, more in stretches for word in (stretch * times + stretch[:more])]
    found = runs_of(*numbered([words, words[::-1]]), least, exponent)
    assert list(zip(*map(np.ndarray.tolist, found), strict=True)) == expected(
        [words, words[::-1]], least=least, exponent=exponent)


def test_long_runs_and_frequent_words():
    """A word a hundred thousand times over, and long periods, cost a sort per size and no pairs."""
    one = [7] * 100_000
    cycle = list(range(9_000)) * 11 + [1]
    start, length, period = runs_of(*numbered([one, cycle, [7, 7, 8] * 20_000]))
    assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == [
        (0, 100_000, 1), (100_000, 99_000, 9_000), (199_001, 60_000, 3)]
    with pytest.raises(ValueError):
        runs_of(*numbered([one]), exponent=2)


def test_odd_rows(spark, documents):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a a a a a"), (5, "a a a a a a"), (6, "x " + "a b\x0b" * 4 + "c"),
            (None, "é é\té é é é"), (7, "a a a a a a"), (7, "a a a a a a"), (8, "w" * 2_000_000 + " v" * 9),
            (9, "A a " * 3), (10, "a a " * 6)]
    found = periodic_runs(documents(rows), "text", ["doc_id", "n_chars", "start"])
    assert found.columns == ["doc_id", "n_chars", "start", "n_words", "runs", "collapsed"]
    got = sorted(((row["doc_id"], row["n_words"], [tuple(run) for run in row["runs"]], row["collapsed"])
                  for row in found.collect()), key=repr)
    want = []
    for i, text in rows:
        words = [word.decode() for word in (text or "").encode().split()]
        runs = by_hand(words)
        want.append((i, len(words), runs, collapsed_by_hand(words, runs)))
    assert got == sorted(want, key=repr)
    assert periodic_runs(documents([]), "text", ["doc_id"]).collect() == []


def test_hot_text(spark, documents):
    rows = [(i, "tick tock " * 50 if i % 3 else f"only {i}") for i in range(600)]
    found = periodic_runs(documents(rows), "text", ["doc_id"]).collect()
    assert len(found) == 600
    assert all([tuple(run) for run in row["runs"]] == ([(0, 100, 2)] if row["doc_id"] % 3 else []) for row in found)


def planted(doc_id: int | None, text: str | None) -> list[str]:
    words = [word.decode() for word in (text or "").encode().split()]
    if doc_id is None:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def by_grams(words: list[str]) -> list[tuple[int, int, int]]:
    """Runs by their definition, lags taken from equal stretches of five words, which every run holds at its lag."""
    seen, lags = {}, {}
    for i in range(len(words) - 4):
        before = seen.setdefault(tuple(words[i:i + 5]), [])
        for j in before:
            if 4 * (i - j) <= len(words):
                lags.setdefault(i - j, []).append(i)
        before.append(i)
    found = set()
    for period, places in lags.items():
        end = 0
        for i in places:
            if i < end:
                continue  # in the run found last
            start = end = i
            while end < len(words) and words[end] == words[end - period]:
                end += 1
            while start > period and words[start - 1] == words[start - 1 - period]:
                start -= 1
            if end - start + period >= max(6, 4 * period):
                found.add((start - period, end - start + period, period))
    return sorted((run for run in found if not any(
        other[0] <= run[0] and run[0] + run[1] <= other[0] + other[1] and other[2] < run[2] and run[2] % other[2] == 0
        for other in found)), key=lambda run: (run[0], run[2]))


def test_query_against_plain_python(spark):
    found = {row["doc_id"]: row for row in QUERIES["op11_periodic_runs"](spark, FOLDER).collect()}
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(table)
    some = 0
    for i, text in table:
        words = planted(i, text)
        runs = by_grams(words)
        row = found[i]
        some += len(runs) > 0
        best = max(runs, key=lambda run: (run[1], -run[0], -run[2]), default=(None,) * 3)
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        listed = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
        assert row["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(collapsed_by_hand(words, runs).encode()).hexdigest()
    assert some > 50


def test_planted_texts(spark, documents):
    from patronage.llm.queries import with_planted_periods

    draw = random.Random(3)
    rows = [(i, " ".join(f"w{draw.randrange(9)}" for _ in range(draw.randrange(0, 40)))) for i in range(400)]
    rows += [(None, "a b c"), (-8, None), (10 ** 12, "a b c d e f g h")]
    made = with_planted_periods(documents(rows)).collect()
    assert sorted(((row["doc_id"], (row["text"] or "").split()) for row in made), key=repr) == sorted(
        ((i, planted(i, text)) for i, text in rows), key=repr)
