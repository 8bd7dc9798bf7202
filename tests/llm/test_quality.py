"""The ledger against plain Python, and policies on top of it."""

from __future__ import annotations

import random
import re
from collections import Counter

from patronage.llm.quality import POLICIES, RULES, ablations, kept, ledger, mask

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    threes = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {p + step for p in range(len(words) - 2) if threes[tuple(words[p:p + 3])] > 1 for step in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)),
            "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(covered), "n_lines": len(lines), "n_exclamations": text.count("!")}


def texts() -> list[str | None]:
    draw = random.Random(1)
    words = ["a", "bb", "ccc", "é", "x!", "#", "\u00a0", "日本"]
    made = ["".join(draw.choice(words) + draw.choice([" ", " ", "\n", "\t", "\x0b", "\r\n"]) for _ in range(n))
            for n in (1, 2, 3, 4, 5, 30, 200, 200, 1000)]
    return [None, "", " \n ", "a a a", "a a a a", "x\nx\nx\n\n\nx ", "w " * 40_000, *made]


def test_measures_and_bits(documents):
    rows = dict(enumerate(texts()))
    found = ledger(documents([*rows.items(), (None, "x")]), "doc_id", "text").collect()
    assert len(found) == len(rows) + 1
    for row in found:
        if row["doc_id"] is None:
            continue
        expected = by_hand(rows[row["doc_id"]])
        assert {name: row[name] for name in expected} == expected
        failing = {rule.name for rule in RULES if eval(rule.sql, {}, expected)}  # the rules are plain arithmetic
        assert row["failed"] == mask(failing)


def test_ablations(spark):
    entries = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,)], "failed int")
    found = {row["rule"]: row for row in ablations(entries, {"base.1": POLICIES["base.1"]}).collect()}
    assert (found["few_words"]["failing"], found["few_words"]["only"], found["few_words"]["kept"]) == (3, 2, 2)
    assert (found["repeated_words"]["failing"], found["repeated_words"]["only"]) == (1, 0)
    assert [row["failed"] for row in entries.filter(kept(POLICIES["base.1"])).collect()] == [0, 4]


def test_empty(documents):
    empty = ledger(documents([]), "doc_id", "text")
    assert empty.collect() == []
    assert [row["kept"] for row in ablations(empty, {"base.1": 3}).collect()] == [0, 0]
