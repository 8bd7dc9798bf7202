"""Ids and texts against the tokenizers library."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from patronage.llm.bpe import NOT_PLAIN, PLAIN_PIECES, decoded, encoded, round_trip, vocabulary
from patronage.llm.queries import vocabulary_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def vocab():
    return vocabulary(vocabulary_path())


ODD = ["", " ", "aaaaaaa aaaaaa   \n\n  x", "'s't're've'm'll'd 'S don't", "\x1c\x1d\x1e\x1f a\x85b\xa0c\u200b\u3000 ",
       "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext", "\u1680 x\u2028y", "²³½ ٣٤ Ⅷ", "日本語 텍스트 😀😀",
       "\x00\x01", "é" * 50, "=" * 300, "1234567890" * 20]


def test_odd_texts_as_the_library(vocab, library):
    for text, ids in zip(ODD, vocab.encode(ODD), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert vocab.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=["Cs"]), max_size=60))
def test_any_text_as_the_library(text):
    vocab, library = vocabulary(vocabulary_path()), Tokenizer.from_file(vocabulary_path())
    (ids,) = vocab.encode([text])
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert vocab.decode(ids) == text


def test_long_word_and_forgotten_pieces(vocab, library, monkeypatch):
    monkeypatch.setattr("patronage.llm.bpe.KNOWN_PIECES", 10)
    draw = random.Random(3)
    texts = ["".join(draw.choice("abcdef") for _ in range(5000)),
             " ".join("".join(draw.choice("etaoin") for _ in range(4)) for _ in range(500)), "the end"]
    for _ in range(2):
        for text, ids in zip(texts, vocab.encode(texts), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_plain_texts_are_cut_alike(vocab):
    for text in ODD:
        if not NOT_PLAIN.search(text):
            assert PLAIN_PIECES.findall(text) == vocab.pattern.findall(text)


def test_bytes_that_are_no_text_become_the_replacement(vocab):
    (ids,) = vocab.encode(["é"])
    half = vocab.base[0xC3]
    assert vocab.decode([half]) == "\ufffd"
    assert vocab.decode(ids) == "é"


def test_columns_and_round_trip(documents, library):
    rows = [(i, text) for i, text in enumerate(ODD)] + [(None, "no id"), (90, None), (3, ODD[3])]
    table = documents(rows)
    path = vocabulary_path()
    found = round_trip(table, "text", path, ["doc_id", "size"]).collect()
    assert len(found) == len(rows) and {row["size"] for row in found} == {"x"}
    for row in found:
        if row["doc_id"] == 90:
            assert row["ids"] == [] and row["decoded"] == ""
        elif row["doc_id"] is not None:
            assert row["ids"] == library.encode(ODD[row["doc_id"]], add_special_tokens=False).ids
            assert row["decoded"] == ODD[row["doc_id"]]
    columns = table.select("doc_id", encoded(table["text"], path).alias("i"))
    columns = columns.select("doc_id", "i", decoded(columns["i"], path).alias("d"))
    assert {(row["doc_id"], tuple(row["i"]), row["d"]) for row in columns.collect()} == {
        (row["doc_id"], tuple(row["ids"]), row["decoded"]) for row in found}
    assert round_trip(table.limit(0), "text", path, ["doc_id"]).collect() == []
