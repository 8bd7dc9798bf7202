"""Every stage, and the whole, on small tables with odd rows."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from patronage.llm.queries import vocabulary_path
from llm.test_minhash import by_hand as classes_by_hand
from llm.test_minhash import collection as near_collection
from llm.test_suffixes import by_hand as spans_by_hand
from llm.test_suffixes import collection as passage_collection

FOLDER = "/root/testdata/sf0.001"
ODD = [(9001, None, None), (9002, "", None), (None, "no id here", "s"), (None, None, None), (9003, "x", "only")]


def texts_of(table) -> list[tuple]:
    return [(row["doc_id"], row["text"]) for row in table.select("doc_id", "text").collect()]


def test_toxicity(spark, documents):
    table = documents(ODD)
    found = pipeline.without_toxic(spark, table, FOLDER)
    assert found.columns == table.columns and Counter(texts_of(found)) == Counter(texts_of(table))


def test_near_duplicates(spark, documents):
    rows = near_collection(3, 20)
    table = documents([*rows, rows[0], *ODD])
    found = pipeline.without_near_duplicates(spark, table, FOLDER)
    least = classes_by_hand(rows)
    expected = [row for row in rows if least[row[0]] == row[0]] + [row[:2] for row in ODD]
    assert found.columns == table.columns and Counter(texts_of(found)) == Counter(expected)


def test_near_duplicates_of_rows_that_share_an_id(spark, documents):
    """Other texts of an id stay, unless a row with a smaller id has them."""
    one, two, three = (" ".join(f"{name}{i}" for i in range(60)) for name in "abc")
    rows = [(4, one), (4, two), (4, two), (4, three), (9, two), (2, three + " more"), (4, None), (6, "alone"), (-7, "x")]
    table = documents(rows)
    found = pipeline.without_near_duplicates(spark, table, FOLDER)
    expected = [(4, one), (4, two), (2, three + " more"), (4, None), (6, "alone"), (-7, "x")]
    assert found.columns == table.columns and Counter(texts_of(found)) == Counter(expected)


def cut_by_hand(rows: list[tuple[int, str]]) -> dict[int, str | None]:
    """The words left of every text, by key; None where nothing is left of one that had words."""
    gone = {}
    for i, begin, count, _, _ in spans_by_hand(rows):
        gone.setdefault(i, set()).update(range(begin, begin + count))
    out = {}
    for i, text in rows:
        words = (text or "").split()
        kept = [word for p, word in enumerate(words) if p not in gone.get(i, ())]
        out[i] = " ".join(kept) if kept or not words else None
    return out


def test_repeated_passages(spark, documents):
    rows = passage_collection(4)
    table = documents([*rows, *ODD])
    found = pipeline.without_repeated_passages(spark, table, FOLDER)
    expected = cut_by_hand([*rows, *[row[:2] for row in ODD if row[0] is not None]])
    assert found.columns == table.columns
    left = dict(row for row in texts_of(found) if row[0] is not None)
    assert {i: " ".join((text or "").split()) for i, text in left.items()} == {
        i: text for i, text in expected.items() if text is not None}
    untouched = {i for i, text in rows if expected[i] == " ".join((text or "").split())}
    assert all(left[i] == text for i, text in rows if i in untouched) and len(untouched) > 5
    assert Counter(i for i, _ in texts_of(found) if i is None) == Counter([row[0] for row in ODD if row[0] is None])
    assert all(row["n_chars"] == len(row["text"]) for row in found.collect() if row["text"] is not None)


def test_repeated_passages_of_rows_that_share_an_id(spark, documents):
    """Rows of one id, and rows without an id, lose what stands in another document as well; the first place keeps it."""
    passage, other = (" ".join(f"{name}{i}" for i in range(60)) for name in "pq")
    rows = [(-2 ** 63, f"{passage} first"), (7, f"a {passage} b"), (7, f"c {other} d"), (7, "short"), (None, f"e {passage} f"),
            (None, None), (9, f"g {other} h"), (None, f"e {passage} f")]
    found = texts_of(pipeline.without_repeated_passages(spark, documents(rows), FOLDER))
    assert Counter(row for row in found if "q1" not in (row[1] or "").split()) >= Counter(
        [(7, "a b"), (7, "short"), (None, "e f"), (None, "e f"), (None, None), (-2 ** 63, f"{passage} first")])
    # which of the two rows with the other passage is earlier is told by the hash of the one that shares its id
    assert Counter(row for row in found if row not in ((7, "a b"), (7, "short"))) - Counter(rows) in (
        Counter([(None, "e f")] * 2 + [(7, "c d")]), Counter([(None, "e f")] * 2 + [(9, "g h")]))


def test_texts_are_cut_once(spark, documents):
    found = pipeline.without_repeated_passages(spark, documents(passage_collection(4)), FOLDER)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [without") == 1


def test_mixing(spark, documents):
    rows = [(i, "w " * (i % 13), "hot" if i % 3 else f"s{i % 4}") for i in range(300)]
    rows += [rows[7], (7, "v " * 7, rows[7][2]), *ODD]
    table = documents(rows)
    found = pipeline.mixed_sources(spark, table, FOLDER)
    assert found.columns == table.columns
    copies = Counter(texts_of(found))
    assert set(copies) <= set(texts_of(table))
    from patronage.llm.mixing import mixed, word_count

    expected = {tuple(row) for row in mixed(table, "doc_id", "source", word_count(F.col("text")))
                .groupBy("doc_id", "size").agg(F.sum("copies").alias("c")).filter("c > 0").collect()}
    made = Counter()
    for (i, text), count in copies.items():
        made[i, len((text or "").split())] += count
    assert {(*key, count) for key, count in made.items()} == expected


def test_mixing_of_rows_that_are_alike(spark, documents, many_runs):
    """A third of the rows have no id and one text; together they are taken as often as the mix says, evenly."""
    rows = [(None, "x y", "s") if i % 3 == 0 else (i, "z " * (i % 5), "s" if i % 2 else "t") for i in range(300)]
    table = documents(rows, 6)
    from patronage.llm.mixing import mixed, word_count

    taken = mixed(table, "doc_id", "source", word_count(F.col("text")))
    alike = taken.filter("doc_id IS NULL").collect()
    copies = sum(row["copies"] for row in alike)
    found = texts_of(pipeline.mixed_sources(spark, table, FOLDER))
    assert len(alike) == 100 and found.count((None, "x y")) == copies > 0
    assert len(found) == taken.agg(F.sum("copies")).first()[0]


def test_encoding(spark, documents):
    from tokenizers import Tokenizer

    rows = [(1, "Hello world"), (2, "<|endoftext|> é")]
    found = pipeline.encoded(spark, documents([*rows, *ODD]), FOLDER).collect()
    library = Tokenizer.from_file(vocabulary_path())
    for i, text in [*rows, *[row[:2] for row in ODD if row[0] is not None]]:
        (row,) = [row for row in found if row["doc_id"] == i]
        assert row["ids"] == library.encode(text or "", add_special_tokens=False).ids
        assert row["decoded"] == (text or "") and row["n_tokens"] == len(row["ids"])
    assert len(found) == len(rows) + len(ODD)


@pytest.mark.parametrize("stage", [stage for _, stage in pipeline.STAGES])
def test_empty_table(spark, documents, stage):
    assert stage(spark, documents([]), FOLDER).collect() == []


def test_run(spark):
    found = pipeline.run(spark, FOLDER)
    rows = found.collect()
    words = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert 0 < len(rows) <= 3 * words and found.columns == ["doc_id", "source", "n_tokens", "ids", "decoded"]
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "mixing", "encoding"]
