"""Held-out accuracy, rejection and odd texts."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.llm.common import held_out
from patronage.llm.langid import clustered, fit, gram_counts, predicted

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return fit(table.filter(~held_out("doc_id")), "text", "lang", "doc_id", sample=60)


def test_held_out_accuracy(spark, model):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").filter(held_out("doc_id"))
    found = table.select("lang", predicted(F.col("text"), model).alias("p")).collect()
    right = [row["p"]["lang"] == row["lang"] for row in found]
    assert len(found) > 200 and np.mean(right) >= 0.97
    assert np.mean([row["p"]["rejected"] for row in found]) < 0.2
    assert all(0 <= row["p"]["score"] <= 1 for row in found)


def test_odd_texts(documents, model):
    rows = [(1, None), (2, ""), (3, "123 ... 😀"), (4, "a"), (5, "Ωμέγα και άλφα " * 20), (6, "the " * 50_000), (None, "the of and")]
    found = {row["doc_id"]: row["p"] for row in
             documents(rows).select("doc_id", predicted(F.col("text"), model).alias("p")).collect()}
    for i in (1, 2, 3):
        assert (found[i]["lang"], found[i]["score"], found[i]["rejected"]) == ("und", 0.0, True)
    assert found[5]["rejected"] and found[5]["lang"] != "und"
    assert found[4]["lang"] != "und" and found[6]["lang"] == found[None]["lang"] == "en"


def test_nothing_learnt(documents):
    nothing = fit(documents([(1, "a"), (2, None)]), "text", "lang", "doc_id")
    (row,) = documents([(1, "the")]).select(predicted(F.col("text"), nothing).alias("p")).collect()
    assert tuple(row["p"]) == ("und", 0.0, True)


def test_prediction_reads_text_only(spark, model):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(50)
    plan = table.select(predicted(F.col("text"), model).alias("p"))._jdf.queryExecution().executedPlan().toString()
    assert "lang#" not in plan.split("ReadSchema")[-1] and "source:" not in plan


def test_grams_do_not_see_what_is_no_letter():
    assert (gram_counts("Ab, c!!") == gram_counts("ab 1 c")).all()
    assert gram_counts("  1 ") is None


def test_clusters_are_unit_vectors():
    draw = np.random.default_rng(0)
    vectors = np.abs(draw.normal(size=(30, 8)))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    centroids, own = clustered(vectors, 3)
    assert np.allclose(np.linalg.norm(centroids, axis=1), 1) and set(own) <= {0, 1, 2}
    assert (own == np.argmax(vectors @ centroids.T, axis=1)).all()
    assert len(clustered(vectors[:2], 5)[0]) == 2


def grams_by_hand(text: str) -> list[int]:
    """Buckets of all grams of one to three characters; letters stay, every run of others is one blank, as are the ends."""
    out = " "
    for char in text.lower():
        out += char if char.isalpha() else "" if out[-1] == " " else " "
    out = out.rstrip(" ") + " "
    keys = []
    for size in (1, 2, 3):
        for i in range(len(out) - size + 1):
            key = (ord(out[i]) * 0x9E3779B1 + 1) % 2 ** 32
            for char in out[i + 1:i + size]:
                key = (key * 0x85EBCA77 + ord(char)) % 2 ** 32
            keys.append((key ^ key >> 15) * 0xC2B2AE3D % 2 ** 32 >> 20)
    return keys


def vector_by_hand(text: str, idf: list[float]) -> list[float]:
    weights = [0.0] * 4096
    for key in grams_by_hand(text):
        weights[key] += 1
    weights = [math.sqrt(weight) * idf[i] for i, weight in enumerate(weights)]
    length = math.sqrt(sum(weight * weight for weight in weights))
    return [weight / length for weight in weights]


def dot(one: list[float], other: list[float]) -> float:
    return math.fsum(x * y for x, y in zip(one, other, strict=True))


def centroids_by_hand(vectors: list[list[float]], count: int) -> list[list[float]]:
    """Spherical k-means from the first vector and those farthest from the ones chosen."""
    chosen = [vectors[0]]
    while len(chosen) < min(count, len(vectors)):
        chosen.append(min(vectors, key=lambda v: max(dot(v, c) for c in chosen)))
    for _ in range(12):
        own = [max(range(len(chosen)), key=lambda c: (dot(v, chosen[c]), -c)) for v in vectors]
        for c in range(len(chosen)):
            members = [v for v, o in zip(vectors, own, strict=True) if o == c]
            if members:
                total = [sum(column) for column in zip(*members, strict=True)]
                length = math.sqrt(dot(total, total))
                chosen[c] = [x / length for x in total]
    return chosen


def test_against_plain_nearest_centroid(documents):
    """All texts fit into the sample, so that the whole model can be made by hand."""
    draw = random.Random(7)
    words = {"aa": "der die und nicht über".split(), "bb": "the and of not over".split(), "cc": "el la y no más".split()}
    rows = [(i, " ".join(draw.choices(words[lang], k=draw.randrange(2, 9))) + draw.choice(["", "!", " 12"]), lang)
            for i, lang in enumerate(draw.choices(sorted(words), k=36))]
    table = documents([row[:2] for row in rows]).drop("lang").withColumn("lang", F.element_at(
        F.create_map(*[F.lit(cell) for row in rows for cell in (row[0], row[2])]), F.col("doc_id").cast("int")))
    model = fit(table, "text", "lang", "doc_id", sample=100, centroids=2)
    assert all((gram_counts(text) == np.bincount(grams_by_hand(text), minlength=4096)).all() for _, text, _ in rows)

    seen = [sum(key in set(grams_by_hand(text)) for _, text, _ in rows) for key in range(4096)]
    idf = [math.log((1 + len(rows)) / (1 + n)) + 1 for n in seen]
    assert np.allclose(model.idf, idf, rtol=1e-12)
    learnt = sorted((lang, tuple(c)) for lang, c in zip(model.languages, model.centroids.tolist(), strict=True))
    made = []
    for lang in sorted(words):
        texts = [row for row in rows if row[2] == lang]
        # the sample is in order of its hash, which the model tells by the order of nothing: any start is one of the rows
        starts = [centroids_by_hand([vector_by_hand(row[1], idf) for row in [first, *[r for r in texts if r is not first]]], 2)
                  for first in texts]
        own = [np.array(c) for name, c in learnt if name == lang]
        assert any(all(min(np.abs(c - np.array(d)).max() for d in start) < 1e-9 for c in own) for start in starts)
        made += [(lang, c.tolist()) for c in own]
    found = {row["doc_id"]: row["p"] for row in table.select("doc_id", predicted(F.col("text"), model).alias("p")).collect()}
    for i, text, _ in rows:
        vector = vector_by_hand(text, idf)
        score, lang = max((dot(vector, c), lang) for lang, c in made)
        assert found[i]["lang"] == lang and abs(found[i]["score"] - score) < 1e-9


def test_repeated_rows_are_drawn_once(documents):
    """A third of the rows have no id, a third one id, and most of these one text; the rest is sampled as if they were few."""
    draw = random.Random(3)

    def text(words: list[str]) -> str:
        return " ".join(draw.choices(words, k=20))

    german, english = "der die und nicht über das".split(), "the and of not over this".split()
    rows = [(None, "der die das " * 9) if i % 3 == 0 else (7, "und über das nicht " * 9) if i % 3 == 1 else
            (100 + i, text(german)) for i in range(600)]
    rows += [(2_000 + i, text(english)) for i in range(60)]
    table = documents(rows).drop("lang").withColumn("lang", F.when(F.col("doc_id") >= 2_000, "en").otherwise("de"))
    model = fit(table, "text", "lang", "doc_id", sample=50, centroids=3)
    found = table.select("lang", predicted(F.col("text"), model).alias("p")).collect()
    assert np.mean([row["p"]["lang"] == row["lang"] for row in found]) > 0.99
    assert model.languages.count("de") == model.languages.count("en") == 3
