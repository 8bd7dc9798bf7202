"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed character n-grams (one to three characters of the
lower-cased text, everything but letters taken as one blank), weighted by TF-IDF and
scaled to length one. Document frequencies come from all training documents. Per
language the vectors of a bounded sample are clustered on the sphere; a text gets
the language of the centroid with the largest cosine. Each centroid remembers how
near its own members are: a text farther away than all but a small share of them is
marked as rejected (far from everything learnt), its nearest language still given.

Only text is read to predict. The model is a few vectors per language.

Null text and text without a letter: ``und`` with score 0, rejected. Ties go to the
language that sorts first. No training document: ``und`` for all. Long texts are used
whole; repeated and id-less rows are predicted like any other, and drawn into the sample
once if id and text are the same. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import letters, slices

UNKNOWN = "und"
BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
#: Training texts per language that are clustered; their number is bounded, document frequencies are not sampled.
SAMPLE = 600
CENTROIDS = 4
ROUNDS = 12
#: Share of its own members that a centroid counts as too far away.
FAR = 0.005
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_SHIFT = np.uint32(32 - BUCKET_BITS)


class Model(NamedTuple):
    languages: list[str]
    centroids: np.ndarray
    radii: np.ndarray
    idf: np.ndarray


def gram_counts(text: str | None) -> np.ndarray | None:
    """How often each bucket of n-grams occurs; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[points]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first blank after a letter
    one = np.where(letter, points, np.uint32(32))[keep]
    blank = np.array([32], np.uint32)
    one = np.concatenate((blank, one) if one[-1] == 32 else (blank, one, blank))
    grams = [one * _FACTORS[0] + np.uint32(1)]
    for size in (2, 3):
        longer = grams[-1][:-1] * _FACTORS[1] + one[size - 1:]
        grams.append(longer)
    codes = np.concatenate([(gram ^ gram >> np.uint32(15)) * _FACTORS[2] >> _SHIFT for gram in grams])
    return np.bincount(codes, minlength=BUCKETS)


def _vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.sqrt(counts, dtype=np.float64) * idf
    return weighted / np.linalg.norm(weighted)


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents per bucket, one row per bucket and task."""
    seen, documents = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch["text"]:
            counts = gram_counts(text)
            if counts is not None:
                seen += counts > 0
                documents += 1
    yield pd.DataFrame({"bucket": np.arange(-1, BUCKETS), "n": np.concatenate(([documents], seen))})


def clustered(vectors: np.ndarray, count: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length one and the cluster of every vector; spherical k-means from far-apart starts."""
    chosen = [0]
    nearest = vectors @ vectors[0]
    while len(chosen) < min(count, len(vectors)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    centroids = vectors[chosen]
    for _ in range(rounds):
        own = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, vectors)
        lengths = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(lengths > 0, sums / np.maximum(lengths, 1e-300), centroids)
    return centroids, np.argmax(vectors @ centroids.T, axis=1)


def fit(training: DataFrame, text: str, language: str, doc_id: str, sample: int = SAMPLE,
        centroids: int = CENTROIDS, far: float = FAR) -> Model:
    """Learn from all rows of ``training``; those without language or without a letter say nothing.

    ``sample`` bounds the texts per language that are clustered; which ones is
    decided by a hash of id and text. Everything else is counted over all rows.
    """
    known = training.select(F.col(text).alias("text"), F.col(language).alias("lang"),
                            F.col(doc_id).cast("string").alias("id")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counted = (known.select("text").mapInPandas(_frequencies, "bucket int, n long")
               .groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # one row per bucket
    frequency = np.zeros(BUCKETS + 1)
    for row in counted:
        frequency[row["bucket"] + 1] = row["n"]
    idf = np.log((1 + frequency[0]) / (1 + frequency[1:])) + 1

    content = F.xxhash64("id", "text")
    sizes = known.groupBy("lang").agg(F.approx_count_distinct(content, 0.02).alias("n"))
    draw = F.pmod(F.xxhash64(content, F.lit(7)), F.lit(1 << 30))
    # one row per language, of which the model itself holds several vectors; no text is shuffled but the sample
    some = known.join(F.broadcast(sizes), "lang").filter(draw * F.col("n") < 1.2 * sample * (1 << 30)).select(
        "lang", "text", content.alias("content"), draw.alias("draw"))
    drawn = some.groupBy("lang", "draw", "content").agg(F.first("text").alias("text"))  # repeated rows are drawn alike

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", "content"])[:sample]
        counts = [each for each in map(gram_counts, rows["text"]) if each is not None]
        if not counts:
            return pd.DataFrame({"lang": [], "centroid": [], "radius": []})
        vectors = np.array([_vector(each, idf) for each in counts])
        found, own = clustered(vectors, centroids)
        near = np.einsum("ij,ij->i", vectors, found[own])
        radii = [np.quantile(near[own == i], far) if (own == i).any() else 1.0 for i in range(len(found))]
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": list(found), "radius": radii})

    learnt = drawn.groupBy("lang").applyInPandas(learn, "lang string, centroid array<double>, radius double")
    rows = sorted(learnt.collect(), key=lambda row: (row["lang"], row["centroid"]))  # a few rows per language
    matrix = np.array([row["centroid"] for row in rows]).reshape(len(rows), BUCKETS)
    return Model([row["lang"] for row in rows], matrix, np.array([row["radius"] for row in rows]), idf)


def predicted(text: Column, model: Model) -> Column:
    """lang, score (cosine with the nearest centroid, 0 to 1) and rejected, as a struct."""

    @F.pandas_udf("lang string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        lang, score, rejected = [], [], []
        values = texts.tolist()
        for begin, end in slices(values):
            for value in values[begin:end]:
                counts = gram_counts(value) if len(model.languages) else None
                if counts is None:
                    lang.append(UNKNOWN), score.append(0.0), rejected.append(True)
                    continue
                near = model.centroids @ _vector(counts, model.idf)
                best = int(np.argmax(near))
                lang.append(model.languages[best])
                score.append(min(max(float(near[best]), 0.0), 1.0))
                rejected.append(bool(near[best] < model.radii[best]))
        return pd.DataFrame({"lang": pd.Series(lang, dtype=object), "score": pd.Series(score, dtype=float),
                             "rejected": pd.Series(rejected, dtype=bool)})

    return predict(text)
