"""Held-out quality, the estimator on made-up rows, and odd texts."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from patronage.llm.common import held_out
from patronage.llm.toxicity import THRESHOLD, Features, fit, nnpu, score

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    return fit(table.filter(~held_out("doc_id")), "doc_id", "text", labels, "doc_id", "toxic")


def test_held_out_quality(spark, model):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet").filter(held_out("doc_id"))
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = table.join(labels, "doc_id").select("toxic", score(F.col("text"), model).alias("s")).collect()
    toxic = [row["s"] >= THRESHOLD for row in rows if row["toxic"]]
    clean = [row["s"] >= THRESHOLD for row in rows if not row["toxic"]]
    # 37 positives teach this model; on the larger tables recall is above 0.9
    assert np.mean(toxic) >= 0.5 and np.mean(clean) <= 0.02


def test_odd_texts(documents, model):
    rows = [(1, None), (2, ""), (3, "12 !"), (4, "fine words " * 50_000), (None, "x")]
    found = documents(rows).select("doc_id", score(F.col("text"), model).alias("s")).collect()
    assert all(0 <= row["s"] < THRESHOLD for row in found)
    assert len({row["s"] for row in found if row["doc_id"] in (1, 2, 3)}) == 1


def test_nothing_to_learn(spark, documents):
    labels = spark.createDataFrame([(1, 0), (2, None)], "doc_id long, toxic int")
    nothing = fit(documents([(1, "a b c")]), "doc_id", "text", labels, "doc_id", "toxic")
    (row,) = documents([(1, "a")]).select(score(F.col("text"), nothing).alias("s")).collect()
    assert row["s"] == 0.0


def test_learns_a_planted_word(spark, documents):
    draw = random.Random(6)
    rows = []
    for i in range(600):
        words = [f"word{draw.randrange(300)}" for _ in range(draw.randrange(10, 60))]
        if i % 8 == 0:
            words[draw.randrange(len(words))] = draw.choice(["nasty", "nastyer", "nastyest"])
        rows.append((i, " ".join(words)))
    # a third of the toxic rows are confirmed, all other labels say nothing
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(0, 600) if i % 3 == 0] + [(0, 0), (None, 1)],
                                   "doc_id long, toxic int")
    learnt = fit(documents(rows), "doc_id", "text", labels, "doc_id", "toxic", prior=1 / 8)
    found = documents(rows).select("doc_id", score(F.col("text"), learnt).alias("s")).collect()
    wrong = [row["doc_id"] for row in found if (row["s"] >= THRESHOLD) != (row["doc_id"] % 8 == 0)]
    assert len(wrong) <= 3
    again = fit(documents(rows, 5), "doc_id", "text", labels, "doc_id", "toxic", prior=1 / 8)
    assert np.array_equal(learnt.features, again.features) and np.allclose(learnt.weights, again.weights, rtol=1e-6)


def test_estimator_matches_the_prior():
    draw = np.random.default_rng(1)
    positive = [np.array([0]) if draw.random() < 0.9 else np.zeros(0, int) for _ in range(300)]
    unlabelled = [np.array([0]) if draw.random() < 0.1 else np.array([1]) for _ in range(900)]
    weights, bias = nnpu(positive, unlabelled, 0.1, 2)
    chances = [1 / (1 + np.exp(-(weights[row].sum() + bias))) for row in unlabelled]
    assert abs(np.mean(chances) - 0.1) < 1e-3 and weights[0] > 2 and weights[1] < 0


def test_features(monkeypatch):
    texts = ["Alpha alpha", None, "alphabet", "", "alps " * 3]
    owner, feature = Features().of(texts)
    per_text = [set(feature[owner == i].tolist()) for i in range(4)]
    assert not per_text[1] and not per_text[3]
    assert len(per_text[0]) == 2 * 2 + 1  # the word and its beginning of four, met twice, and the length
    assert len(per_text[2]) == 1 + 4 + 1 and len(per_text[0] & per_text[2]) == 1
    wanted = np.unique(feature)[::3]
    monkeypatch.setattr("patronage.llm.toxicity.KNOWN_PIECES", 1)
    lookup = Features(wanted)
    for _ in range(3):  # words are forgotten and met again
        some_owner, some = lookup.of(texts)
        keep = np.isin(feature, wanted)
        assert (some_owner == owner[keep]).all() and (some == feature[keep]).all()


def test_features_are_counted_over_all_rows(spark, documents, monkeypatch):
    """The bounds of the rows that the model is fitted on do not change which features are found."""
    draw = random.Random(8)
    rows = []
    for i in range(600):
        words = [f"word{draw.randrange(300)}" for _ in range(draw.randrange(10, 60))]
        if i % 4 == 0:
            words.append(["nasty", "vile"][i % 40 == 0])
        rows.append((i, " ".join(words)))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    table = documents(rows)
    full = fit(table, "doc_id", "text", labels, "doc_id", "toxic")
    monkeypatch.setattr("patronage.llm.toxicity.HELD_COUNTS", 100, raising=False)
    bounded = fit(table, "doc_id", "text", labels, "doc_id", "toxic", positives=20, unlabelled=40)
    assert np.array_equal(full.features, bounded.features)
    assert set(Features().of(["vile"])[1].tolist()) <= set(bounded.features.tolist())
    one = fit(table, "doc_id", "text", labels.filter("doc_id < 4"), "doc_id", "toxic")
    assert len(one.features) and np.isfinite(one.bias)


def features_by_hand(text: str | None) -> set:
    """Words and beginnings, the second and third time as well, and the length in powers of two."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    pieces = [piece for word in words for piece in [(word, "whole")] + [(word[:n], "begin") for n in range(4, 9) if n < len(word)]]
    counts = {piece: pieces.count(piece) for piece in pieces}
    found = {(*piece, again) for piece, n in counts.items() for again in range(min(n, 3))}
    return found | ({("length", len(words).bit_length())} if words else set())


def risk(weights: dict, bias: float, positive: list[set], unlabelled: list[set], prior: float, decay: float) -> float:
    """The estimator's risk, before a negative part is turned: of positives, plus unlabelled less positives as negatives."""
    def value(row: set) -> float:
        return bias + sum(weights[feature] for feature in row)

    def mean(rows: list[set], loss) -> float:
        return math.fsum(loss(value(row)) for row in rows) / len(rows)

    as_negative = mean(unlabelled, lambda v: math.log1p(math.exp(v))) - prior * mean(positive, lambda v: math.log1p(math.exp(v)))
    return (prior * mean(positive, lambda v: math.log1p(math.exp(-v))) + as_negative, as_negative,
            decay / 2 * sum(weight ** 2 for weight in weights.values()))


def nnpu_by_hand(positive: list[set], unlabelled: list[set], prior: float, names: list, rounds: int) -> tuple[dict, float]:
    """Adam on the gradient taken term by term, by differences of the risk."""
    keys = [*names, None]
    theta = dict.fromkeys(names, 0.0) | {None: math.log(prior / (1 - prior))}
    mean, square = dict.fromkeys(keys, 0.0), dict.fromkeys(keys, 0.0)

    def value(row: set) -> float:
        return theta[None] + sum(theta[feature] for feature in row)

    for step in range(1, rounds + 1):
        _, excess, _ = risk({name: theta[name] for name in names}, theta[None], positive, unlabelled, prior, 0)
        gradient = dict.fromkeys(keys, 0.0)
        for rows, weight in ((unlabelled, 1.0), (positive, -prior)):
            for row in rows:
                slope = weight / len(rows) / (1 + math.exp(-value(row)))
                for key in [*row, None]:
                    gradient[key] += slope
        if excess < 0:
            gradient = {key: -slope for key, slope in gradient.items()}
        else:
            for row in positive:
                slope = -prior / len(positive) / (1 + math.exp(value(row)))
                for key in [*row, None]:
                    gradient[key] += slope
        for key in keys:
            slope = gradient[key] + (1e-4 * theta[key] if key is not None else 0)
            mean[key] = 0.9 * mean[key] + 0.1 * slope
            square[key] = 0.999 * square[key] + 0.001 * slope ** 2
            theta[key] -= 0.05 * (mean[key] / (1 - 0.9 ** step)) / (math.sqrt(square[key] / (1 - 0.999 ** step)) + 1e-8)
    low, high = -50.0, 50.0
    for _ in range(60):
        middle = (low + high) / 2
        average = math.fsum(1 / (1 + math.exp(-(value(row) - theta[None] + middle))) for row in unlabelled) / len(unlabelled)
        low, high = (middle, high) if average < prior else (low, middle)
    return theta, (low + high) / 2


def small_corpus() -> tuple[list[tuple[int, str]], set[int]]:
    draw = random.Random(12)
    rows = [(i, " ".join(draw.choices([f"w{c}" for c in "abcdefgh"], k=draw.randrange(3, 9))
                         + (["vile", "vilely"][:draw.randrange(1, 3)] if i % 4 == 0 else []))) for i in range(48)]
    return [*rows, (48, None), (49, "")], {i for i in range(0, 48, 8)}


def test_gradient_is_that_of_the_risk():
    """The terms that the plain estimator adds up are the differences of the risk."""
    rows, confirmed = small_corpus()
    sets = [features_by_hand(text) for _, text in rows]
    names = sorted({feature for row in sets for feature in row}, key=repr)
    positive, draw = [sets[i] for i in confirmed], random.Random(1)
    weights = {name: draw.gauss(0, 0.3) for name in names}
    places = {name: i for i, name in enumerate(names)}
    before = risk(weights, -0.5, positive, sets, 0.125, 0)
    assert before[1] > 0
    for name in draw.sample(names, 10):
        step = 1e-6
        up, down = (risk(weights | {name: weights[name] + sign * step}, -0.5, positive, sets, 0.125, 0)[0] for sign in (1, -1))
        slope = sum((name in row) / (1 + math.exp(0.5 - sum(weights[f] for f in row))) for row in sets) / len(sets)
        slope -= 0.125 * sum((name in row) for row in positive) / len(positive)
        assert abs((up - down) / (2 * step) - slope) < 1e-7
    as_rows = [[np.array(sorted(places[f] for f in row), int) for row in part] for part in (positive, sets)]
    found, bias = nnpu(*as_rows, 0.125, len(names), rounds=25)
    theta, by_hand = nnpu_by_hand(positive, sets, 0.125, names, 25)
    assert np.allclose(found, [theta[name] for name in names], rtol=1e-8, atol=1e-10) and abs(bias - by_hand) < 1e-8


def test_against_plain_python(spark, documents):
    """Features found, weights and scores of a small table, all by hand."""
    rows, confirmed = small_corpus()
    labels = spark.createDataFrame([(i, int(i in confirmed)) for i in range(0, 48, 2)], "doc_id long, toxic int")
    model = fit(documents(rows), "doc_id", "text", labels, "doc_id", "toxic")
    sets = {i: features_by_hand(text) for i, text in rows}
    prior = len(confirmed) / 24
    frequent = {f: n for f in set().union(*(sets[i] for i in confirmed))
                if (n := sum(f in sets[i] for i in confirmed)) >= 3 and f[0] != "length"}
    enough = math.log(len(frequent)) + 2.0
    telling = set()
    for feature, n in frequent.items():
        usual = sum(feature in row for row in sets.values()) / len(rows) * len(confirmed)
        if n > usual and n * math.log(n / usual) - (n - usual) >= enough:
            telling.add(feature)
    lengths = {("length", n) for n in range(1, 33)}
    assert len(model.features) == len(telling) + len(lengths)
    kept = telling | lengths
    small = {i: row & kept for i, row in sets.items()}
    theta, bias = nnpu_by_hand([small[i] for i in confirmed], list(small.values()), prior, sorted(kept, key=repr), 400)
    found = {row["doc_id"]: row["s"] for row in documents(rows).select("doc_id", score(F.col("text"), model).alias("s")).collect()}
    for i, row in small.items():
        assert abs(found[i] - 1 / (1 + math.exp(-(bias + sum(theta[f] for f in row))))) < 1e-6


def test_repeated_rows_are_drawn_once(spark, documents):
    """A third of the rows are one confirmed row, a third have one id and other texts: the drivers' rows stay bounded."""
    draw = random.Random(2)
    rows = [(1, "vile words of one row") if i % 3 == 0 else (2, f"text {draw.random()} number {i}") if i % 3 == 1 else
            (i, f"vile {draw.random()}" if i % 9 == 2 else f"fine {i}") for i in range(900)]
    labels = spark.createDataFrame([(1, 1), (2, 0), *[(i, int(i % 9 == 2)) for i in range(2, 900, 3)]], "doc_id long, toxic int")
    import patronage.llm.toxicity as toxicity

    drawn = []
    real = toxicity.nnpu
    try:
        toxicity.nnpu = lambda positive, unlabelled, *rest: (drawn.append((len(positive), len(unlabelled))),
                                                             real(positive, unlabelled, *rest))[1]
        model = fit(documents(rows), "doc_id", "text", labels, "doc_id", "toxic", positives=40, unlabelled=100, features=5)
    finally:
        toxicity.nnpu = real
    assert drawn[0][0] <= 40 and drawn[0][1] <= 100 and drawn[0][0] > 20 and drawn[0][1] > 60
    assert len(model.features) <= 5 + 32


def test_empty_table(spark, documents):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    nothing = fit(documents([]), "doc_id", "text", labels, "doc_id", "toxic")
    assert documents([]).select(score(F.col("text"), nothing)).collect() == [] and nothing.bias == -np.inf
