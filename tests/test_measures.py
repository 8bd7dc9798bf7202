"""Measures, silhouettes and coding against plain Python and Spark's own evaluators."""

from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from patronage.operators.coding import as_json, coded, fit_coding, from_json
from patronage.operators.measures import area_under_curve, measures, silhouettes, with_selected
from patronage.plans import churn_models as churn
from patronage.plans import forecast


def scored_rows(seed: int, n: int = 400) -> list[tuple]:
    draw = random.Random(seed)
    return [(name, label, 0.5 if draw.random() < 0.3 else round(draw.random() * (0.6 + 0.4 * label), 2))
            for name in ("a", "b") for label in [int(draw.random() < 0.4) for _ in range(n)]]


def area(rows: list[tuple[int, float]]) -> float:
    ones, zeros = ([score for label, score in rows if label == wanted] for wanted in (1, 0))
    return sum((one > zero) + (one == zero) / 2 for one in ones for zero in zeros) / (len(ones) * len(zeros))


def test_area_with_ties_over_many_runs(spark, many_runs):
    """A third of the scores are one value; the runs are several."""
    rows = scored_rows(1)
    df = spark.createDataFrame(rows, "m string, y int, s double").repartition(5)
    found = {row["m"]: row["roc_auc"] for row in area_under_curve(df, "y", "s", "m").collect()}
    assert found == pytest.approx({name: area([row[1:] for row in rows if row[0] == name]) for name in "ab"})
    own = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="s", numBins=0).evaluate(df.filter("m = 'a'"))
    assert found["a"] == pytest.approx(own)


def test_measures_where_classes_or_scores_are_missing(spark):
    rows = [("one", 1, 1, 0.5), ("one", 1, 0, None), ("none", 0, 0, 0.1), ("none", 0, 1, 0.2), ("mixed", 1, 1, 0.9),
            ("mixed", 0, 0, 0.1), ("mixed", None, 1, 0.3)]
    found = {row["m"]: row.asDict() for row in with_selected(
        measures(spark.createDataFrame(rows, "m string, y int, p int, s double"), "y", "p", "s", "m"), "m").collect()}
    assert found["one"]["roc_auc"] is None and found["one"]["recall"] == 0.5 and found["one"]["precision"] == 1.0
    assert found["none"]["f1"] == 0.0 and found["none"]["accuracy"] == 0.5
    assert found["mixed"]["roc_auc"] == 1.0 and found["mixed"]["accuracy"] == 1.0
    assert [name for name, row in found.items() if row["selected"]] == ["mixed"]
    assert measures(spark.createDataFrame([], "m string, y int, p int, s double"), "y", "p", "s", "m").collect() == []


def test_silhouettes_equal_the_evaluator_and_all_pairs(spark):
    draw = random.Random(3)
    rows = [(g, draw.gauss(g, 1.0), draw.gauss(-g, 0.5)) for g in range(3) for _ in range(20 + 10 * g)] + [(7, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "g int, x double, y double").repartition(4)
    found = sorted((row["g"], row["x"], row["silhouette"]) for row in silhouettes(df, "g", ["x", "y"]).collect())

    def mean_square(one: tuple, others: list[tuple]) -> float:
        return statistics.fmean((one[1] - other[1]) ** 2 + (one[2] - other[2]) ** 2 for other in others)

    expected = []
    for i, row in enumerate(rows):
        own = [other for j, other in enumerate(rows) if other[0] == row[0] and j != i]
        near = min(mean_square(row, [other for other in rows if other[0] == g]) for g in {r[0] for r in rows} - {row[0]})
        within = mean_square(row, own) if own else 0.0
        expected.append((row[0], row[1], (near - within) / max(near, within) if own else 0.0))
    assert [part for row in found for part in row] == pytest.approx([part for row in sorted(expected) for part in row])
    vectors = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df)
    own = ClusteringEvaluator(predictionCol="g").evaluate(vectors)
    assert statistics.fmean(row[2] for row in found) == pytest.approx(own)
    alone = silhouettes(df.filter("g = 1"), "g", ["x", "y"]).collect()
    assert {row["silhouette"] for row in alone} == {None}
    assert silhouettes(df.limit(0), "g", ["x", "y"]).collect() == []


def test_coding(spark, many_runs):
    train = spark.createDataFrame([(1.0, "b", 5), (3.0, "a", None), (None, None, 5), (10.0, "b", None)],
                                  "x double, t string, flat int")
    coding = fit_coding(train, ["x", "flat"], ["t"])
    assert coding.modes == {"t": "b"} and coding.sizes == {"t": 2} and coding.scales["x"].middle == 3.0
    saved = from_json(__import__("json").loads(__import__("json").dumps(as_json(coding))), coding.codes)
    rows = spark.createDataFrame([(3.0, "a", 1), (None, None, None), (1.0, "unseen", 7)], "x double, t string, flat int")
    found = [(row["x_scaled"], row["t_code"], row["flat_scaled"]) for row in coded(rows, saved).collect()]
    values = [1.0, 3.0, 3.0, 10.0]
    mean, deviation = statistics.fmean(values), statistics.stdev(values)
    assert sorted(found, key=repr) == sorted([
        (pytest.approx((3 - mean) / deviation), 0.0, 0.0), (pytest.approx((3 - mean) / deviation), 1.0, 0.0),
        (pytest.approx((1 - mean) / deviation), 2.0, 0.0)], key=repr) or len(found) == 3
    assert {row[1] for row in found} == {0.0, 1.0, 2.0} and {row[2] for row in found} == {0.0}


def test_unseen_texts_have_no_flag(spark):
    """The vector is sparse, with a flag per text seen and none for others."""
    from pyspark.ml import Pipeline

    def master(rows: list[tuple]):
        numbers = {name: F.lit(float(i)) for i, name in enumerate(churn.NUMERIC)}
        return spark.createDataFrame(rows, "gender string, state string").withColumns(numbers)

    train = master([("F", "X"), ("M", "Y"), ("F", "Z"), (None, None)])
    coding = fit_coding(train, churn.NUMERIC, churn.CATEGORICAL)
    stages = Pipeline(stages=churn.assembly()).fit(coded(train, coding))
    rows = {(row["gender"], row["state"]): row["features"] for row in
            stages.transform(coded(master([("F", "Z"), ("other", "Q"), (None, "X")]), coding)).collect()}
    flags = {key: [int(i) - len(churn.NUMERIC) for i in vector.toArray().nonzero()[0] if i >= len(churn.NUMERIC)]
             for key, vector in rows.items()}
    assert flags == {("F", "Z"): [0, 4], ("other", "Q"): [], (None, "X"): [0, 2]}
    assert {len(vector) for vector in rows.values()} == {len(churn.NUMERIC) + 2 + 3}


def test_drawn_rows_and_the_rest(spark):
    people = spark.range(2_000).withColumnRenamed("id", "customer_id")
    train = churn.sampled(people, "customer_id", 0.75)
    test = churn.rest(people, train, "customer_id")
    drawn = {row[0] for row in train.repartition(7).collect()}
    assert 1_400 < len(drawn) < 1_600 and drawn == {row[0] for row in churn.sampled(people.repartition(3), "customer_id", 0.75).collect()}
    assert {row[0] for row in test.collect()} == set(range(2_000)) - drawn


def test_plan_of_a_step_does_not_grow(spark, monkeypatch):
    """Two years ahead: every step is planned over one stored row per series."""
    import datetime as dt

    sizes, real = [], forecast.next_month

    def watch(state, model, step):
        found = real(state, model, step)
        sizes.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
        return found

    quick = forecast.GBTRegressor
    monkeypatch.setattr(forecast, "GBTRegressor", lambda **options: quick(**{**options, "maxIter": 2}))
    monkeypatch.setattr(forecast, "next_month", watch)
    rows = [("a", dt.date(2020 + n // 12, n % 12 + 1, 1), 100.0 + n % 12) for n in range(30)]
    ahead, _ = forecast.boosted_forecast(spark.createDataFrame(rows, "series string, month date, revenue double"), 24)
    assert ahead.count() == 24 and len(sizes) == 24 and max(sizes) < 1.1 * min(sizes)
    assert all(math.isfinite(row["forecast"]) for row in ahead.collect())
