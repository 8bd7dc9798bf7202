from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Observation
from pyspark.sql import functions as F

from patronage.errors import InsufficientDataError
from patronage.operators.value import churn_queue
from patronage.plans import churn_models as churn
from patronage.plans.clustering import cluster_count, cluster_customers, finite
from patronage.plans.forecast import (
    error_measures,
    forecast_features,
    head_and_tail,
    last_values,
    moving_average_forecast,
    revenue_forecast,
    revenue_series,
)

SERIES = "series STRING, month DATE, revenue DOUBLE"
MASTER = ("customer_id BIGINT, name STRING, signup_date DATE, recency_days INT, age INT, tenure_days INT, "
          "order_count BIGINT, total_revenue DOUBLE, average_order_value DOUBLE, product_diversity BIGINT, "
          "campaign_response_rate DOUBLE, support_tickets BIGINT, avg_resolution_hours DOUBLE, "
          "avg_satisfaction DOUBLE, gender STRING, state STRING")


def months(values, name="total", start=dt.date(2023, 1, 1)):
    return [(name, dt.date(start.year + (start.month - 1 + n) // 12, (start.month - 1 + n) % 12 + 1, 1), float(v))
            for n, v in enumerate(values)]


def master(spark, n=60):
    draw = random.Random(5)
    rows = []
    for i in range(n):
        late = draw.random() < 0.5
        orders = draw.randint(1, 3) if late else draw.randint(3, 9)
        rows.append((i, f"C{i}", dt.date(2020, 1, 1) + dt.timedelta(days=i // 2), 200 if late else 10,
                     None if i % 9 == 0 else 20 + i % 40, 400, orders, orders * 10.0, 10.0, 1, 0.0, 0, 0.0, 0.0,
                     None if i % 11 == 0 else "FM"[i % 2], "XYZ"[i % 3]))
    return spark.createDataFrame(rows, MASTER)


def test_short_history_uses_the_mean_of_three_months(spark):
    series = spark.createDataFrame(months([5, 1, 2, 3, 10, 20, 30]) + months([4], "one"), SERIES)
    found = revenue_forecast(series, 2)
    rows = sorted(tuple(row) for row in found.forecast.collect())
    assert rows == [("one", "2023-02", 4.0, 3.2, 4.8), ("one", "2023-03", 4.0, 3.2, 4.8),
                    ("total", "2023-08", 20.0, 16.0, 24.0), ("total", "2023-09", 20.0, 16.0, 24.0)]
    assert {(row.series, row.model, row.mae) for row in found.metrics.collect()} == {
        ("one", "moving_average", None), ("total", "moving_average", None)}


def test_features_need_all_lags(spark):
    rows = forecast_features(spark.createDataFrame(months(range(1, 9)), SERIES)).orderBy("month").collect()
    assert [(r.target, r.lag_1, r.lag_2, r.lag_3, r.lag_6, r.rolling_3, r.month_number) for r in rows] == [
        (7.0, 6.0, 5.0, 4.0, 1.0, 5.0, 7.0), (8.0, 7.0, 6.0, 5.0, 2.0, 6.0, 8.0)]
    assert [row.part for row in head_and_tail(forecast_features(
        spark.createDataFrame(months(range(1, 9)), SERIES))).orderBy("month").collect()] == ["head", "tail"]


def test_last_values(spark):
    row = last_values(spark.createDataFrame(months(range(1, 9)), SERIES)).first()
    assert row.last == dt.date(2023, 8, 1) and [row[f"v{n}"] for n in range(1, 7)] == [8, 7, 6, 5, 4, 3]


def test_errors_skip_zero_targets_in_the_percentage(spark):
    judged = spark.createDataFrame([("a", 10.0, 8.0), ("a", 0.0, 4.0)], "series STRING, target DOUBLE, prediction DOUBLE")
    row = error_measures(judged).first()
    assert (row.mae, row.rmse, row.mape) == (3.0, 3.16, 20.0)


def test_horizon_is_checked(spark):
    series = spark.createDataFrame(months([1, 2]), SERIES)
    for horizon in (0, 25):
        with pytest.raises(ValueError):
            moving_average_forecast(series, horizon)


def test_boosted_forecast_over_series_of_unequal_length(spark, monkeypatch):
    from patronage.plans import forecast

    quick = forecast.GBTRegressor
    monkeypatch.setattr(forecast, "GBTRegressor", lambda **options: quick(**{**options, "maxIter": 3}))
    wave = [100 + 10 * (n % 12) for n in range(36)]
    series = spark.createDataFrame(months(wave, "a") + months(wave[:20], "b") + months([3, 3], "short"), SERIES)
    found = revenue_forecast(series, 24)
    rows = found.forecast.collect()
    assert {name: sum(row.series == name for row in rows) for name in ("a", "b", "short")} == {
        "a": 24, "b": 24, "short": 24}
    assert all(0 <= row.lower <= row.forecast <= row.upper for row in rows)
    assert min(row.month for row in rows if row.series == "a") == "2026-01"
    assert {(row.series, row.model) for row in found.metrics.collect()} == {
        ("a", "boosted_trees"), ("b", "boosted_trees"), ("short", "moving_average")}
    assert found.history.count() == 58


def test_series_per_state_and_total(make):
    from conftest import customer, sale

    day = dt.datetime(2024, 1, 5)
    tables = make(customers=[customer(1, state="A"), customer(2, state=None)],
                  transactions=[sale(1, 1, 2.0, day), sale(2, 2, 3.0, day), sale(3, 2, 9.0, day, status="cancelled")])
    rows = {tuple(row) for row in revenue_series(tables.transactions, tables.customers).collect()}
    assert rows == {("total", dt.date(2024, 1, 1), 5.0), ("A", dt.date(2024, 1, 1), 2.0)}
    assert revenue_series(tables.transactions).first().revenue == 5.0


def test_cluster_count_and_cleaning(spark):
    assert [cluster_count(n) for n in (4, 20, 35, 40, 1000)] == [2, 2, 3, 4, 4]
    values = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.0,)], "v DOUBLE")
    assert [row[0] for row in values.select(finite(F.col("v"))).collect()] == [0.0, 0.0, 0.0, 2.0]


def test_clusters_separate_two_groups(spark):
    rows = [(i, f"C{i}", 5 if i % 2 else 900, 40 if i % 2 else 1, 9000.0 if i % 2 else 10.0 + i, 200.0, 0.0)
            for i in range(24)]
    columns = ("customer_id BIGINT, name STRING, recency_days INT, order_count BIGINT, total_revenue DOUBLE, "
               "average_order_value DOUBLE, campaign_response_rate DOUBLE")
    found = cluster_customers(spark.createDataFrame(rows, columns))
    groups = {row.customer_id: row.cluster for row in found.assignments.collect()}
    assert len({groups[i] for i in range(0, 24, 2)}) == 1 and groups[0] != groups[1]
    assert found.silhouette > 0.9
    few = cluster_customers(spark.createDataFrame(rows[:3], columns))
    assert few.assignments.count() == 0 and few.silhouette is None


def test_training_needs_enough_customers_and_both_labels(spark):
    with pytest.raises(InsufficientDataError, match="At least 20"):
        churn.check_trainable(churn.labelled(master(spark, 19)))
    calm = master(spark).withColumn("recency_days", F.lit(5))
    with pytest.raises(InsufficientDataError, match="both churned"):
        churn.check_trainable(churn.labelled(calm))


def test_chronological_split(spark):
    rows = churn.chronological_split(master(spark, 30)).orderBy("signup_date", "customer_id").collect()
    assert [row.part for row in rows] == ["train"] * 22 + ["test"] * 8


def test_random_split_where_the_later_customers_agree(spark):
    data = churn.labelled(master(spark).withColumn("recency_days", F.when(F.col("customer_id") < 30, 500).otherwise(5)))
    train, test = churn.split(data)
    assert test.select("churned").distinct().count() == 2
    assert train.count() + test.count() == 60


def test_class_weights_balance(spark):
    rows = churn.with_class_weights(churn.labelled(master(spark))).groupBy("churned").agg(F.sum("weight")).collect()
    assert [pytest.approx(30.0)] * 2 == [row[1] for row in rows]


def test_measures_from_outcomes(spark):
    rows = [(1, 1.0, 0.9)] * 3 + [(0, 1.0, 0.8)] + [(1, 0.0, 0.2)] * 2 + [(0, 0.0, 0.1)] * 4
    df = spark.createDataFrame(rows, "churned INT, prediction DOUBLE, rawPrediction DOUBLE")
    assert churn.scores_of(df) == {"accuracy": 0.7, "precision": 0.75, "recall": 0.6, "f1": 0.6667,
                                   "roc_auc": 0.92}  # 23 of 25 pairs in order
    none = spark.createDataFrame([(1, 0.0, 0.1), (0, 0.0, 0.2)], "churned INT, prediction DOUBLE, rawPrediction DOUBLE")
    found = churn.scores_of(none)
    assert (found["precision"], found["recall"], found["f1"]) == (0.0, 0.0, 0.0)


def test_train_save_and_score(spark, tmp_path, monkeypatch):
    data = master(spark)
    seen = Observation()  # once a session has observed anything it cannot go to tasks, nor what holds it
    data.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 60}
    before = churn.score_customers(data, str(tmp_path))
    assert before.count() == 60  # the heuristic, as nothing was saved yet
    quick = churn.candidates
    monkeypatch.setattr(churn, "candidates", lambda: {
        "logistic_regression": quick()["logistic_regression"],
        "random_forest": quick()["random_forest"].setNumTrees(5),
        "boosted_trees": quick()["boosted_trees"].setMaxIter(3)})
    run = churn.train_models(data, str(tmp_path))
    metrics = run.metrics.collect()
    assert {row.model_name for row in metrics} == {"logistic_regression", "random_forest", "boosted_trees"}
    areas = {row.model_name: row.value for row in metrics if row.metric == "roc_auc"}
    assert areas[run.best_model] == max(areas.values()) >= 0.5
    scored = churn.score_customers(data.withColumn("state", F.lit("unseen")), str(tmp_path)).collect()
    assert len(scored) == 60 and all(0 <= row.churn_probability <= 1 for row in scored)
    ledger = spark.read.parquet(f"{tmp_path}/model_runs").first()
    assert ledger.run_id == run.run_id and ledger.model_name == run.best_model and len(ledger.version) == 14


def test_forest_with_kept_nodes_has_the_same_trees(spark):
    forest = churn.candidates()["random_forest"]
    assert forest.getCacheNodeIds() and forest.getNumTrees() == 250 and forest.getMaxDepth() == 8
    draw = random.Random(3)
    rows = [(int(a + b > draw.random()), 1.0 + i % 2, [a, b, float(i % 3 == 0)])
            for i, (a, b) in enumerate((draw.random(), draw.random()) for _ in range(400))]
    data = spark.createDataFrame(rows, "churned INT, weight DOUBLE, parts ARRAY<DOUBLE>").select(
        "churned", "weight", array_to_vector("parts").alias("features")).repartition(3).persist()
    kept, walked = (forest.copy().setNumTrees(6).setCacheNodeIds(flag).fit(data) for flag in (True, False))
    assert kept.toDebugString.splitlines()[1:] == walked.toDebugString.splitlines()[1:]
    assert kept.totalNumNodes > 100


def test_scored_customers_are_stored_before_they_are_sorted(spark, tmp_path, monkeypatch):
    quick = churn.candidates
    monkeypatch.setattr(churn, "candidates", lambda: {"random_forest": quick()["random_forest"].setNumTrees(5)})
    churn.train_models(master(spark), str(tmp_path))
    queue = churn_queue(churn.score_customers(master(spark), str(tmp_path)))
    assert queue.inputFiles() and all("/scores-" in path for path in queue.inputFiles())
    assert queue.count() == 60
