"""Churn models: label, split, candidates, comparison, selection and scoring."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.errors import InsufficientDataError
from patronage.functions.numbers import rounded
from patronage.operators.coding import CODES, as_json, coded, fit_coding, from_json
from patronage.operators.measures import MEASURES, measures, with_selected
from patronage.operators.ranking import rows_at_ranks
from patronage.operators.value import churn_scores, is_churned, with_risk_level
from patronage.schemas import SCHEMAS
from patronage.session import at_once, few_partitions, path_exists, staged, staging_folder

NUMERIC = ["age", "tenure_days", "order_count", "total_revenue", "average_order_value", "product_diversity",
           "campaign_response_rate", "support_tickets", "avg_resolution_hours", "avg_satisfaction"]
CATEGORICAL = ["gender", "state"]
MASTER_COLUMNS = ["customer_id", "name", "signup_date", "recency_days", *NUMERIC, *CATEGORICAL]

# Fixed values of the training job.
MIN_CUSTOMERS = 20
MIN_BUYERS = 10
TRAIN_SHARE = 0.75
SEED = 42
METRICS = MEASURES
SCORED_ROWS = 5_000  # about a second of work for 250 trees


class Trained(NamedTuple):
    best_model: str
    metrics: DataFrame
    run_id: str
    path: str


def labelled(master: DataFrame) -> DataFrame:
    return master.withColumn("churned", is_churned().cast("int"))


def check_trainable(data: DataFrame) -> int:
    """The number of customers, if there are enough of them and both labels occur."""
    facts = data.agg(F.count("*").alias("customers"), F.count_if(F.col("order_count") > 0).alias("buyers"),
                     F.count_distinct("churned").alias("labels")).first()
    if facts["customers"] < MIN_CUSTOMERS or facts["buyers"] < MIN_BUYERS:
        raise InsufficientDataError(
            f"At least {MIN_CUSTOMERS} customers and {MIN_BUYERS} purchasing customers are required.")
    if facts["labels"] < 2:
        raise InsufficientDataError("Training data must contain both churned and retained customers.")
    return facts["customers"]


def chronological_split(data: DataFrame) -> DataFrame:
    """Mark the earliest 75 % of customers by signup (then id) as ``train``, the others as ``test``.

    Only the last training row is looked up; no row is numbered.
    """
    keyed = data.select(F.lit(0).alias("group"), F.coalesce("signup_date", F.lit("9999-12-31").cast("date"))
                        .alias("signup"), "customer_id")
    found = rows_at_ranks(keyed, "group", ["signup", "customer_id"],
                          lambda n: [max(int(n * TRAIN_SHARE), 1) - 1]).get(0)
    if found is None:
        return data.withColumn("part", F.lit("train"))
    seam = next(iter(found.rows.values()))
    signup = F.coalesce("signup_date", F.lit("9999-12-31").cast("date"))
    earlier = (signup < F.lit(seam["signup"])) | (
        (signup == F.lit(seam["signup"])) & (F.col("customer_id") <= F.lit(seam["customer_id"])))
    return data.withColumn("part", F.when(earlier, "train").otherwise("test"))


def split(data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chronological, or at random where the later customers all have the same label."""
    marked = staged(chronological_split(data), "split")
    train, test = marked.filter(F.col("part") == "train"), marked.filter(F.col("part") == "test")
    if test.agg(F.count_distinct("churned")).first()[0] < 2:
        train = sampled(data, "customer_id", TRAIN_SHARE)
        test = rest(data, train, "customer_id")
    return train, test


def sampled(data: DataFrame, key: str, share: float, seed: int = SEED) -> DataFrame:
    """About that share of the rows, drawn by a hash of the key: the same rows however they are dealt out."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8)
    return data.filter(F.conv(digits, 16, 10).cast("long") < int(share * 16 ** 8))


def rest(data: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among the chosen ones."""
    return data.join(chosen.select(key).distinct(), key, "left_anti")


def assembly() -> list:
    """The stages that make a sparse vector of coded features; a text that was not seen has no flag."""
    codes, flags = ([f"{name}_{end}" for name in CATEGORICAL] for end in ("code", "flags"))
    return [
        VectorAssembler(inputCols=[f"{name}_scaled" for name in NUMERIC], outputCol="scaled"),
        OneHotEncoder(inputCols=codes, outputCols=flags, handleInvalid="keep", dropLast=True),
        VectorAssembler(inputCols=["scaled", *flags], outputCol="features"),
    ]


def candidates() -> dict:
    """Balanced logistic regression and forest, and boosted trees.

    The forest keeps the node every row has reached in every tree; otherwise a row goes
    down all 250 trees again for every level. The trees are the same.
    """
    common = {"featuresCol": "features", "labelCol": "churned"}
    return {
        "logistic_regression": LogisticRegression(maxIter=1000, weightCol="weight", **common),
        "random_forest": RandomForestClassifier(numTrees=250, maxDepth=8, weightCol="weight", seed=SEED,
                                                cacheNodeIds=True, **common),
        "boosted_trees": GBTClassifier(maxIter=200, maxDepth=4, stepSize=0.05, seed=SEED, **common),
    }


def with_class_weights(train: DataFrame) -> DataFrame:
    """Weight n / (2 * rows of the class), which gives both classes the same sum."""
    sizes = train.agg(F.count("*").alias("n"), F.sum("churned").alias("yes")).first()
    yes, no = sizes["yes"], sizes["n"] - sizes["yes"]
    weight = F.when(F.col("churned") == 1, sizes["n"] / (2 * max(yes, 1))).otherwise(sizes["n"] / (2 * max(no, 1)))
    return train.withColumn("weight", weight)


def scores_of(predicted: DataFrame) -> dict[str, float]:
    """The measures of one model's predictions, judged by its raw prediction."""
    row = measures(predicted.withColumn("model_name", F.lit("one")), "churned", "prediction", "rawPrediction",
                   "model_name").first()
    return {name: row[name] for name in METRICS}


def judged(predictions: dict[str, DataFrame]) -> DataFrame:
    """model_name, the measures and whether the model is the selected one, all models in one pass."""
    rows = [found.select(F.lit(name).alias("model_name"), "churned", "prediction",
                         vector_to_array("rawPrediction")[1].alias("score")) for name, found in predictions.items()]
    return with_selected(measures(staged(reduce(DataFrame.unionByName, rows), "judged"), "churned", "prediction", "score",
                                  "model_name"), "model_name")


def heuristic_measures(scores: dict[str, DataFrame], labels: DataFrame) -> DataFrame:
    """The same for scores that no model was fitted for: from a half on they count as a prediction.

    ``scores`` has customer_id and churn_probability by name, ``labels`` customer_id and churned.
    """
    rows = [found.select("customer_id", F.lit(name).alias("model_name"), "churn_probability")
            for name, found in scores.items()]
    joined = staged(reduce(DataFrame.unionByName, rows).join(labels.select("customer_id", "churned"), "customer_id"), "judged")
    told = joined.withColumn("prediction", (F.col("churn_probability") >= 0.5).cast("int"))
    return with_selected(measures(told, "churned", "prediction", "churn_probability", "model_name"), "model_name")


def without_summary(model: Model, path: str) -> Model:
    """The model as it is saved and loaded; the summary of a fit holds the session, which must not go to tasks."""
    model.write().overwrite().save(path)
    return type(model).load(path)


def train_models(master: DataFrame, path: str, models: Iterable[str] | None = None) -> Trained:
    """Fit the candidates, keep the one with the largest area, save it and note the run."""
    spark = master.sparkSession
    data = labelled(staged(master.select(*MASTER_COLUMNS), "training"))
    check_trainable(data)
    train, test = split(data)
    coding = fit_coding(train, NUMERIC, CATEGORICAL)
    train = coded(with_class_weights(train), coding)
    features = Pipeline(stages=assembly()).fit(train)
    fit_on = few_partitions(staged(features.transform(train).select("churned", "weight", "features"), "fit")).persist()
    judge_on = few_partitions(staged(features.transform(coded(test, coding)).select("churned", "features"), "judge"),
                              SCORED_ROWS)
    known = candidates()
    names = list(models or known)
    fitted = dict(zip(names, at_once([
        lambda name=name: without_summary(known[name].fit(fit_on), f"{staging_folder(spark)}/{name}-{uuid.uuid4().hex}")
        for name in names]), strict=True))
    fit_on.unpersist()
    found = judged({name: fitted[name].transform(judge_on) for name in names}).collect()  # a row per model
    best = next(row["model_name"] for row in found if row["selected"])
    results = {row["model_name"]: {name: row[name] for name in METRICS} for row in found}
    run_id = str(uuid.uuid4())
    PipelineModel([*features.stages, fitted[best]]).write().overwrite().save(f"{path}/churn_model")
    coding.codes.write.mode("overwrite").parquet(f"{path}/churn_codes")
    spark.createDataFrame([(json.dumps(as_json(coding)),)], "coding STRING").write.mode("overwrite").json(
        f"{path}/churn_coding")
    note_run(spark, path, run_id, best, results)
    rows = [(run_id, name, metric, results[name][metric], name == best) for name in names for metric in METRICS]
    metrics = spark.createDataFrame(
        rows, "run_id STRING, model_name STRING, metric STRING, value DOUBLE, selected BOOLEAN")
    return Trained(best, metrics, run_id, path)


def note_run(spark: SparkSession, path: str, run_id: str, best: str, results: dict) -> None:
    """Append to the run ledger."""
    entry = spark.createDataFrame([(run_id, "churn", best, json.dumps(results), f"{path}/churn_model")],
                                  "run_id STRING, model_type STRING, model_name STRING, metrics_json STRING, "
                                  "artifact_path STRING")
    stamped = entry.withColumn("trained_at", F.localtimestamp()).withColumn(
        "version", F.date_format("trained_at", "yyyyMMddHHmmss"))
    spark_columns = [field.split()[0] for field in SCHEMAS["model_runs"].replace("\n", " ").split(",")]
    stamped.select(*spark_columns).write.mode("append").parquet(f"{path}/model_runs")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The run ledger with a row per run, model and measure."""
    runs = spark.read.schema(SCHEMAS["model_runs"]).parquet(f"{path}/model_runs")
    found = F.from_json("metrics_json", "map<string,map<string,double>>")
    models = runs.withColumnRenamed("model_name", "selected_model").select("*", F.explode(found).alias("model_name", "_measures"))
    return models.select("*", F.explode("_measures").alias("metric", "value")).drop("_measures", "metrics_json")


def score_customers(master: DataFrame, path: str) -> DataFrame:
    """Churn probability by the saved model, or by the heuristic where none was saved.

    What a model has scored is stored, as a sort behind it reads its rows twice.
    """
    spark = master.sparkSession
    if not path_exists(spark, f"{path}/churn_coding"):
        return churn_scores(master)
    found = json.loads(spark.read.schema("coding STRING").json(f"{path}/churn_coding").first()["coding"])
    coding = from_json(found, spark.read.schema(CODES).parquet(f"{path}/churn_codes"))
    scored = PipelineModel.load(f"{path}/churn_model").transform(coded(master, coding))
    probability = vector_to_array("probability")[1]
    return with_risk_level(staged(scored.select("customer_id", "name", probability.alias("churn_probability")), "scores"))


def feature_table(data: DataFrame) -> DataFrame:
    """customer_id, the scaled numbers and the codes of all customers, learnt from the earlier ones."""
    marked = staged(chronological_split(data), "split")
    found = coded(marked, fit_coding(marked.filter(F.col("part") == "train"), NUMERIC, CATEGORICAL))
    return found.select("customer_id", *[rounded(F.col(f"{name}_scaled"), 5).alias(name) for name in NUMERIC],
                        *[F.col(f"{name}_code").cast("int").alias(f"{name}_code") for name in CATEGORICAL])
