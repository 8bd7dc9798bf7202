"""Monthly revenue forecasts, for the total or for many series at once."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from patronage.functions.dates import month_label
from patronage.functions.numbers import money, rounded
from patronage.operators.features import with_statuses
from patronage.operators.rollups import PAID, fill_months, month_start
from patronage.session import at_once, few_partitions, staged

# Fixed values of the forecasting job.
LAGS = (1, 2, 3, 6)
ROLLING = 3
MIN_MONTHS = 8
MAX_HORIZON = 24
FALLBACK_MARGIN = 0.2
DEFAULT_ERROR = 0.15
CONFIDENCE = 1.96
SEED = 42
MEMORY = max(LAGS)
FEATURES = [f"lag_{lag}" for lag in LAGS] + ["rolling_3", "month_number"]
TOTAL = "total"


class Forecast(NamedTuple):
    history: DataFrame
    forecast: DataFrame
    metrics: DataFrame


def revenue_series(transactions: DataFrame, customers: DataFrame | None = None, statuses=PAID) -> DataFrame:
    """(series, month, revenue) without gaps: the total, and one series per state if customers are given.

    Lines are summed per customer and month before the state is looked up.
    """
    lines = with_statuses(transactions, statuses).filter(F.col("order_date").isNotNull())
    amount = F.sum(money("order_amount"))
    if customers is None:
        by_month = lines.groupBy(month_start("order_date").alias("month")).agg(amount.alias("revenue"))
        by_month = by_month.select(F.lit(TOTAL).alias("series"), "month", "revenue")
    else:
        by_customer = lines.groupBy("customer_id", month_start("order_date").alias("month")).agg(
            amount.alias("revenue"))
        states = by_customer.join(customers.select("customer_id", "state"), "customer_id", "left")
        named = states.select(F.explode(F.array_compact(F.array(F.lit(TOTAL), F.col("state")))).alias("series"),
                              "month", "revenue")
        by_month = named.groupBy("series", "month").agg(F.sum("revenue").alias("revenue"))
    filled = fill_months(by_month, ["revenue"], ["series"])
    return filled.select("series", "month", F.col("revenue").cast("double").alias("revenue"))


def history(series: DataFrame) -> DataFrame:
    return series.select("series", month_label("month").alias("month"), rounded(F.col("revenue"), 2).alias("revenue"))


def forecast_features(series: DataFrame) -> DataFrame:
    """Lags, the mean of the three months before and the month number; rows lacking one are left out."""
    by_month = W.partitionBy("series").orderBy("month")
    before = by_month.rowsBetween(-ROLLING, -1)
    rows = series.select(
        "series", "month", F.col("revenue").alias("target"),
        *[F.lag("revenue", lag).over(by_month).alias(f"lag_{lag}") for lag in LAGS],
        F.when(F.count("revenue").over(before) == ROLLING,
               F.sum(F.col("revenue").cast("decimal(28,4)")).over(before).cast("double") / ROLLING)
        .alias("rolling_3"),
        F.month("month").cast("double").alias("month_number"),
    )
    return rows.dropna(subset=FEATURES)


def moving_average_forecast(series: DataFrame, horizon: int = 6) -> DataFrame:
    """The mean of the last three months (or fewer) for every month ahead, plus and minus 20 %."""
    check_horizon(horizon)
    place = F.row_number().over(W.partitionBy("series").orderBy(F.col("month").desc()))
    recent = series.withColumn("_place", place).filter(F.col("_place") <= ROLLING)
    baseline = recent.groupBy("series").agg(
        F.max("month").alias("last"),
        (F.sum(F.col("revenue").cast("decimal(28,4)")).cast("double") / F.count("*")).alias("value"))
    return _ahead(baseline, horizon, F.col("value"), F.col("value") * (1 - FALLBACK_MARGIN),
                  F.col("value") * (1 + FALLBACK_MARGIN))


def _ahead(rows: DataFrame, horizon: int, value: Column, lower: Column, upper: Column) -> DataFrame:
    months = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return months.select(
        "series", month_label(F.add_months("last", F.col("step"))).alias("month"),
        rounded(value, 2).alias("forecast"), rounded(lower, 2).alias("lower"), rounded(upper, 2).alias("upper"))


def check_horizon(horizon: int) -> None:
    if not 1 <= horizon <= MAX_HORIZON:
        raise ValueError(f"horizon must lie between 1 and {MAX_HORIZON}")


def head_and_tail(features: DataFrame) -> DataFrame:
    """Mark the last quarter of each series, at least two rows, as ``tail``."""
    whole = W.partitionBy("series")
    n = F.count("*").over(whole)
    head = F.greatest(n - F.greatest(F.lit(2), F.floor(n / 4)), F.lit(1))
    place = F.row_number().over(whole.orderBy("month"))
    return features.withColumn("part", F.when(place <= head, "head").otherwise("tail"))


def relative(rows: DataFrame, basis: Column) -> DataFrame:
    """Revenue of every row as a multiple of its series' mean ``basis``, which is kept as ``scale``.

    A model over many series then learns from the shape of each, not from the largest.
    """
    mean = F.avg(basis).over(W.partitionBy("series"))
    rows = rows.withColumn("scale", F.when(mean > 0, mean).otherwise(1.0))
    return rows.withColumns({name: F.col(name) / F.col("scale") for name in ["target", *FEATURES[:-1]]})


def fit_trees(rows: DataFrame) -> PipelineModel:
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTRegressor(featuresCol="features", labelCol="target", maxIter=150, stepSize=0.05, maxDepth=3, seed=SEED)
    # hundreds of rounds over the rows: stored once, in no more partitions than they fill
    return PipelineModel([assembler, trees.fit(few_partitions(staged(assembler.transform(rows), "fit")))])


def error_measures(judged: DataFrame, model: str = "boosted_trees") -> DataFrame:
    """MAE, RMSE and MAPE per series; months with a zero target are left out of the last."""
    miss = F.col("target") - F.col("prediction")
    return judged.groupBy("series").agg(
        F.lit(model).alias("model"),
        rounded(F.avg(F.abs(miss)), 2).alias("mae"),
        rounded(F.sqrt(F.avg(miss * miss)), 2).alias("rmse"),
        rounded(F.avg(F.abs(F.try_divide(miss, F.col("target")))) * 100, 2).alias("mape"),
    )


def backtest(rows: DataFrame) -> DataFrame:
    """Errors of a model fitted on the head of every series and judged on its tail."""
    scaled = relative(rows, F.when(F.col("part") == "head", F.col("target")))
    judged = fit_trees(scaled.filter(F.col("part") == "head")).transform(scaled.filter(F.col("part") == "tail"))
    return error_measures(judged.withColumns({name: F.col(name) * F.col("scale") for name in ("target", "prediction")}))


def boosted_forecast(series: DataFrame, horizon: int = 6) -> tuple[DataFrame, DataFrame]:
    """(forecast, metrics): one model over all series, judged on each series' last quarter.

    The months ahead are predicted one after the other from the last six values of
    a series. These stand in one row per series, which is stored after every step, so
    that the plan of a step does not grow with the steps before it. The model works on
    multiples of each series' mean.
    """
    check_horizon(horizon)
    rows = staged(head_and_tail(forecast_features(series)), "forecast")
    metrics, model = at_once([lambda: staged(backtest(rows), "errors"), lambda: fit_trees(relative(rows, F.col("target")))])
    scales = relative(rows, F.col("target")).groupBy("series").agg(F.first("scale").alias("scale"))
    values = F.array(*[F.col(f"v{back}") / F.col("scale") for back in range(1, MEMORY + 1)])  # latest value first
    state = staged(last_values(series).join(scales, "series").select(
        "series", "last", "scale", values.alias("known"), F.array().cast("array<double>").alias("ahead")), "state")
    for step in range(1, horizon + 1):
        state = staged(next_month(state, model, step), "state")
    long = state.select("series", "last", "scale", F.posexplode("ahead").alias("_at", "_value")).select(
        "series", "last", (F.col("_at") + 1).alias("step"), (F.col("_value") * F.col("scale")).alias("value")).join(
        metrics.select("series", "rmse"), "series", "left")
    error = F.when(F.coalesce(F.col("rmse"), F.lit(0.0)) == 0, F.col("value") * DEFAULT_ERROR).otherwise(F.col("rmse"))
    ahead = long.select(
        "series", month_label(F.add_months("last", F.col("step"))).alias("month"),
        rounded(F.col("value"), 2).alias("forecast"),
        rounded(F.greatest(F.col("value") - CONFIDENCE * error, F.lit(0.0)), 2).alias("lower"),
        rounded(F.col("value") + CONFIDENCE * error, 2).alias("upper"))
    return ahead, metrics


def next_month(state: DataFrame, model: PipelineModel, step: int) -> DataFrame:
    """``state`` with the prediction for the month ``step`` months after the last one, in ``known`` and ``ahead``."""
    known = F.col("known")
    inputs = {f"lag_{lag}": known[lag - 1] for lag in LAGS}
    inputs["rolling_3"] = (known[0] + known[1] + known[2]) / ROLLING
    inputs["month_number"] = F.month(F.add_months("last", step)).cast("double")
    value = F.array(F.greatest(F.col("prediction"), F.lit(0.0)))
    return model.transform(state.withColumns(inputs)).select(
        "series", "last", "scale", F.concat(value, F.slice("known", 1, MEMORY - 1)).alias("known"),
        F.concat("ahead", value).alias("ahead"))


def last_values(series: DataFrame) -> DataFrame:
    """One row per series: its last month and its last six values, ``v1`` being the latest."""
    place = F.row_number().over(W.partitionBy("series").orderBy(F.col("month").desc()))
    recent = series.withColumn("_place", place).filter(F.col("_place") <= MEMORY)
    return recent.groupBy("series").agg(
        F.max("month").alias("last"),
        *[F.max(F.when(F.col("_place") == back, F.col("revenue"))).alias(f"v{back}") for back in range(1, MEMORY + 1)])


def revenue_forecast(series: DataFrame, horizon: int = 6) -> Forecast:
    """Boosted trees for series of at least eight months, the moving average for shorter ones."""
    check_horizon(horizon)
    series = staged(series, "series")
    sized = series.withColumn("_n", F.count("*").over(W.partitionBy("series")))
    long = sized.filter(F.col("_n") >= MIN_MONTHS).drop("_n")
    short = sized.filter(F.col("_n") < MIN_MONTHS).drop("_n")
    ahead = moving_average_forecast(short, horizon)
    metrics = short.select("series").distinct().select(
        "series", F.lit("moving_average").alias("model"),
        *[F.lit(None).cast("double").alias(name) for name in ("mae", "rmse", "mape")])
    if not long.isEmpty():
        boosted, judged = boosted_forecast(long, horizon)
        ahead, metrics = boosted.unionByName(ahead), judged.unionByName(metrics)
    return Forecast(history(series), ahead, metrics)
