"""Customer clusters and how well they separate."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.functions.numbers import rounded
from patronage.operators.measures import silhouettes
from patronage.session import at_once, few_partitions, staged

FEATURES = ["recency_days", "order_count", "total_revenue", "average_order_value", "campaign_response_rate"]
SEED = 42
RESTARTS = 10


class Clusters(NamedTuple):
    assignments: DataFrame
    silhouette: float | None


def cluster_count(customers: int) -> int:
    return min(4, max(2, customers // 10))


def finite(value: Column) -> Column:
    """Null and infinite values count as 0."""
    value = F.nanvl(value.cast("double"), F.lit(0.0))
    return F.when(F.abs(value) < float("inf"), value).otherwise(0.0)


def log_features(master: DataFrame, features: list[str] | None = None) -> DataFrame:
    """customer_id, name and the logarithms of the measures as a vector ``raw``."""
    features = features or FEATURES
    logs = [F.log1p(finite(F.col(name))).alias(name) for name in features]
    rows = VectorAssembler(inputCols=features, outputCol="raw").transform(master.select("customer_id", "name", *logs))
    return rows.select("customer_id", "name", "raw")


def standardised(rows: DataFrame) -> DataFrame:
    """``features``: every logarithm less its mean, in standard deviations."""
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(rows)
    return scaler.transform(rows).select("customer_id", "name", "features")


def cluster_customers(master: DataFrame, features: list[str] | None = None) -> Clusters:
    """K-means on the logarithms of five measures; the best of ten starts is kept.

    Fewer than four customers give no clusters. The silhouette uses squared
    distances, the only form that needs no comparison of all pairs of rows.
    """
    rows = staged(log_features(master, features), "clustering")
    customers = rows.count()
    if customers < 4:
        return Clusters(rows.select("customer_id", "name", F.lit(None).cast("int").alias("cluster")).limit(0), None)

    scaled = few_partitions(staged(standardised(rows), "scaled")).persist()
    k = cluster_count(customers)
    starts = [KMeans(k=k, seed=SEED + start, featuresCol="features", predictionCol="cluster")
              for start in range(RESTARTS)]
    fits = at_once([lambda start=start: start.fit(scaled) for start in starts])
    best = min(fits, key=lambda fit: fit.summary.trainingCost)
    assigned = staged(best.transform(scaled), "clusters")
    scaled.unpersist()
    names = [f"v{i}" for i in range(len(features or FEATURES))]
    values = vector_to_array("features")
    spread = assigned.select("cluster", *[values[i].alias(name) for i, name in enumerate(names)])
    silhouette = silhouettes(spread, "cluster", names).agg(rounded(F.avg("silhouette"), 4)).first()[0]
    return Clusters(assigned.select("customer_id", "name", "cluster"), silhouette)


def group_silhouettes(rows: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Per group of customers: how many, and the mean silhouette of their standardised logarithms.

    ``rows`` are as ``log_features`` gives them, ``groups`` has customer_id and ``group``.
    """
    values = vector_to_array("features")
    names = [f"v{i}" for i in range(len(FEATURES))]
    spread = standardised(rows).select("customer_id", *[values[i].alias(name) for i, name in enumerate(names)])
    told = silhouettes(staged(spread.join(groups.select("customer_id", group), "customer_id"), "grouped"), group, names)
    return told.groupBy(group).agg(F.count("*").alias("customers"), rounded(F.avg("silhouette"), 4).alias("silhouette"))
