"""Connected components by alternating large-star and small-star steps.

Both steps group the edges by node and hang a node's neighbours on the smallest one.
Repeated in turn they leave a star per component, around its smallest node. A node
with very many edges is never gathered: its smallest neighbour is an aggregate, which
is stored, so that the edges meet it in a join whose large partitions Spark splits.

Edges with a null end and loops are left out; repeated edges count once. No edges:
no rows. Every round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import staged


def _digest(edges: DataFrame) -> tuple:
    code = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(code)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node move to the smallest node around it."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and the node itself, move to the smallest of them."""
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, one: str, other: str) -> DataFrame:
    """(node, component) for every node that is not the smallest of its component."""
    a, b = F.col(one), F.col(other)
    current = staged(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
                     "edges")
    digest = _digest(current)
    while digest[0]:
        current = staged(_small_star(staged(_large_star(current), "large")), "edges")
        before, digest = digest, _digest(current)
        if digest == before:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
