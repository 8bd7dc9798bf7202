"""Intermediate tables: one folder per application, removed on demand."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from patronage.queries import QUERIES
from patronage.session import clear_staged, few_partitions, shared_folder, staged, staging_folder

FOLDER = "/root/testdata/sf0.001"


def test_nothing_is_left_and_a_rerun_works(spark):
    first = sorted(map(tuple, QUERIES["rfm_scores"](spark, FOLDER).collect()), key=repr)
    here = staging_folder(spark).removeprefix("file:")
    assert os.listdir(here) and here.startswith(shared_folder(spark).removeprefix("file:"))
    clear_staged(spark)
    assert not os.path.exists(here)
    assert sorted(map(tuple, QUERIES["rfm_scores"](spark, FOLDER).collect()), key=repr) == first
    clear_staged(spark)
    clear_staged(spark)


def test_staged_tables_are_below_the_folder(spark):
    table = staged(spark.range(3), "numbers")
    assert table.count() == 3 and staging_folder(spark).removeprefix("file:") in table.inputFiles()[0]


def test_rows_of_many_rounds_fill_the_cores_evenly(spark):
    stored = staged(spark.range(20_000).coalesce(1), "rounds")  # one file
    cores = spark.sparkContext.defaultParallelism

    def sizes(**limits):
        dealt = few_partitions(stored, **limits)
        assert dealt.agg(F.sum("id")).first()[0] == 199_990_000
        return sorted(row["count"] for row in dealt.groupBy(F.spark_partition_id()).count().collect())

    assert len(sizes(rows=5_000)) == min(4, cores)
    even = sizes(rows=100)
    assert len(even) == cores and even[-1] - even[0] <= 10
    assert len(sizes(rows=100, most=20_000 // cores - 1)) == 2 * cores
    assert sizes() == [20_000]
