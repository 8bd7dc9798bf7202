"""A keyed dataset in hash buckets, of which a load rewrites those its keys fall into.

Every load is a version, a folder that holds the buckets it has changed and a layout:
for every bucket that has rows, the version whose folder holds it. Files of a version
never change. So the cost of a load follows the buckets it touches, readers of an older
version are not disturbed, and a load that dies leaves a folder that nothing names.
Which version is the dataset is for the caller to note, as the last step of a load.

The number of buckets is fixed by the first version. A bucket should be what a task reads
well, some 100 MB, so large datasets want thousands of them.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.session import file_system

BUCKETS = 32
BUCKET = "bucket"
_LAYOUT = "bucket INT, version STRING, buckets INT"


class Layout(NamedTuple):
    """How many buckets there are, and which version holds each that has rows."""

    buckets: int
    versions: dict[int, str]


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_layout(spark: SparkSession, folder: str, version: str) -> Layout:
    rows = spark.read.schema(_LAYOUT).json(f"{folder}/{version}/layout").collect()  # a row per bucket, and one more
    return Layout(rows[0]["buckets"], {row["bucket"]: row["version"] for row in rows if row["bucket"] is not None})


def read_buckets(spark: SparkSession, folder: str, layout: Layout, wanted: Iterable[int] | None = None
                 ) -> DataFrame | None:
    """The rows of the wanted buckets, of all by default; None if they have none."""
    numbers = layout.versions if wanted is None else layout.versions.keys() & set(wanted)
    paths = [f"{folder}/{layout.versions[number]}/rows/{BUCKET}={number}" for number in sorted(numbers)]
    return spark.read.parquet(*paths) if paths else None


def touched_buckets(rows: DataFrame, key: str, layout: Layout) -> list[int]:
    return sorted(row[0] for row in rows.select(bucket_of(F.col(key), layout.buckets)).distinct().collect())


def write_version(rows: DataFrame, key: str, folder: str, version: str, layout: Layout, touched: Iterable[int]) -> Layout:
    """Write whole buckets as a version; the other buckets stay where they are."""
    # the tasks of the write hold whole buckets, and as many as their size calls for
    dealt = rows.withColumn(BUCKET, bucket_of(F.col(key), layout.buckets)).hint("rebalance", BUCKET)
    dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{folder}/{version}/rows")
    now = Layout(layout.buckets, layout.versions | dict.fromkeys(touched, version))
    # one row without a bucket, so that the number of buckets is told by an empty dataset as well
    entries = [(None, None, now.buckets), *[(number, held, now.buckets) for number, held in sorted(now.versions.items())]]
    rows.sparkSession.createDataFrame(entries, _LAYOUT).coalesce(1).write.mode("overwrite").json(
        f"{folder}/{version}/layout")
    return now


def remove_superseded(spark: SparkSession, folder: str, layout: Layout) -> list[str]:
    """Delete the buckets that the layout no longer names, for when no reader of older versions is left.

    Also what dead loads left behind; must not run beside a load. Returns what was deleted.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = file_system(spark, folder)
    kept = {f"{version}/{BUCKET}={number}" for number, version in layout.versions.items()}
    gone = []
    for version in files.listStatus(path(folder)):
        rows = path(version.getPath(), "rows")
        for bucket in files.listStatus(rows) if files.exists(rows) else []:
            name = f"{version.getPath().getName()}/{bucket.getPath().getName()}"
            if bucket.isDirectory() and name not in kept:
                files.delete(bucket.getPath(), True)
                gone.append(name)
    return sorted(gone)
