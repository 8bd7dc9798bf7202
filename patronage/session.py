"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str, cores: str | int = "*", shuffle_partitions: int = 8,
                  memory: str = "16g") -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # a small file is one task; a shuffle spreads what follows over the cores
        .config("spark.sql.autoBroadcastJoinThreshold", "512k")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own, which goes
    when the program ends.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            named = tempfile.mkdtemp(prefix="patronage-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def staging_folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables, below the shared folder."""
    return f"{shared_folder(spark)}/patronage-{spark.sparkContext.applicationId}"


def file_system(spark: SparkSession, path: str) -> Any:
    """The Hadoop file system that holds ``path``."""
    named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    return file_system(spark, path).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))


def clear_staged(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application, once its results have been written or collected."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging_folder(spark))
    file_system(spark, staging_folder(spark)).delete(path, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the staging folder and read it back.

    The result can be scanned many times, column by column, without running the
    plan behind it again, also after an executor is lost.
    """
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_partitions(df: DataFrame, rows: int = 50_000, most: int = 250_000) -> DataFrame:
    """Stored rows dealt out evenly for very many rounds over all of them.

    There are as many partitions as the rows fill with ``rows`` each, but no more than
    cores, or than the same number for every core where a partition would hold more
    than ``most``: what a round pays per partition does not grow with the rows.
    """
    n, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    parts = max(min(-(-n // rows), cores * -(-n // (most * cores))), 1)
    return df.coalesce(1) if parts == 1 else df.repartition(parts)


LINE = "line"


def staged_lines(df: DataFrame, label: str) -> DataFrame:
    """``staged``, with a number of every row: unique, and as it is stored the same on every read."""
    return staged(df.withColumn(LINE, F.monotonically_increasing_id()), label)


def at_once(jobs: Sequence[Callable[[], Any]], most: int = 16) -> list:
    """Results of independent jobs, submitted to Spark at the same time, ``most`` of them."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=min(max(len(jobs), 1), most)) as pool:
        return [future.result() for future in [pool.submit(inherit(job)) for job in jobs]]
