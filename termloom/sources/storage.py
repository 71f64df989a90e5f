"""Tables that are computed once and read many times: Parquet in the folder that driver and
executors share, so that they survive a lost executor and filters reach their files.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session without it gets a folder of its own, removed at exit."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="termloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clustered(df: DataFrame, name: str, *keys: str, partitions: int) -> DataFrame:
    """stored, in ranges of the keys and sorted by them: a filter on them skips files and row groups."""
    return stored(df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys), name)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as the session has cores, if its scan gives fewer: a file of one row
    group is one task, whatever is then done with its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
