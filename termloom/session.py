"""SparkSession factory and the cluster-shared scratch folder."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """Local session for tests and benches; a cluster's own submit settings win over DEFAULTS."""
    builder = SparkSession.builder.appName("termloom").master(master or f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    conf = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": memory} | extra
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
