"""Lookups by key: tables by release with Bloom filters, lists of any length, counts from file footers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lists up to this long become literals that reach the files' statistics and Bloom filters; longer ones are semi joins.
LONGEST_LITERAL = 200


def keyed(rows: DataFrame, path: str, order: str, *blooms: str, distinct: int = 1_000_000, partitions: int | None = None) -> DataFrame:
    """Writes rows by release_id, sorted by `order` within a release, and opens them. The row groups
    carry Bloom filters on the columns `blooms`, sized for `distinct` values each: an equality on one
    skips row groups whose least and greatest value say nothing, as its values are spread over all."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = rows.repartitionByRange(n, "release_id", order).sortWithinPartitions("release_id", order).write.partitionBy("release_id")
    for column in blooms:
        # without a dictionary, which would make the filter unnecessary in small row groups
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", True).option(f"parquet.bloom.filter.expected.ndv#{column}", distinct).option(f"parquet.enable.dictionary#{column}", False)
    writer.parquet(path)
    return opened(rows.sparkSession, path, rows)


def opened(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def looked_up(rows: DataFrame, key: str, ids: Sequence[str] | DataFrame, longest: int = LONGEST_LITERAL) -> DataFrame:
    """Rows whose key is among ids, each once however often an id is given; null is nobody's key. A
    DataFrame of ids (its first column) or a long list is a semi join, for which Spark picks
    broadcast or shuffle by size."""
    if not isinstance(ids, DataFrame):
        wanted = sorted({x for x in ids if x is not None})
        if len(wanted) <= longest:
            return rows.where(F.col(key).isin(*wanted) if wanted else F.lit(False))
        ids = rows.sparkSession.createDataFrame([(x,) for x in wanted], f"{key} string")
    return rows.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi").select(*rows.columns)


def in_release(rows: DataFrame, releases: DataFrame, condition: str) -> DataFrame:
    """Rows of the releases that a condition on a table of releases names (release_id unique): read
    from those releases' folders alone, chosen while the query runs."""
    chosen = releases.where(condition).select("release_id")
    return rows.join(chosen, "release_id").select(*rows.columns)


def footers(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """n, and least_ and most_ of each column (numbers or dates), worked out from file footers: no
    data page is read. The plan belongs to a session of its own, whose settings allow it."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    bounds = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("least", F.min), ("most", F.max))]
    return own.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), *bounds)


def estimated_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """name, n for each named path: one row of footers each."""
    return spark.createDataFrame([(name, footers(spark, path).first().n) for name, path in paths.items()], "name string, n long")
