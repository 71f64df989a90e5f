"""Sources and sinks: snapshot map files, JSON, upsert, replacement, deletion, user overrides."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import stored


def read_map_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated release file with a header; its name must say that it is a snapshot."""
    if not re.search("snapshot", path.rstrip("/").rsplit("/", 1)[-1], re.I):
        raise ValueError(f"{path} isn't a snapshot file")
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    rows = rows.toDF(*(c.removeprefix("﻿") for c in rows.columns))
    if "mapTarget" not in rows.columns:
        raise ValueError(f"{path} has no column mapTarget")
    number = lambda c: F.col(c).cast("int") if c in rows.columns else F.lit(None).cast("int")
    text = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    return rows.select(F.col("referencedComponentId").alias("concept_id"), F.col("refsetId").alias("refset_id"), (F.col("active") == "1").alias("active"), F.col("mapTarget").alias("map_target"), number("mapGroup").alias("map_group"), number("mapPriority").alias("map_priority"), text("mapRule").alias("map_rule"), text("effectiveTime").alias("effective_time"))


def read_captured_runs(spark: SparkSession, folder: str, schema, pattern: str = "*-hybrid.json") -> DataFrame:
    """Evaluation runs that were saved as one JSON file each, with the file's name."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern).json(folder)
    return rows.withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -1))


def map_member_source(spark: SparkSession, fetch, concept_ids: list[str], page: int = 100) -> DataFrame:
    """Map members of concepts from a paged service, by the Python Data Source API: concept_id,
    refset_id, active, map_target, map_group, map_priority, map_rule, effective_time, provenance.

    fetch(concept_id, offset, limit) -> list of dicts stands for the service's GET; a page shorter
    than the limit is the last. Concepts are dealt to partitions, each fetched by its own task.
    """
    spark.dataSource.register(_member_source(fetch, tuple(concept_ids), page))
    return spark.read.format("map_members").load()


MEMBERS = "concept_id string, refset_id string, active boolean, map_target string, map_group int, map_priority int, map_rule string, effective_time string, provenance string"


def _member_source(fetch, concept_ids: tuple[str, ...], page: int):
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def partitions(self):
            step = max(1, -(-len(concept_ids) // 32))
            return [InputPartition(concept_ids[k : k + step]) for k in range(0, len(concept_ids), step)] or [InputPartition(())]

        def read(self, partition):
            for concept in partition.value:
                offset = 0
                while True:
                    members = fetch(concept, offset, page)
                    for m in members:
                        extra = m.get("additionalFields", {})
                        number = lambda k: int(extra[k]) if str(extra.get(k, "")).isdigit() else None
                        yield (str(m.get("referencedComponentId", concept)), str(m.get("refsetId", "")), bool(m.get("active")), extra.get("mapTarget"), number("mapGroup"), number("mapPriority"), extra.get("mapRule"), m.get("effectiveTime"), f"{concept}@{offset}")
                    offset += len(members)
                    if len(members) < page:
                        break

    class Source(DataSource):
        @classmethod
        def name(cls):
            return "map_members"

        def schema(self):
            return MEMBERS

        def reader(self, schema):
            return Reader()

    return Source


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with rows of new in place of those with the same key. Two rows of new with one key are an
    error, found as the rows are read."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    unique = F.when(n > 1, F.raise_error(F.concat(F.lit("several new rows have the key "), F.col(key).cast("string")))).otherwise(F.lit(True))
    new = new.withColumn("_unique", unique).where("_unique").drop("_unique")
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def deleted(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key), key, "left_anti")


def by_priority(*sources: DataFrame, key: str) -> DataFrame:
    """Union of sources; of rows with the same key the last source's stays."""
    whole = None
    for k, source in enumerate(sources):
        numbered = source.withColumn("_source", F.lit(k))
        whole = numbered if whole is None else whole.unionByName(numbered)
    order = Window.partitionBy(key).orderBy(F.col("_source").desc())
    return whole.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "_source")


def replace_release(rows: DataFrame, path: str) -> None:
    """Writes rows partitioned by release_id; only the releases in rows are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("release_id").parquet(path)


def clear_release(spark: SparkSession, path: str, release_id: str) -> None:
    """Drops one release's files; others stay."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/release_id={release_id}")
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def reset(rows: DataFrame, path: str) -> None:
    """Writes rows in place of all releases."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("release_id").parquet(path)


def appended(rows: DataFrame, path: str) -> None:
    """Adds rows, one or many, to a stored table."""
    rows.write.mode("append").parquet(path)


def upsert_release(spark: SparkSession, rows: DataFrame, path: str, key: str) -> None:
    """Replaces rows with the same key in the releases that rows have; other releases aren't read.
    The new content is stored first, as a table can't be read while it is overwritten."""
    releases = rows.select("release_id").distinct()
    old = spark.read.schema(rows.schema).parquet(path).join(releases, "release_id", "left_semi")
    replace_release(stored(upserted(old, rows, key), "upsert"), path)


def retired_tables(spark: SparkSession, retired: list[str], drop: bool = False) -> list[str]:
    """Tables of the catalog that are on the list; dropped only if asked."""
    found = sorted(t.name for t in spark.catalog.listTables() if t.name in set(retired) and not t.isTemporary)
    for name in found if drop else ():
        spark.sql(f"DROP TABLE {name}")
    return found


def redacted_plan(df: DataFrame, most: int = 50) -> str:
    """The formatted plan with long value lists cut."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    cut = lambda values: f"{values.split(',')[0]}, ... {values.count(',') + 1} values"
    text = re.sub(r"\(([^()]*)\)", lambda m: f"({cut(m[1])})" if m[1].count(",") >= most else m[0], text)
    return re.sub(r"INSET ([^()\n]*)", lambda m: f"INSET {cut(m[1])}" if m[1].count(",") >= most else m[0], text)
