"""Training-corpus pipeline: STAGES in order, each writing Parquet that the next one reads.

Quality rules drop the documents they reject; line dedup cuts repeated lines out of the
texts; of each group of near copies one document stays; mixing repeats or drops documents
by their sources' targets; packing returns the pieces of token sequences. All but the last
return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import line_dedup, mixing, ngram_join, packing, quality
from termloom.llm.shared import scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_clean(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("line_dedup", drop_repeated_lines), ("ngram_join", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Divergence from corpus references, tokenization and packing are beyond SQL; tests/llm holds
#: each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
