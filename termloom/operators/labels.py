"""Preferred terms by policy, two-tier labels, display groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of each policy; they are fixed values: own language, preferred, synonym, FSN, short
#: term, penalty per character.
POLICIES = {
    "hierarchy": {"language": 40, "preferred": 20, "synonym": 12, "fsn": 8, "short": 2},
    "expression": {"language": 100, "preferred": 20, "fsn": 8, "per_char": -0.01},
    "summary": {"language": 20, "synonym": 10, "fsn": 8, "preferred": 2},
    "projection": {"preferred": 40, "synonym": 20, "fsn": 8, "short": 2},
}
SHORT = 28


def label_score(policy: str, language: str) -> Column:
    """Of a description row with language_code, is_preferred, kind and term."""
    w = POLICIES[policy]
    on = lambda name, condition: F.when(condition, w.get(name, 0)).otherwise(0)
    total = on("language", F.col("language_code") == language) + on("preferred", F.col("is_preferred")) + on("synonym", F.col("kind") == "synonym") + on("fsn", F.col("kind") == "fsn") + on("short", F.length("term") <= SHORT)
    return total + F.length("term") * F.lit(w.get("per_char", 0.0))


def preferred_terms(descriptions: DataFrame, policy: str, language: str) -> DataFrame:
    """concept_id, label: the best description of each concept; of equals the lesser term."""
    scored = descriptions.withColumn("_s", label_score(policy, language))
    order = Window.partitionBy("concept_id").orderBy(F.col("_s").desc(), "term", "description_id")
    return scored.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("concept_id", F.col("term").alias("label"))


def two_tier_labels(ids: DataFrame, projected: DataFrame, source: DataFrame, language: str) -> DataFrame:
    """concept_id, label, tier: from the search projection, else from the source, else the id."""
    first = preferred_terms(projected, "projection", language).withColumnRenamed("label", "l1")
    second = preferred_terms(source, "hierarchy", language).withColumnRenamed("label", "l2")
    joined = ids.join(first, "concept_id", "left").join(second, "concept_id", "left")
    tier = F.when(F.col("l1").isNotNull(), "projection").when(F.col("l2").isNotNull(), "source").otherwise("none")
    return joined.select("concept_id", F.coalesce("l1", "l2", "concept_id").alias("label"), tier.alias("tier"))


def display_group(tier: Column) -> Column:
    """Groups that results are shown in, after the match tiers."""
    return F.when(tier <= 1, "exact").when(tier <= 5, "normalized").when(tier <= 9, "prefix").otherwise("fuzzy")
