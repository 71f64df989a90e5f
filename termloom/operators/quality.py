"""Data quality: hardening of raw concepts, coverage, orphans, counters, three-valued readiness."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_release_date, truthy


def harden(raw: DataFrame) -> DataFrame:
    """Ids to strings, flags to booleans, edges to keys type|destination of active relationships."""
    ids = {c: F.col(c).cast("string") for c in ("concept_id", "module_id", "definition_status_id") if c in raw.columns}
    arrays = {c: F.transform(c, lambda x: x.cast("string")) for c in ("parent_ids", "child_ids", "ancestor_ids") if c in raw.columns}
    out = raw.withColumns(ids | arrays | {"active": truthy(F.col("active"))})
    if "relationships" in raw.columns:
        keys = F.transform(F.filter("relationships", lambda r: truthy(r["active"]) & (r["type_id"].cast("string") != "") & (r["destination_id"].cast("string") != "")), lambda r: F.concat_ws("|", r["type_id"].cast("string"), r["destination_id"].cast("string")))
        out = out.withColumn("relationship_attribute_keys", F.array_distinct(keys))
    return out.drop("descendant_ids")


def stamp_release(rows: DataFrame, release_id: str, overwrite: bool) -> DataFrame:
    """release_id and release_date on all rows, or only on those without a release."""
    own = F.col("release_id") if "release_id" in rows.columns else F.lit(None).cast("string")
    stamped = F.lit(release_id) if overwrite else F.coalesce(own, F.lit(release_id))
    return rows.withColumn("release_id", stamped).withColumn("release_date", parse_release_date(F.col("release_id")))


def coverage_by_language(descriptions: DataFrame) -> DataFrame:
    per = descriptions.groupBy("language_code", "concept_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("language_code").agg(F.count(F.lit(1)).alias("concepts"), F.sum("n").alias("descriptions"))


def orphans(projected: DataFrame, concepts: DataFrame) -> DataFrame:
    return projected.join(concepts.where("active").select("concept_id"), "concept_id", "left_anti")


def tri_and(*facts: Column) -> Column:
    """SQL's own three-valued AND."""
    return reduce(lambda a, b: a & b, facts)


def tri_or(*facts: Column) -> Column:
    return reduce(lambda a, b: a | b, facts)


def tri_not(fact: Column) -> Column:
    return ~fact


def hardening_counters(raw: DataFrame) -> DataFrame:
    """Six counts in one pass over raw concepts whose ids are still strings of their JSON form:
    stored descendants, numeric ids among ancestors, parents, children and descriptions, and
    relationships without their keys. Numeric ids are told by the column's type flags
    ancestor_type, parent_type, child_type, description_type (string or number)."""
    numeric = lambda c: F.count_if(F.col(c) == "number")
    return raw.agg(
        F.count_if(F.col("descendant_ids").isNotNull()).alias("stored_descendants"), numeric("ancestor_type").alias("numeric_ancestors"), numeric("parent_type").alias("numeric_parents"), numeric("child_type").alias("numeric_children"),
        numeric("description_type").alias("numeric_descriptions"), F.count_if((F.size(F.coalesce("relationships", F.array().cast("array<string>"))) > 0) & F.col("relationship_keys").isNull()).alias("missing_keys"),
    )


def type_sets(raw: DataFrame, *columns: str) -> DataFrame:
    """One row: for each column the sorted set of its values' types, null for missing ones."""
    kind = lambda c: F.when(F.col(c).isNull(), "null").when(F.col(c).cast("string").rlike("^-?[0-9]+$"), "number").when(F.lower(F.col(c).cast("string")).isin("true", "false"), "bool").otherwise("string")
    return raw.agg(*(F.array_join(F.array_sort(F.collect_set(kind(c))), ",").alias(c) for c in columns))


def existence_facts(rows: DataFrame, **facts: Column) -> DataFrame:
    """One row: whether any row has each fact; false for an empty table. One pass, combined before the shuffle."""
    return rows.agg(*(F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False)).alias(k) for k, c in facts.items()))


def readiness(facts: DataFrame) -> DataFrame:
    """The report on recorded facts, one row per model: true, false or, where a fact it needs
    wasn't recorded and the others don't decide, null.

    facts: has_release_id, has_effective_time, has_release_date, has_descendants, numeric_ancestors,
    numeric_parents, numeric_children, numeric_descriptions, has_keys, projection_release_date,
    has_tag_key, has_vectors; and what storage offers: indexed_release_id, indexed_effective_time,
    indexed_ancestors, indexed_keys, indexed_lookup, text_ready, vector_ready, projection_rows.
    """
    c = F.col
    parts = {
        "projection_populated": c("projection_rows") > 0, "text_ready": c("text_ready"), "vector_ready": c("vector_ready"), "vectors_present": c("has_vectors"), "ancestor_lookup_ready": c("indexed_ancestors"),
        "diff_ready": tri_or(c("has_release_id"), c("has_effective_time")), "diff_indexed": tri_or(tri_and(c("has_release_id"), c("indexed_release_id")), tri_and(c("has_effective_time"), c("indexed_effective_time"))),
        "release_metadata_ready": tri_and(c("has_release_id"), c("has_release_date"), c("projection_release_date")), "descendants_retired": tri_not(c("has_descendants")),
        "ids_are_strings": tri_not(tri_or(c("numeric_ancestors"), c("numeric_parents"), c("numeric_children"), c("numeric_descriptions"))), "terms_ready": tri_and(c("indexed_lookup"), c("has_tag_key")), "attributes_ready": tri_and(c("has_keys"), c("indexed_keys")),
    }
    out = facts.withColumns(parts)
    hardened = tri_and(*(c(k) for k in ("release_metadata_ready", "descendants_retired", "ids_are_strings", "terms_ready", "attributes_ready")))
    vectors = F.when(c("vector_ready"), True).otherwise(tri_not(c("has_vectors")))
    architecture = tri_and(c("projection_populated"), c("text_ready"), c("indexed_ancestors"), vectors)
    return out.withColumns({"hardened_ready": hardened, "architecture_ready": architecture})


REPORT = ("projection_populated", "text_ready", "vector_ready", "vectors_present", "ancestor_lookup_ready", "diff_ready", "diff_indexed", "release_metadata_ready", "descendants_retired", "ids_are_strings", "terms_ready", "attributes_ready", "hardened_ready", "architecture_ready")


def missing_required(required: DataFrame, source: DataFrame, projected: DataFrame) -> DataFrame:
    """concept_id, missing_in: required concepts that aren't active in the source, or not projected."""
    gone = lambda df, where: required.select("concept_id").distinct().join(df.select("concept_id"), "concept_id", "left_anti").withColumn("missing_in", F.lit(where))
    return gone(source.where("active"), "source").unionByName(gone(projected, "projection"))


def same_sets(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def stored_differences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """note_id, concept_id, problem: expected codings (note_id, concept_id, assertion, subject,
    ancestor_ids) that a table of stored ones lacks or holds with other ancestors."""
    key = ["note_id", "concept_id", "assertion", "subject"]
    held = found.select(*key, F.col("ancestor_ids").alias("_held"), F.lit(True).alias("_there"))
    joined = expected.select(*key, "ancestor_ids").join(held, key, "left")
    problem = F.when(F.col("_there").isNull(), "missing").when(~same_sets(F.col("ancestor_ids"), F.coalesce("_held", F.array().cast("array<string>"))), "ancestry")
    return joined.withColumn("problem", problem).where("problem IS NOT NULL").select("note_id", "concept_id", "problem")
