"""Maps to other code systems: forward and reverse translation, replacement of a refset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def needs_context(rule: Column) -> Column:
    """A rule other than an unconditional one."""
    return ~F.upper(F.trim(F.coalesce(rule, F.lit("TRUE")))).isin("TRUE", "OTHERWISE TRUE")


def forward(mappings: DataFrame, target_system: str, version: str | None = None) -> DataFrame:
    """Active targets of every concept, with equivalence; who limits them orders them, by group and priority."""
    kept = mappings.where("active").where(F.col("target_system") == target_system)
    if version:
        kept = kept.where(F.col("target_version") == version)
    return kept.withColumn("equivalence", F.when(needs_context(F.col("map_rule")), "relatedto").otherwise("equivalent"))


def reverse(mappings: DataFrame, target_system: str, target: str, labels: DataFrame) -> DataFrame:
    """Concepts that map to a target, with their English synonym where there is one."""
    kept = mappings.where("active").where((F.col("target_system") == target_system) & (F.col("map_target") == target)).select("concept_id").distinct()
    english = labels.where("kind = 'synonym' AND language_code = 'en'").select(F.col("concept_id").alias("c"), "term")
    return kept.join(english, F.col("concept_id") == F.col("c"), "left").select("concept_id", F.col("term").alias("display"))


def replace_refset(old: DataFrame, new: DataFrame, known: DataFrame) -> DataFrame:
    """old without the refsets that new brings for a concept, and new rows of known concepts."""
    fresh = new.join(known.select("concept_id").distinct(), "concept_id", "left_semi")
    kept = old.join(fresh.select("concept_id", "refset_id").distinct(), ["concept_id", "refset_id"], "left_anti")
    return kept.unionByName(fresh)


# What a translation says of itself, and where it comes from.
NO_MAPPING = "No published mapping is loaded for this code and target system."
REVERSED = "Reverse lookup returns candidates from a directional map. It does not establish equivalent meaning."
CONDITIONAL = "Conditional mapping candidates: evaluate the published rules and group priorities before assigning target codes."
PUBLISHED = "Published mapping targets. Preserve their map groups, advice and classification version."
TRUNCATED = " Results were limited."
SOURCE_MAP, EXTENSION = "http://snomed.info/sct?fhir_cm=", "urn:snomed-demo:map-"
MOST_MATCHES = 100


def parameters_json(codes: DataFrame, matches: DataFrame, reverse: bool = False, most: int = MOST_MATCHES) -> DataFrame:
    """concept_id, resource: a FHIR Parameters resource as JSON for each of codes (concept_id): result,
    message, and up to most matches in order of group and priority, with their map's group,
    priority, rule and advice as extensions. A code without matches says so.

    matches: concept_id, refset_id, target_system, map_target, map_group, map_priority, map_rule,
    and, if there are any, target_version, display, map_advice, equivalence.
    """
    has = lambda name: F.col(name).cast("string") if name in matches.columns else F.lit(None).cast("string")
    row = F.struct(F.col("map_group").cast("int").alias("g"), F.col("map_priority").cast("int").alias("p"), "map_target", "target_system", "refset_id", F.col("map_rule"), has("target_version").alias("version"), has("display").alias("display"), has("map_advice").alias("advice"), has("stated").alias("stated"))
    grouped = matches.groupBy("concept_id").agg(F.array_sort(F.collect_list(row)).alias("m"))
    rows = codes.select("concept_id").distinct().join(grouped, "concept_id", "left").withColumn("m", F.coalesce("m", F.array().cast(grouped.schema["m"].dataType)))
    contextual, any_match = F.exists("m", lambda x: needs_context(x["map_rule"])), F.size("m") > 0
    text = F.when(~any_match, NO_MAPPING).when(F.lit(reverse), REVERSED).when(contextual, CONDITIONAL).otherwise(PUBLISHED)
    message = F.concat(text, F.when(F.size("m") > most, TRUNCATED).otherwise(""))
    part = lambda name, **value: F.struct(F.lit(name).alias("name"), *(value.get(k, F.lit(None).cast(t)).alias(k) for k, t in PART.items()))
    extension = lambda name, number=None, string=None: F.struct(F.lit(EXTENSION + name).alias("url"), (F.lit(None).cast("int") if number is None else number).alias("valueInteger"), (F.lit(None).cast("string") if string is None else string).alias("valueString"))

    def match(x: Column) -> Column:
        equivalence = F.when(F.lit(reverse) | contextual, "relatedto").otherwise(F.coalesce(x["stated"], F.lit("relatedto")))
        coding = F.struct(x["target_system"].alias("system"), x["map_target"].alias("code"), x["version"].alias("version"), x["display"].alias("display"))
        parts = F.array(part("equivalence", valueCode=equivalence), part("concept", valueCoding=coding), part("source", valueUri=F.concat(F.lit(SOURCE_MAP), x["refset_id"])))
        one = lambda n: F.when(F.coalesce(n, F.lit(0)) == 0, 1).otherwise(n)
        more = F.array(extension("group", one(x["g"])), extension("priority", one(x["p"])), F.when(F.coalesce(x["map_rule"], F.lit("")) != "", extension("rule", string=x["map_rule"])), F.when(F.coalesce(x["advice"], F.lit("")) != "", extension("advice", string=x["advice"])))
        return F.struct(F.lit("match").alias("name"), F.lit(None).cast("boolean").alias("valueBoolean"), F.lit(None).cast("string").alias("valueString"), parts.alias("part"), F.array_compact(more).alias("extension"))

    matched = F.transform(F.slice("m", 1, most), match)
    head = lambda name, flag, string: F.struct(F.lit(name).alias("name"), flag.cast("boolean").alias("valueBoolean"), string.cast("string").alias("valueString"))
    heads = F.to_json(F.array(head("result", any_match, F.lit(None)), head("message", F.lit(None), message)))
    listed = F.to_json(matched)
    inner = F.when(any_match, F.concat(F.substring(heads, F.lit(1), F.length(heads) - 1), F.lit(","), F.substring(listed, F.lit(2), F.length(listed)))).otherwise(heads)
    return rows.select("concept_id", F.concat(F.lit('{"resourceType":"Parameters","parameter":'), inner, F.lit("}")).alias("resource"))


PART = {"valueCode": "string", "valueCoding": "struct<system:string,code:string,version:string,display:string>", "valueUri": "string"}
