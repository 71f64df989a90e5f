"""Synthetic notes from profiles: deterministic, every profile in every language and variant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Each variant's age and days before the reference date.
AGES = (38, 49, 61, 66, 72, 78, 82, 59)
DAYS_AGO = (2, 7, 14, 21, 35, 60, 120, 240)
SETTINGS = ("primary-care", "outpatient", "inpatient", "emergency")


def synthetic_notes(spark: SparkSession, profiles: DataFrame, tenant: str, reference: str, languages: tuple[str, ...] = ("en", "es")) -> DataFrame:
    """profiles: profile_id, specialty, and one text column per language, text_<language>.

    One note for each profile, language and variant; ids depend on tenant, profile, language and
    variant only. Encounters are at noon UTC, so many days before the reference date.
    """
    variants = F.explode(F.array(*(F.struct(F.lit(k).alias("variant"), F.lit(a).alias("age"), F.lit(d).alias("days")) for k, (a, d) in enumerate(zip(AGES, DAYS_AGO, strict=True)))))
    by_language = F.explode(F.array(*(F.struct(F.lit(x).alias("language_code"), F.col(f"text_{x}").alias("text")) for x in languages)))
    rows = profiles.select("profile_id", "specialty", by_language.alias("l")).select("*", variants.alias("v"))
    noon = F.lit(f"{reference} 12:00:00").cast("timestamp_ntz")
    note_id = F.substring(F.sha2(F.concat_ws("|", F.lit(tenant), "profile_id", "l.language_code", F.col("v.variant").cast("string")).cast("binary"), 256), 1, 24)
    settings = F.array(*map(F.lit, SETTINGS))
    return rows.select(
        note_id.alias("note_id"), F.lit(tenant).alias("tenant_id"), "profile_id", "specialty", "l.language_code", "l.text", F.lit(True).alias("synthetic"), F.col("v.variant").alias("variant"), F.col("v.age").alias("age"),
        F.when(F.col("v.variant") % 2 == 0, "female").otherwise("male").alias("sex"), F.get(settings, F.col("v.variant") % len(SETTINGS)).alias("setting"), (noon - F.make_dt_interval(F.col("v.days"))).alias("occurred_at"),
    )
