"""Usage telemetry: records, daily counts, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import preview, query_hash


def records(events: DataFrame) -> DataFrame:
    """id, hash of the lower-cased query, preview."""
    return events.select("id", "event_type", query_hash(F.col("query_text")).alias("query_hash"), preview(F.col("query_text"), 8).alias("query_preview"))


MOST_IDS, PREVIEW = 200, 120
# Event types that explorers may send, and what empty fields become.
EXPLORER_EVENTS = ("explorer.search.submitted", "explorer.result.selected", "explorer.feedback.submitted", "explorer.workflow.handoff")


def usage_events(raw: DataFrame, release: str) -> DataFrame:
    """Events as they are kept: trimmed fields with their defaults, up to MOST_IDS distinct concept
    ids in order, hash and preview of the query, numbers or null. Events without a type go.

    raw: id, at, event_type, tenant_id, actor_id, source, status, release_id, language_code,
    concept_ids (array), query_text, result_count, duration_ms.
    """
    text = lambda c, other: F.coalesce(F.when(F.trim(c) != "", F.trim(c)), F.lit(other))
    plain = F.regexp_replace(F.trim("query_text"), "\\s+", " ")
    ids = F.array_distinct(F.filter(F.transform(F.coalesce("concept_ids", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != ""))
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)")
    return raw.where(F.coalesce(F.trim("event_type"), F.lit("")) != "").select(
        "id", "at", F.trim("event_type").alias("event_type"), text("tenant_id", "demo-minister").alias("tenant_id"), text("actor_id", "demo-user").alias("actor_id"), text("source", "api").alias("source"), text("status", "ok").alias("status"),
        text("release_id", release or "latest").alias("release_id"), text("language_code", None).alias("language_code"), F.slice(ids, 1, MOST_IDS).alias("concept_ids"),
        F.when(plain != "", preview(plain, PREVIEW)).alias("query_preview"), F.when(F.trim("query_text") != "", query_hash(F.col("query_text"))).alias("query_hash"), number("result_count").alias("result_count"), number("duration_ms").alias("duration_ms"),
    )


def allowed_events(events: DataFrame, types: tuple[str, ...]) -> DataFrame:
    return events.where(F.col("event_type").isin(*types))


def daily(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("actor_id").alias("actors"))


def sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """actor_id, session number, events, seconds from first to last."""
    order = Window.partitionBy("actor_id").orderBy("at", "id")
    seconds = F.unix_micros(F.col("at").cast("timestamp")) / 1e6
    new = F.when(seconds - F.lag(seconds).over(order) > gap_minutes * 60, 1).otherwise(0)
    numbered = events.withColumn("new", new).withColumn("session", F.sum("new").over(order))
    return numbered.groupBy("actor_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))
