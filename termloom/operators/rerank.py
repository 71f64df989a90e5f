"""Reranking of many queries' fused lists by an outside service: one call for each query's pool.

A task keeps CALLS_AT_ONCE calls open over an Arrow batch of queries. A call that fails keeps its
query's fused order; the other queries aren't touched.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CALLS_AT_ONCE, TRIES, MOST_POOL = 2, 2, 200
#: What the service gives for (query, texts): pairs of a text's place, from 0, and its relevance. It may leave texts out.
Service = Callable[[str, list[str]], list[tuple[int, float]]]


def service_text(term: str = "term", tag: str = "tag", fsn: str = "fsn"):
    """What a service reads of a concept: its term, its tag in brackets, its full name if that differs."""
    differs = F.when(F.col(fsn) != F.col(term), F.concat(F.lit("— "), F.col(fsn)))
    return F.concat_ws(" ", F.when(F.col(term) != "", F.col(term)), F.when(F.col(tag) != "", F.concat(F.lit("("), F.col(tag), F.lit(")"))), differs)


def _judged(service: Service, tries: int, at_once: int):
    def once(query: str, texts: list[str]) -> tuple[dict[int, float] | None, str | None]:
        error = None
        for _ in range(tries):
            try:
                found = {int(place): float(score) for place, score in service(query, list(texts))}
                if not all(0 <= place < len(texts) and math.isfinite(score) for place, score in found.items()):
                    raise ValueError("a place beyond the pool or a score that is no number")
                return found, None
            except Exception as failure:  # whatever a service raises is its answer
                error = f"{type(failure).__name__}: {failure}"[:200]
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as calls:
            for frame in batches:
                made = list(calls.map(once, frame["query"], frame["texts"]))
                rows = [(q, place, score, None) for q, (found, _) in zip(frame["query_id"], made) for place, score in (found or {}).items()]
                rows += [(q, None, None, error) for q, (found, error) in zip(frame["query_id"], made) if found is None]
                yield pd.DataFrame(rows, columns=["query_id", "place", "relevance", "error"])

    return run


def reranked(fused: DataFrame, service: Service, pool: int, limit: int, tries: int = TRIES, at_once: int = CALLS_AT_ONCE) -> DataFrame:
    """query_id, concept_id, place, fused_place, relevance, outcome (ok, unavailable): the first
    `limit` concepts of each query: those that the service judged by relevance, then the others in
    fused order. fused: query_id and query (neither null), concept_id, score, text; a concept once a query.

    Lists are cut to their first rows before they are grouped, so no group outgrows a pool. Scores
    tie by concept_id, relevance by fused place."""
    if not 0 < pool <= MOST_POOL:
        raise ValueError(f"a pool has 1 to {MOST_POOL} rows")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "concept_id")
    placed = fused.select("query_id", "query", "concept_id", "score", "text").withColumn("fused_place", F.row_number().over(order)).where(F.col("fused_place") <= max(pool, limit))
    asked = placed.where(F.col("fused_place") <= pool).groupBy("query_id").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct("fused_place", F.coalesce("text", F.lit("")).alias("text")))).alias("pool"))
    answers = asked.select("query_id", "query", F.col("pool.text").alias("texts")).mapInPandas(_judged(service, tries, at_once), f"query_id {fused.schema['query_id'].dataType.simpleString()}, place int, relevance double, error string")
    # one read of the answers, so that a service is not asked twice: a failed call's row has no place
    both = placed.select("query_id", "fused_place", "concept_id", F.lit(None).cast("double").alias("relevance"), F.lit(0).alias("failed"))
    told = answers.select("query_id", (F.col("place") + 1).alias("fused_place"), F.lit(None).cast("string").alias("concept_id"), "relevance", F.col("error").isNotNull().cast("int").alias("failed"))
    met = both.unionByName(told).groupBy("query_id", "fused_place").agg(F.max("concept_id").alias("concept_id"), F.max("relevance").alias("relevance"), F.max("failed").alias("failed"))
    whole = met.withColumn("failed", F.max("failed").over(Window.partitionBy("query_id"))).where("fused_place IS NOT NULL")
    last = Window.partitionBy("query_id").orderBy(F.col("relevance").desc_nulls_last(), "fused_place")
    outcome = F.when(F.col("failed") == 1, "unavailable").otherwise("ok")
    return whole.withColumn("place", F.row_number().over(last)).where(F.col("place") <= limit).select("query_id", "concept_id", "place", "fused_place", "relevance", outcome.alias("outcome"))


def shared_words(query: str, texts: list[str]) -> list[tuple[int, float]]:
    """Deterministic stand-in for a service: shared words over all words. It refuses a query that says so."""
    if "unavailable" in query:
        raise TimeoutError("no answer")
    words = lambda x: set(x.lower().split())
    return [(k, len(words(query) & words(x)) / max(1, len(words(query) | words(x)))) for k, x in enumerate(texts)]
