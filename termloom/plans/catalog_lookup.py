"""Queries on keyed lookups, counts from footers, reranking by a service and order by locale."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import locale_order
from ..operators import rerank as K
from ..sources import lookups as L
from ..sources.results import Results
from ..sources.views import RELEASE_NEW, Tables, tables
from .oracle_views import with_views

QUERIES, SQL = {}, {}


def query(name: str, sql: str, *views: str, **ctes: str):
    def register(f):
        QUERIES[name] = lambda spark, folder: f(tables(spark, folder))
        SQL[name] = with_views(sql, *views, **ctes)
        return f

    return register


_RELEASES = dict(rows="SELECT * FROM release_old UNION ALL BY NAME SELECT * FROM release_new")
#: More ids than become literals, and fewer.
_MANY = "SELECT (300000 + o_custkey)::VARCHAR FROM orders WHERE o_orderkey % 3 = 0"
FEW_IDS = [str(300000 + k) for k in range(1, 100, 7)] + ["400001", "999999"]


@query("release_lookup", f"SELECT concept_id, release_id, active, module_id FROM rows WHERE release_id = '{RELEASE_NEW}' AND concept_id IN ({_MANY})", "release_old", "release_new", **_RELEASES)
def release_lookup(t: Tables) -> DataFrame:
    """The newest release's rows of all concepts that some notes name: a semi join over one release's folder."""
    named = t.table("orders").where("o_orderkey % 3 = 0").select((F.lit(300000) + F.col("o_custkey")).cast("string").alias("concept_id"))
    releases = t.keyed_releases.select("release_id").distinct().withColumn("newest", F.col("release_id") == RELEASE_NEW)
    return L.looked_up(L.in_release(t.keyed_releases, releases, "newest"), "concept_id", named).select("concept_id", "release_id", "active", "module_id")


@query("release_lookup_short", f"SELECT concept_id, release_id, active, module_id FROM rows WHERE concept_id IN ({', '.join(repr(x) for x in FEW_IDS)})", "release_old", "release_new", **_RELEASES)
def release_lookup_short(t: Tables) -> DataFrame:
    """A short list's rows in all releases: literals that reach the files' statistics and Bloom filters."""
    return L.looked_up(t.keyed_releases, "concept_id", FEW_IDS).select("concept_id", "release_id", "active", "module_id")


_COUNTED = ("nation", "customer", "supplier", "part", "orders", "lineitem")


@query("estimated_counts", " UNION ALL ".join(f"SELECT '{x}' AS name, count(*) AS n FROM {x}" for x in _COUNTED))
def estimated_counts(t: Tables) -> DataFrame:
    return L.estimated_counts(t.spark, {x: f"{t.folder}/{x}.parquet" for x in _COUNTED})


# a query for each kind of part: its name says what is looked for; PROMO's call fails
_POOL, _LIMIT = 6, 10
_ASKED = f"""SELECT t.p_type AS query_id, 'large polished ' || lower(t.p_type) || CASE t.p_type WHEN 'PROMO' THEN ' unavailable' ELSE '' END AS query, p.concept_id, p_size::DOUBLE AS score, name || ' (part)' AS text FROM parts p JOIN types t ON t.concept_id = p.type_id"""
_WORDS = "list_distinct(string_split(lower({}), ' '))"
_SHARE = f"len(list_intersect({_WORDS.format('query')}, {_WORDS.format('text')})) / len(list_distinct(list_concat({_WORDS.format('query')}, {_WORDS.format('text')})))"


@query(
    "rerank_service",
    f"""SELECT query_id, concept_id, place, fused_place, round(relevance, 6) AS relevance, CASE WHEN query_id = 'PROMO' THEN 'unavailable' ELSE 'ok' END AS outcome
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC NULLS LAST, fused_place) AS place FROM (SELECT *, CASE WHEN fused_place <= {_POOL} AND query_id <> 'PROMO' THEN {_SHARE} END AS relevance
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, concept_id) AS fused_place FROM asked) WHERE fused_place <= {_LIMIT})) WHERE place <= {_LIMIT}""",
    "parts",
    "types",
    asked=_ASKED,
)
def rerank_service(t: Tables) -> DataFrame:
    """Many queries at once: the pools are judged by a service, one call each; one call fails and keeps its order."""
    parts = t.parts.join(t.types.withColumnRenamed("concept_id", "type_id"), "type_id")
    words = F.concat(F.lit("large polished "), F.lower("p_type"), F.when(F.col("p_type") == "PROMO", " unavailable").otherwise(""))
    text = K.service_text("name", "tag", "fsn")
    fused = parts.withColumns({"tag": F.lit("part"), "fsn": F.col("name")}).select(F.col("p_type").alias("query_id"), words.alias("query"), "concept_id", F.col("p_size").cast("double").alias("score"), text.alias("text"))
    return K.reranked(fused, K.shared_words, _POOL, _LIMIT).withColumn("relevance", F.round("relevance", 6))


# names in Spanish spelling and mixed case, so that their order isn't that of the code points
_SPELLED = dict(spelled="SELECT concept_id, CASE WHEN concept_id::BIGINT % 2 = 0 THEN 'en' ELSE 'es' END AS language_code, CASE concept_id::BIGINT % 3 WHEN 0 THEN translate(name, 'aeiou', 'áéíóú') WHEN 1 THEN translate(name, 'nl', 'ñl') ELSE upper(name) END AS term FROM concepts")


@query(
    "terms_in_locale_order",
    """SELECT language_code, concept_id, term, row_number() OVER (ORDER BY term COLLATE es, concept_id) AS place FROM spelled WHERE language_code = 'es' QUALIFY place <= 500
    UNION ALL SELECT language_code, concept_id, term, row_number() OVER (ORDER BY term COLLATE en, concept_id) AS place FROM spelled WHERE language_code = 'en' QUALIFY place <= 500""",
    "concepts",
    **_SPELLED,
)
def terms_in_locale_order(t: Tables) -> DataFrame:
    """The first 500 terms of each language in its own alphabetical order."""
    number = F.col("concept_id").cast("long")
    term = F.when(number % 3 == 0, F.translate("name", "aeiou", "áéíóú")).when(number % 3 == 1, F.translate("name", "nl", "ñl")).otherwise(F.upper("name"))
    spelled = t.concepts.select("concept_id", F.when(number % 2 == 0, "en").otherwise("es").alias("language_code"), term.alias("term"))
    order = Window.partitionBy("language_code").orderBy(*locale_order(F.col("term"), F.col("language_code")), "concept_id")
    return spelled.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 500")


@query("kept_results", "SELECT tag, count(*) AS n, min(concept_id) AS least FROM concepts WHERE active GROUP BY tag", "concepts")
def kept_results(t: Tables) -> DataFrame:
    """Asked twice; the second answer is the first one's files."""
    kept = Results(t.spark)
    ask = lambda: t.concepts.where("active").groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min("concept_id").alias("least"))
    kept.of({"query": "tags", "folder": t.folder}, ask)
    return kept.of({"folder": t.folder, "query": "tags"}, ask)
