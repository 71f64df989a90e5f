"""The queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import hard_negatives, line_dedup, media, mixing, ngram_join, packing, periodic_runs, quality, secret_ledger, suffix_dedup, token_orc, toxicity, warc
from .oracles import OP3_SQL, OP4_SQL, OP8_SQL, OP11_SQL, OP12_SQL


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_orc": lambda spark, d: token_orc.digest(_documents(spark, d)),
    "op2_secret_ledger": lambda spark, d: secret_ledger.digest(_documents(spark, d)),
    "op3_suffix_dedup": lambda spark, d: suffix_dedup.digest(_documents(spark, d)),
    "op4_ngram_join": lambda spark, d: ngram_join.digest(_documents(spark, d)),
    "op5_media_sniff": lambda spark, d: media.digest(_documents(spark, d)),
    "op6_source_mix": lambda spark, d: mixing.digest(_documents(spark, d)),
    "op7_line_dedup": lambda spark, d: line_dedup.digest(_documents(spark, d)),
    "op8_quality_divergence": lambda spark, d: quality.digest(_documents(spark, d)),
    "op9_warc_zstd": lambda spark, d: warc.digest(_pages(spark, d)),
    "op10_packing": lambda spark, d: packing.digest(_documents(spark, d)),
    "op11_hard_negatives": lambda spark, d: hard_negatives.digest(spark.read.parquet(f"{d}/embeddings.parquet")),
    "op12_periodic_runs": lambda spark, d: periodic_runs.digest(_documents(spark, d)),
    "op13_toxicity": lambda spark, d: toxicity.digest(_documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
}

OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, u.k, u.line, lower_ascii FROM (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
    LATERAL (SELECT unnest(parts) AS line, unnest(range(len(parts))) AS k) u,
    LATERAL (SELECT translate(regexp_replace(regexp_replace(u.line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii) t),
frequent AS (
  SELECT lower_ascii AS key, max(doc_id) AS keeper FROM lines WHERE length(lower_ascii) >= 40
  GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT l.doc_id, l.k, l.line, f.key IS NOT NULL AND l.doc_id <> f.keeper AS dropped
  FROM lines l LEFT JOIN frequent f ON l.lower_ascii = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(p.h, ((i // 4) * 5 + 1)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN f USING (h)
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, 2 * source_size AS cap, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
  sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s),
u AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing FROM w),
l AS (SELECT (budget - capped::DOUBLE) / sharing::DOUBLE AS level FROM u WHERE cap >= (budget - capped::DOUBLE) / sharing::DOUBLE * weight
  ORDER BY cap::DOUBLE / weight, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR cap <= level * weight THEN cap::DOUBLE ELSE level * weight END AS target FROM u LEFT JOIN l ON true),
r AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS expected,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS k,
  ('0x' || substr(md5('mix-1:' || CASE WHEN d.source IS NULL THEN 'null' ELSE '=' || d.source END), 1, 8))::BIGINT / 4294967296::DOUBLE AS off
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least(floor(k * expected + off) - floor((k - 1) * expected + off), 2) * size)::BIGINT AS taken FROM r
"""


def _spans_sql() -> str:
    """Positions of the k-th match: the lengths of all pieces and matches before it."""
    found = []
    for k, kind in enumerate(secret_ledger.KINDS):
        pattern, group, least = (secret_ledger.BASE_RULES | secret_ledger.EXTRA_RULES)[kind]
        pattern = ("(?i)" if kind == "assign" else "") + pattern.replace("'", "''")
        length = f"length(regexp_extract(m[i], '{pattern}', {group}))"
        found.append(f"SELECT doc_id, {k} AS k, '{kind}' AS kind, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS a, length(m[i]) AS n FROM (SELECT doc_id, p, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS m FROM d)) WHERE {length} >= {least}")
    return " UNION ALL ".join(found)


OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_spans_sql()}),
g AS (SELECT *, kind || ':' || a || ':' || (a + n) AS span FROM f)
SELECT d.doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY a, k) FILTER (WHERE k < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY a, k), '') AS spans
FROM d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op2_secret_ledger": OP2_SQL, "op3_suffix_dedup": OP3_SQL, "op4_ngram_join": OP4_SQL, "op8_quality_divergence": OP8_SQL, "op6_source_mix": OP6_SQL, "op7_line_dedup": OP7_SQL, "op9_warc_zstd": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_periodic_runs": OP12_SQL}
