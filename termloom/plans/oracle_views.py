"""The views of sources.views as DuckDB common table expressions, written independently."""

from __future__ import annotations

VIEWS = {
    "types": ([], "SELECT p_type, (510000 + row_number() OVER (ORDER BY p_type))::VARCHAR AS concept_id FROM (SELECT DISTINCT p_type FROM part)"),
    "parts": (["types"], "SELECT (600000 + p_partkey)::VARCHAR AS concept_id, (500000 + replace(p_brand, 'Brand#', '')::INT)::VARCHAR AS brand_id, t.concept_id AS type_id, p_name AS name, p_size, p_partkey, p_brand FROM part JOIN types t USING (p_type)"),
    "concepts": (
        ["types", "parts"],
        """SELECT '900000' AS concept_id, 'Everything' AS name, 'root' AS tag, true AS active
      UNION ALL SELECT (100000 + r_regionkey)::VARCHAR, r_name, 'region', true FROM region
      UNION ALL SELECT (200000 + n_nationkey)::VARCHAR, n_name, 'nation', true FROM nation
      UNION ALL SELECT (300000 + c_custkey)::VARCHAR, c_name, 'customer', c_acctbal >= 0 FROM customer
      UNION ALL SELECT (400000 + s_suppkey)::VARCHAR, s_name, 'supplier', true FROM supplier
      UNION ALL SELECT DISTINCT brand_id, p_brand, 'brand', true FROM parts
      UNION ALL SELECT concept_id, p_type, 'type', true FROM types
      UNION ALL SELECT concept_id, name, 'part', true FROM parts""",
    ),
    "edges": (
        ["types", "parts"],
        """SELECT (100000 + r_regionkey)::VARCHAR AS child, '900000' AS parent FROM region
      UNION ALL SELECT (200000 + n_nationkey)::VARCHAR, (100000 + n_regionkey)::VARCHAR FROM nation
      UNION ALL SELECT (300000 + c_custkey)::VARCHAR, (200000 + c_nationkey)::VARCHAR FROM customer
      UNION ALL SELECT (400000 + s_suppkey)::VARCHAR, (200000 + s_nationkey)::VARCHAR FROM supplier
      UNION ALL SELECT DISTINCT brand_id, '900000' FROM parts
      UNION ALL SELECT concept_id, '900000' FROM types
      UNION ALL SELECT concept_id, brand_id FROM parts
      UNION ALL SELECT concept_id, type_id FROM parts""",
    ),
    "ways": (["edges"], "SELECT child AS concept_id, parent AS ancestor_id, 1 AS depth FROM edges UNION ALL SELECT w.concept_id, e.parent, w.depth + 1 FROM ways w JOIN edges e ON w.ancestor_id = e.child"),
    "closure": (["ways"], "SELECT concept_id, ancestor_id, min(depth) AS depth FROM ways GROUP BY ALL"),
    "attributes": ([], "SELECT DISTINCT (400000 + l_suppkey)::VARCHAR AS source_id, '700001' AS type_id, (600000 + l_partkey)::VARCHAR AS destination_id FROM lineitem"),
    "descriptions": (
        ["concepts"],
        """SELECT concept_id, concept_id || '-' || kind AS description_id, CASE kind WHEN 'fsn' THEN name || ' (' || tag || ')' ELSE name END AS term, kind,
      CASE WHEN concept_id::BIGINT % 2 = 0 THEN 'en' ELSE 'es' END AS language_code, tag, active AS concept_active
      FROM concepts, (VALUES ('synonym'), ('fsn')) k(kind)""",
    ),
    "names": (
        ["concepts"],
        """SELECT concept_id, concept_id || '-' || n AS description_id, CASE n WHEN 1 THEN name WHEN 2 THEN name || ' (' || tag || ')' WHEN 3 THEN turned || ' item' WHEN 4 THEN turned ELSE 'A ' || tag || ' named ' || name END AS term,
      CASE n WHEN 2 THEN 'fsn' WHEN 5 THEN 'definition' ELSE 'synonym' END AS kind, CASE WHEN concept_id::BIGINT % 2 = 0 THEN 'en' ELSE 'es' END AS language_code, tag, active AS concept_active, '20240701' AS release_id
      FROM (SELECT *, array_to_string(list_reverse(string_split(name, ' ')), ' ') AS turned FROM concepts), (VALUES (1), (2), (3), (4), (5)) k(n)""",
    ),
    "root_areas": (["edges", "closure"], "SELECT concept_id, list(root ORDER BY root) AS top_roots FROM (SELECT child AS concept_id, child AS root FROM edges WHERE parent = '900000' UNION SELECT c.concept_id, c.ancestor_id FROM closure c JOIN edges e ON e.child = c.ancestor_id AND e.parent = '900000') GROUP BY concept_id"),
    "placed": (
        ["names"],
        """SELECT *, trim(regexp_replace(lower(strip_accents(term)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS normalized,
      row_number() OVER (PARTITION BY concept_id ORDER BY CASE kind WHEN 'synonym' THEN 0 WHEN 'fsn' THEN 1 ELSE 2 END, length(term), term, description_id) AS place FROM names""",
    ),
    "shown": (
        ["placed"],
        "SELECT concept_id, min_by(term, place) AS display_term, min_by(normalized, place) AS display, min_by(normalized, place) FILTER (WHERE kind = 'fsn') AS fsn, string_agg(term, ' ') FILTER (WHERE kind = 'definition') AS definition FROM placed GROUP BY concept_id",
    ),
    "meant": (
        ["placed", "shown"],
        "SELECT concept_id, list(normalized ORDER BY place) AS synonyms FROM (SELECT concept_id, normalized, min(place) AS place FROM placed JOIN shown USING (concept_id) WHERE kind = 'synonym' AND normalized <> display AND normalized <> fsn GROUP BY ALL) GROUP BY concept_id",
    ),
    "terms": (
        ["placed", "shown", "meant", "root_areas"],
        """SELECT p.*, display_term, display, fsn, definition, coalesce(synonyms, []::VARCHAR[]) AS synonyms, coalesce(top_roots, []::VARCHAR[]) AS top_roots, place = 1 AS is_preferred,
      CASE WHEN place = 1 THEN 30 ELSE 0 END + CASE kind WHEN 'synonym' THEN 20 ELSE 10 END + CASE WHEN length(term) <= 28 THEN 4 ELSE 0 END AS term_rank
      FROM placed p JOIN shown USING (concept_id) LEFT JOIN meant USING (concept_id) LEFT JOIN root_areas USING (concept_id) WHERE kind <> 'definition'""",
    ),
    "codings": (
        ["parts"],
        """SELECT l_orderkey AS note_id, p.concept_id, p.brand_id, p.type_id,
      CASE l_returnflag WHEN 'A' THEN 'absent' WHEN 'N' THEN 'present' ELSE 'suspected' END AS assertion,
      CASE l_linestatus WHEN 'O' THEN 'patient' ELSE 'family' END AS subject, CASE WHEN l_discount < 0.09::DOUBLE THEN 'accepted' ELSE 'review' END AS status,
      CASE WHEN l_linenumber % 2 = 0 THEN 'historical' ELSE 'current' END AS temporality,
      CASE l_linenumber % 3 WHEN 0 THEN 'condition' WHEN 1 THEN 'procedure' ELSE 'medication' END AS kind, l_linenumber AS line, l_quantity, l_shipdate
      FROM lineitem JOIN parts p ON l_partkey = p.p_partkey""",
    ),
    "notes": (
        [],
        """SELECT o_orderkey AS note_id, 'demo' AS tenant_id, CASE WHEN o_orderkey % 2 = 0 THEN 'en' ELSE 'es' END AS language_code, o_orderkey % 2 = 0 AS synthetic,
      20 + o_custkey % 70 AS age, CASE o_custkey % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' ELSE 'other' END AS sex,
      CASE left(o_orderpriority, 1) WHEN '1' THEN 'emergency' WHEN '2' THEN 'inpatient' WHEN '3' THEN 'outpatient' ELSE 'primary-care' END AS setting, o_orderdate AS occurred_at FROM orders""",
    ),
    "release_old": ([], "SELECT (300000 + c_custkey)::VARCHAR AS concept_id, c_acctbal >= 0 AS active, 'primitive' AS definition_status, 'core' AS module_id, '20230101' AS effective_time, '20240101' AS release_id FROM customer"),
    "release_new": (
        [],
        """SELECT (300000 + c_custkey)::VARCHAR AS concept_id, CASE WHEN c_custkey % 7 = 0 THEN NOT (c_acctbal >= 0) ELSE c_acctbal >= 0 END AS active, 'primitive' AS definition_status,
      CASE WHEN c_custkey % 11 = 0 THEN 'extension' ELSE 'core' END AS module_id, '20230101' AS effective_time, '20240701' AS release_id FROM customer WHERE c_custkey % 10 <> 0
      UNION ALL SELECT (400000 + s_suppkey)::VARCHAR, true, 'primitive', 'core', '20240601', '20240701' FROM supplier""",
    ),
    "mappings": (
        ["parts"],
        """SELECT concept_id, '447562003' AS refset_id, 'brand-codes' AS target_system, p_brand AS map_target, p_size % 3 + 1 AS map_group, p_size % 5 + 1 AS map_priority,
      CASE WHEN p_partkey % 2 = 0 THEN 'TRUE' ELSE 'IFA 248152002 | Female |' END AS map_rule, p_size % 4 <> 0 AS active FROM parts""",
    ),
    "telemetry": ([], "SELECT event_id AS id, ts AS \"at\", user_id AS actor_id, event_type, value AS duration_ms, props AS query_text FROM events"),
}


def with_views(query: str, *names: str, **more: str) -> str:
    """query after the named views, those they need, and any given as keywords; one that begins with
    MATERIALIZED is worked out once."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in VIEWS[name][0]:
            need(x)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    ctes = [f"{x} AS ({VIEWS[x][1]})" for x in order] + [f"{k} AS MATERIALIZED ({v.removeprefix('MATERIALIZED ')})" if v.startswith("MATERIALIZED ") else f"{k} AS ({v})" for k, v in more.items()]
    return f"WITH RECURSIVE {', '.join(ctes)} {query}" if ctes else query
