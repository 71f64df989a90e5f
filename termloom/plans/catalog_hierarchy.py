"""Queries on hierarchy, expression constraints and concept views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..sources.views import Tables, tables
from .ecl import EclSpace, scope
from .oracle_views import with_views

QUERIES, SQL = {}, {}
NATION, REGION, BRAND, TYPE, PART, SUPPLIER = "200003", "100001", "500013", "510002", "600007", "400003"


def query(name: str, sql: str | None = None, *views: str, **ctes: str):
    def register(f):
        QUERIES[name] = lambda spark, folder: f(tables(spark, folder))
        if sql:
            SQL[name] = with_views(sql, *views, **ctes)
        return f

    return register


def space(t: Tables) -> EclSpace:
    return EclSpace(t.concepts, t.lineage, t.supplied)


def _below(x: str, own: bool) -> str:
    sql = f"SELECT concept_id FROM closure JOIN concepts USING (concept_id) WHERE ancestor_id = '{x}' AND active"
    return f"({sql} UNION SELECT '{x}')" if own else f"({sql})"


EXPRESSIONS = {
    "ecl_descendants_or_self": (f"<< {NATION}", _below(NATION, True)),
    "ecl_descendants": (f"< {REGION}", _below(REGION, False)),
    "ecl_self": ("999999", "(SELECT '999999' AS concept_id)"),
    "ecl_and": (f"<< {BRAND} AND << {TYPE}", f"{_below(BRAND, True)} INTERSECT {_below(TYPE, True)}"),
    "ecl_or": (f"<< {NATION} OR << 200004", f"{_below(NATION, True)} UNION {_below('200004', True)}"),
    "ecl_minus": (f"<< {BRAND} MINUS << {TYPE}", f"{_below(BRAND, True)} EXCEPT {_below(TYPE, True)}"),
    "ecl_nested": (f"(<< {BRAND} OR << 500012) AND (<< {TYPE} MINUS {PART})", f"({_below(BRAND, True)} UNION {_below('500012', True)}) INTERSECT ({_below(TYPE, True)} EXCEPT SELECT '{PART}')"),
    "ecl_refinement": (f"<< 900000 : 700001 = << {BRAND}", f"SELECT DISTINCT source_id AS concept_id FROM attributes WHERE destination_id IN {_below(BRAND, True)}"),
    "ecl_refinement_and": (f"<< {REGION} : 700001 = << {BRAND}, 700001 = << {TYPE}", f"SELECT source_id AS concept_id FROM attributes WHERE destination_id IN {_below(BRAND, True)} INTERSECT SELECT source_id FROM attributes WHERE destination_id IN {_below(TYPE, True)} INTERSECT {_below(REGION, True)}"),
    "ecl_refinement_or": (f"<< {REGION} : 700001 = {PART} OR 700001 = 600009", f"SELECT DISTINCT source_id AS concept_id FROM attributes WHERE destination_id IN ('{PART}', '600009') INTERSECT {_below(REGION, True)}"),
}
for _name, (_text, _sql) in EXPRESSIONS.items():
    query(_name, f"SELECT concept_id FROM ({_sql})", "concepts", "closure", "attributes")(lambda t, text=_text: space(t).compile(text))


@query("ecl_enrich", f"SELECT i.concept_id, i.pos, c.name, c.tag, coalesce(c.active, false) AS known_active, c.concept_id IS NULL AS missing FROM ids i LEFT JOIN concepts c USING (concept_id)", "concepts", "closure", ids=f"SELECT concept_id, row_number() OVER (ORDER BY concept_id) - 1 AS pos FROM ({_below(NATION, True)} UNION SELECT '999999') ORDER BY pos LIMIT 400")
def ecl_enrich(t: Tables) -> DataFrame:
    """The first ids of an expansion in order, with labels; unknown ids keep their row."""
    ids = space(t).compile(f"<< {NATION} OR 999999").orderBy("concept_id").limit(400)
    placed = ids.withColumn("pos", F.row_number().over(Window.orderBy("concept_id")).cast("long") - 1)
    labels = t.concepts.withColumnRenamed("concept_id", "c")
    return placed.join(labels, F.col("concept_id") == F.col("c"), "left").select("concept_id", "pos", "name", "tag", F.coalesce("active", F.lit(False)).alias("known_active"), F.col("c").isNull().alias("missing"))


@query("scope_area_intersect", f"SELECT concept_id FROM ({_below('900000', True)} INTERSECT {_below(REGION, True)}) ORDER BY concept_id LIMIT 50", "concepts", "closure")
def scope_area_intersect(t: Tables) -> DataFrame:
    return scope(space(t).compile("<< 900000"), space(t).compile(f"<< {REGION}"), 50)


@query("closure_counts", "SELECT ancestor_id, count(*) AS n_below, max(depth)::INT AS deepest FROM closure GROUP BY ancestor_id", "closure")
def closure_counts(t: Tables) -> DataFrame:
    return t.closure.groupBy("ancestor_id").agg(F.count(F.lit(1)).alias("n_below"), F.max("depth").alias("deepest"))


@query("closure_depth", "SELECT depth::INT AS depth, count(*) AS pairs FROM closure GROUP BY depth", "closure")
def closure_depth(t: Tables) -> DataFrame:
    return t.closure.groupBy("depth").agg(F.count(F.lit(1)).alias("pairs"))


@query("graph_lookup_up", f"SELECT c.concept_id, c.name, (depth - 1)::INT AS depth FROM closure l JOIN concepts c ON c.concept_id = l.ancestor_id WHERE l.concept_id = '{PART}' AND c.active AND depth <= 2", "closure", "concepts")
def graph_lookup_up(t: Tables) -> DataFrame:
    return H.graph_lookup(t.closure, t.concepts, PART, up=True, max_depth=1, limit=100)


@query("graph_lookup_down", f"SELECT c.concept_id, c.name, (depth - 1)::INT AS depth FROM closure l JOIN concepts c USING (concept_id) WHERE l.ancestor_id = '{REGION}' AND c.active ORDER BY depth, concept_id LIMIT 100", "closure", "concepts")
def graph_lookup_down(t: Tables) -> DataFrame:
    return H.graph_lookup(t.closure, t.concepts, REGION, up=False, max_depth=2, limit=100)


@query("ancestor_walk", f"SELECT c.concept_id, c.name, c.active, (depth - 1)::INT AS depth FROM closure l JOIN concepts c ON c.concept_id = l.ancestor_id WHERE l.concept_id = '{SUPPLIER}' AND depth <= 3", "closure", "concepts")
def ancestor_walk(t: Tables) -> DataFrame:
    return H.ancestor_walk(t.edges, t.concepts, SUPPLIER, max_depth=2, limit=30)


@query(
    "primary_path",
    "SELECT concept_id, step::INT AS step FROM path",
    "edges",
    "concepts",
    pick="SELECT child, parent FROM (SELECT e.child, e.parent, row_number() OVER (PARTITION BY e.child ORDER BY (SELECT count(*) FROM edges x WHERE x.child = e.parent), lower(c.name), e.parent) AS k FROM edges e JOIN concepts c ON c.concept_id = e.parent) WHERE k = 1",
    path=f"SELECT '{PART}' AS concept_id, 0 AS step UNION ALL SELECT parent, step + 1 FROM path JOIN pick ON child = concept_id",
)
def primary_path(t: Tables) -> DataFrame:
    return H.primary_path(t.edges, t.concepts, t.closure, PART)


@query("subsumption_test", "SELECT p.a AS concept_id, p.b AS other_id, p.a = p.b OR EXISTS (SELECT 1 FROM closure c WHERE c.concept_id = p.a AND c.ancestor_id = p.b) AS subsumed FROM p", "closure", "parts", p=f"SELECT concept_id AS a, '{BRAND}' AS b FROM parts UNION ALL SELECT '{BRAND}', '{BRAND}'")
def subsumption_test(t: Tables) -> DataFrame:
    pairs = t.parts.select("concept_id", F.lit(BRAND).alias("other_id")).union(t.spark.range(1).select(F.lit(BRAND), F.lit(BRAND)))
    return H.subsumes(t.closure, pairs)


@query("scope_by_relation", f"SELECT relation, concept_id FROM (SELECT 'children' AS relation, child AS concept_id FROM edges WHERE parent = '{BRAND}' UNION ALL SELECT 'parents', parent FROM edges WHERE child = '{PART}' UNION ALL SELECT 'ancestors', ancestor_id FROM closure WHERE concept_id = '{PART}' UNION ALL SELECT 'self', '{PART}')", "closure")
def scope_by_relation(t: Tables) -> DataFrame:
    wanted = {"children": BRAND, "parents": PART, "ancestors": PART, "self": PART}
    parts = [H.by_relation(t.closure, t.edges, t.concepts, c, r, 10_000).select(F.lit(r).alias("relation"), "concept_id") for r, c in wanted.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("family_roots", f"SELECT concept_id FROM ids WHERE NOT EXISTS (SELECT 1 FROM closure c JOIN ids o ON o.concept_id = c.ancestor_id WHERE c.concept_id = ids.concept_id)", "closure", "parts", "types", ids=f"SELECT concept_id FROM parts UNION SELECT concept_id FROM types UNION SELECT '{BRAND}' UNION SELECT '{TYPE}'")
def family_roots(t: Tables) -> DataFrame:
    own = t.spark.createDataFrame([(BRAND,), (TYPE,)], "concept_id string")
    return H.family_roots(t.parts.select("concept_id").union(t.types.select("concept_id")).union(own).distinct(), t.closure)


@query("top_roots", "SELECT concept_id, string_agg(CASE ancestor_id WHEN '100000' THEN 'africa' WHEN '100001' THEN 'america' ELSE 'asia' END, ',' ORDER BY ancestor_id) AS area_tags FROM closure WHERE ancestor_id IN ('100000', '100001', '100002') GROUP BY concept_id", "closure")
def top_roots(t: Tables) -> DataFrame:
    return H.top_roots(t.closure, {"100000": "africa", "100001": "america", "100002": "asia"})


@query("branch_caps", "SELECT branch, concept_id, place::INT AS place FROM (SELECT *, row_number() OVER (ORDER BY branch, place) AS k FROM (SELECT ancestor_id AS branch, concept_id, row_number() OVER (PARTITION BY ancestor_id ORDER BY concept_id) AS place FROM closure WHERE ancestor_id IN ('100000', '100001', '100002')) WHERE place <= 30) WHERE k <= 70", "closure")
def branch_caps(t: Tables) -> DataFrame:
    return H.branch_caps(t.closure.where(F.col("ancestor_id").isin("100000", "100001", "100002")).select(F.col("ancestor_id").alias("branch"), "concept_id"), 30, 70)


@query(
    "concept_360",
    f"""SELECT c.concept_id, c.name, c.active, (SELECT string_agg(x.name, '|' ORDER BY lower(x.name), x.concept_id) FROM edges e JOIN concepts x ON x.concept_id = e.parent WHERE e.child = c.concept_id) AS parents,
      (SELECT count(*) FROM edges e WHERE e.parent = c.concept_id) AS n_children, (SELECT count(*) FROM attributes a WHERE a.source_id = c.concept_id OR a.destination_id = c.concept_id) AS n_attributes FROM concepts c WHERE tag = 'part'""",
    "concepts", "edges", "attributes",
)
def concept_360(t: Tables) -> DataFrame:
    """Each part with its parents' names in display order, and counts of children and relationships."""
    names = t.concepts.select(F.col("concept_id").alias("parent"), F.col("name").alias("parent_name"))
    key = F.struct(F.lower("parent_name"), "parent", "parent_name")
    parents = t.edges.join(names, "parent").groupBy("child").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["parent_name"]), "|").alias("parents"))
    children = t.edges.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    ends = t.attributes.select(F.explode(F.array("source_id", "destination_id")).alias("end")).groupBy("end").agg(F.count(F.lit(1)).alias("n_attributes"))
    own = t.concepts.where("tag = 'part'")
    joined = own.join(parents, own.concept_id == parents.child, "left").join(children, own.concept_id == children.parent, "left").join(ends, own.concept_id == ends.end, "left")
    return joined.select("concept_id", "name", "active", "parents", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_attributes", F.lit(0)).alias("n_attributes"))


@query(
    "relationship_groups",
    "SELECT category, type_id, count(*) AS n, count(DISTINCT source_id) AS n_sources FROM (SELECT 'defining' AS category, '116680003' AS type_id, child AS source_id FROM edges UNION ALL SELECT CASE WHEN regexp_matches('supplies', 'module|status|map|historical|replaced|same as|alternative|equivalent|association|refset') THEN 'other' ELSE 'attribute' END, type_id, source_id FROM attributes) GROUP BY ALL",
    "edges", "attributes",
)
def relationship_groups(t: Tables) -> DataFrame:
    from ..functions.text import relationship_category

    named = t.edges.select(F.lit("116680003").alias("type_id"), F.lit("Is a").alias("type_term"), F.col("child").alias("source_id")).union(t.attributes.select("type_id", F.lit("supplies"), "source_id"))
    return named.groupBy(relationship_category(F.col("type_id"), F.col("type_term")).alias("category"), "type_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("n_sources"))


_VIEWED = dict(
    ids="SELECT concept_id FROM concepts WHERE tag IN ('supplier', 'nation', 'part')",
    names="SELECT concept_id AS nid, name FROM concepts",
    pa="SELECT child AS concept_id, string_agg(name, '|' ORDER BY lower(name), parent) AS parents FROM (SELECT *, row_number() OVER (PARTITION BY child ORDER BY parent) AS k FROM edges) JOIN names ON nid = parent WHERE k <= 20 GROUP BY child",
    ch="SELECT parent AS concept_id, string_agg(name, '|' ORDER BY lower(name), child) AS children FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY child) AS k FROM edges) JOIN names ON nid = child WHERE k <= 8 GROUP BY parent",
    rl="SELECT child AS concept_id, '116680003' AS type_id, parent AS to_id FROM edges UNION ALL SELECT source_id, type_id, destination_id FROM attributes",
    rk="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY type_id, to_id) AS k FROM rl) WHERE k <= 40",
    rp="SELECT concept_id, count(*) AS n, list(to_id ORDER BY (type_id <> '116680003'), CASE WHEN type_id = '116680003' THEN 'Is a' ELSE type_id END, coalesce(name, to_id), to_id) AS l FROM rk LEFT JOIN names ON nid = to_id GROUP BY concept_id",
)


@query("concept_view", "SELECT i.concept_id, coalesce(parents, '') AS parents, coalesce(children, '') AS children, coalesce(n, 0) AS relationship_count, array_to_string(l[1:25], ',') AS preview FROM ids i LEFT JOIN pa USING (concept_id) LEFT JOIN ch USING (concept_id) LEFT JOIN rp USING (concept_id)", "concepts", "edges", "attributes", **_VIEWED)
def concept_view(t: Tables) -> DataFrame:
    """Suppliers, nations and parts as a browser shows them: capped parents, children, relationships."""
    ids = t.concepts.where("tag IN ('supplier', 'nation', 'part')").select("concept_id")
    seen = H.concept_view(ids, t.concepts, t.edges, t.attributes, child_limit=8)
    return seen.select("concept_id", F.array_join("parents", "|").alias("parents"), F.array_join("children", "|").alias("children"), "relationship_count", F.array_join("relationships.to_id", ",").alias("preview"))


@query("concept_summaries", "SELECT i.concept_id, coalesce(c.name, i.concept_id) AS term, c.tag, c.active, array_to_string(list_concat([i.concept_id], coalesce(u.up, [])), ',') AS ancestors FROM (SELECT concept_id FROM concepts WHERE tag = 'supplier' UNION SELECT '999999') i LEFT JOIN concepts c USING (concept_id) LEFT JOIN (SELECT concept_id, list(ancestor_id ORDER BY ancestor_id) AS up FROM closure GROUP BY concept_id) u USING (concept_id)", "concepts", "closure")
def concept_summaries(t: Tables) -> DataFrame:
    ids = t.concepts.where("tag = 'supplier'").select("concept_id").union(t.spark.createDataFrame([("999999",)], "concept_id string"))
    labels = t.concepts.select("concept_id", F.col("name").alias("label"))
    return H.concept_summaries(ids, t.concepts, labels, t.closure).select("concept_id", "term", "tag", "active", F.array_join("ancestor_ids", ",").alias("ancestors"))


@query("graph_neighbours", f"SELECT n.concept_id, array_to_string((SELECT list(parent ORDER BY parent) FROM edges e WHERE e.child = n.concept_id)[1:24], ',') AS parents, coalesce(array_to_string((SELECT list(child ORDER BY child) FROM edges e WHERE e.parent = n.concept_id)[1:24], ','), '') AS children FROM (SELECT concept_id FROM closure WHERE ancestor_id = '{REGION}' AND depth <= 1) n", "edges", "closure")
def graph_neighbours(t: Tables) -> DataFrame:
    nodes = t.closure.where((F.col("ancestor_id") == REGION) & (F.col("depth") <= 1)).select("concept_id")
    return H.with_neighbours(nodes, t.edges).select("concept_id", F.array_join("parent_ids", ",").alias("parents"), F.array_join("child_ids", ",").alias("children"))


@query("unknown_ids", "SELECT i.concept_id FROM (SELECT concept_id FROM concepts UNION SELECT '999999') i LEFT JOIN concepts c ON c.concept_id = i.concept_id AND c.active WHERE c.concept_id IS NULL", "concepts")
def unknown_ids(t: Tables) -> DataFrame:
    ids = t.concepts.select("concept_id").union(t.spark.createDataFrame([("999999",)], "concept_id string"))
    return H.unknown_ids(ids, t.concepts)
