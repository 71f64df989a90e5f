"""Queries on notes and their nested codings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.views import Tables, tables
from .broad_scope import broad_scope as families
from .cohort import Filters, Group, Leaf, Plan, cohort, explain_matches, parse_command
from .oracle_views import with_views

QUERIES, SQL = {}, {}
BRAND, TYPE, PART, OTHER = "500013", "510002", "600007", "500021"
NOW, FROZEN = datetime(1998, 8, 2, 12), datetime(1996, 1, 1, 12)


def query(name: str, sql: str | None = None, *views: str, **ctes: str):
    def register(f):
        QUERIES[name] = lambda spark, folder: f(tables(spark, folder))
        if sql:
            SQL[name] = with_views(sql, *views, **ctes)
        return f

    return register


def _has(concept: str, assertion: str = "present", subject: str = "patient", below: bool = True, temporality: str = "") -> str:
    hit = f"'{concept}' IN (c.concept_id, c.brand_id, c.type_id, '900000')" if below else f"c.concept_id = '{concept}'"
    when = f" AND c.temporality = '{temporality}'" if temporality else ""
    return f"EXISTS (SELECT 1 FROM codings c WHERE c.note_id = n.note_id AND {hit} AND c.assertion = '{assertion}' AND c.subject = '{subject}' AND c.status = 'accepted'{when})"


def leaf(k: int, exclude: bool = False, **values) -> Leaf:
    return Leaf(f"phrase {k}", exclude=exclude, name=f"c{k}", **values)


_WINDOW = "occurred_at BETWEEN TIMESTAMP '{0}' - INTERVAL 90 DAY AND TIMESTAMP '{0}'"
COHORTS = {
    "cohort_descendants": (Plan(leaf(1)), {"c1": [BRAND]}, {}, _has(BRAND)),
    "cohort_exact": (Plan(leaf(1)), {"c1": [PART]}, {"descendants": False}, _has(PART, below=False)),
    "cohort_excluded": (Plan(Group("all", (leaf(1), leaf(2, exclude=True)))), {"c1": [BRAND], "c2": [TYPE]}, {}, f"{_has(BRAND)} AND NOT {_has(TYPE)}"),
    "cohort_and_or": (Plan(Group("any", (Group("all", (leaf(1), leaf(2))), leaf(3)))), {"c1": [BRAND], "c2": [TYPE], "c3": [PART]}, {}, f"({_has(BRAND)} AND {_has(TYPE)}) OR {_has(PART)}"),
    "cohort_nested": (Plan(Group("all", (leaf(1), Group("any", (leaf(2), leaf(3, assertion="suspected")), exclude=True)))), {"c1": [TYPE], "c2": [BRAND], "c3": [OTHER]}, {}, f"{_has(TYPE)} AND NOT ({_has(BRAND)} OR {_has(OTHER, 'suspected')})"),
    "cohort_absent": (Plan(leaf(1, assertion="absent", subject="family")), {"c1": [BRAND]}, {}, _has(BRAND, "absent", "family")),
    "cohort_family": (Plan(leaf(1, assertion="suspected", subject="family")), {"c1": [BRAND]}, {}, _has(BRAND, "suspected", "family")),
    "cohort_historical": (Plan(leaf(1, assertion="historical")), {"c1": [TYPE]}, {}, _has(TYPE, temporality="historical")),
    "cohort_demographics": (Plan(leaf(1), Filters(40, 70, None, "female", "outpatient")), {"c1": ["900000"]}, {}, f"{_has('900000')} AND age BETWEEN 40 AND 70 AND sex = 'female' AND setting = 'outpatient'"),
    "cohort_recent": (Plan(leaf(1), Filters(since_days=90)), {"c1": [TYPE]}, {}, f"{_has(TYPE)} AND {_WINDOW.format(NOW)}"),
    "cohort_recent_frozen": (Plan(None, Filters(since_days=90)), {}, {"frozen": FROZEN}, f"(synthetic AND {_WINDOW.format(FROZEN)}) OR (NOT synthetic AND {_WINDOW.format(NOW)})"),
}
for _name, (_plan, _ids, _more, _sql) in COHORTS.items():
    query(_name, f"SELECT note_id FROM notes n WHERE {_sql}", "notes", "codings")(lambda t, p=_plan, i=_ids, m=_more: t.notes.where(cohort(p, i, NOW, **m)).select("note_id"))


@query("cohort_counts_sample", f"SELECT note_id, age, sex, (SELECT count(*) FROM notes n WHERE {_has(TYPE)}) AS n_match, (SELECT count(*) FROM notes) AS n_all FROM notes n WHERE {_has(TYPE)} ORDER BY occurred_at DESC, note_id LIMIT 25", "notes", "codings")
def cohort_counts_sample(t: Tables) -> DataFrame:
    """Counts in one pass, and the 25 newest matching notes."""
    hit = t.notes.withColumn("hit", cohort(Plan(leaf(1)), {"c1": [TYPE]}, NOW))
    newest = hit.where("hit").orderBy(F.col("occurred_at").desc(), "note_id").limit(25)
    return newest.select("note_id", "age", "sex", hit.agg(F.count_if("hit")).scalar().alias("n_match"), hit.agg(F.count(F.lit(1))).scalar().alias("n_all"))


@query("cohort_stats", "SELECT count(*) AS total_notes, count(*) FILTER (WHERE synthetic) AS synthetic_notes, count(*) FILTER (WHERE language_code = 'en') AS n_en, count(*) FILTER (WHERE language_code = 'es') AS n_es, max(CASE WHEN synthetic THEN occurred_at END) AS demo_latest FROM notes", "notes")
def cohort_stats(t: Tables) -> DataFrame:
    return t.notes.agg(F.count(F.lit(1)).alias("total_notes"), F.count_if("synthetic").alias("synthetic_notes"), F.count_if(F.col("language_code") == "en").alias("n_en"), F.count_if(F.col("language_code") == "es").alias("n_es"), F.max(F.when(F.col("synthetic"), F.col("occurred_at"))).alias("demo_latest"))


@query("cohort_false_positive_negative", f"SELECT 'positive' AS kind, note_id FROM notes n WHERE {_has(BRAND)} AND NOT {_has(BRAND, below=False)} UNION ALL SELECT 'negative', note_id FROM notes n WHERE false", "notes", "codings")
def cohort_false_positive_negative(t: Tables) -> DataFrame:
    """What including descendants adds to, or takes from, an exact match."""
    ids = {"c1": [BRAND]}
    # both conditions are asked of each note in one pass
    asked = t.notes.select("note_id", cohort(Plan(leaf(1)), ids, NOW).alias("wide"), cohort(Plan(leaf(1)), ids, NOW, descendants=False).alias("exact"))
    return asked.where("wide <> exact").select(F.when(F.col("wide"), "positive").otherwise("negative").alias("kind"), "note_id")


@query("match_explanation", "SELECT note_id, clause, string_agg(DISTINCT concept_id, ',' ORDER BY concept_id) AS concepts FROM (" + " UNION ALL ".join(f"SELECT note_id, '{k}' AS clause, concept_id FROM codings WHERE '{c}' IN (brand_id, type_id) AND assertion = 'present' AND subject = 'patient' AND status = 'accepted'" for k, c in (("c1", BRAND), ("c2", TYPE))) + ") GROUP BY note_id, clause", "codings")
def match_explanation(t: Tables) -> DataFrame:
    found = explain_matches(Plan(Group("any", (leaf(1), leaf(2)))), {"c1": [BRAND], "c2": [TYPE]})
    clauses = F.explode(F.array(*(F.struct(F.lit(k).alias("clause"), F.array_sort(F.array_distinct(F.transform(v, lambda c: c["concept_id"]))).alias("ids")) for k, v in found.items())))
    return t.notes.select("note_id", clauses.alias("m")).where(F.size("m.ids") > 0).select("note_id", "m.clause", F.array_join("m.ids", ",").alias("concepts"))


@query("subsumption_cohort_count", "SELECT ancestor_id, count(DISTINCT note_id) AS n_notes FROM (SELECT note_id, unnest([brand_id, type_id]) AS ancestor_id FROM codings WHERE assertion = 'present' AND subject = 'patient' AND status = 'accepted') GROUP BY ancestor_id", "codings")
def subsumption_cohort_count(t: Tables) -> DataFrame:
    """Notes under every brand and type at once, each note counted once per concept."""
    kept = F.filter("codings", lambda c: (c["assertion"] == "present") & (c["subject"] == "patient") & (c["status"] == "accepted"))
    above = F.array_distinct(F.flatten(F.transform(kept, lambda c: F.slice(c["ancestor_ids"], 2, 2))))
    return t.notes.select(F.explode(above).alias("ancestor_id")).groupBy("ancestor_id").agg(F.count(F.lit(1)).alias("n_notes"))


_QUESTION = "Find outpatient notes from the last 900 days for women over 40 with (alpha or a history of beta) and gamma but without suspected delta"
_ASKED = dict(c1=[BRAND], c2=[TYPE], c3=["900000"], c4=[OTHER])


@query("cohort_from_question", f"SELECT note_id FROM notes n WHERE setting = 'outpatient' AND sex = 'female' AND age >= 41 AND occurred_at BETWEEN TIMESTAMP '{NOW}' - INTERVAL 900 DAY AND TIMESTAMP '{NOW}' AND ({_has(BRAND)} OR {_has(TYPE, temporality='historical')}) AND {_has('900000')} AND NOT {_has(OTHER, 'suspected')}", "notes", "codings")
def cohort_from_question(t: Tables) -> DataFrame:
    """A question as it is typed, with each condition's concepts."""
    return t.notes.where(cohort(parse_command(_QUESTION), _ASKED, NOW)).select("note_id")


@query("cohort_from_spanish_question", f"SELECT note_id FROM notes n WHERE setting = 'emergency' AND sex = 'male' AND age BETWEEN 30 AND 60 AND ({_has(BRAND)} OR {_has(TYPE, 'absent')}) AND NOT {_has(OTHER)}", "notes", "codings")
def cohort_from_spanish_question(t: Tables) -> DataFrame:
    plan = parse_command("Busca notas de urgencias de hombres de 30 a 60 años con (alfa o ausencia documentada de beta) sin gamma confirmada")
    return t.notes.where(cohort(plan, {"c1": [BRAND], "c2": [TYPE], "c3": [OTHER]}, NOW)).select("note_id")


# for each part a phrase and three candidates: the part, its type, its brand
_CANDIDATES = dict(
    k="""SELECT concept_id AS id, p_partkey, p_size, name, p_brand, type_id, brand_id, 'q' || concept_id || ' ' || CASE p_partkey % 3 WHEN 0 THEN name WHEN 1 THEN split_part(name, ' ', 2) || ' of ' || split_part(name, ' ', 1) ELSE 'nothing alike' END AS asked FROM parts""",
    c="""SELECT id, asked AS phrase, 1 AS pos, id AS cid, 'q' || id || ' ' || name AS d, 'disorder' AS tag, [brand_id, type_id] AS up, p_size / 50.0::DOUBLE AS s, p_partkey, p_size FROM k
  UNION ALL SELECT id, asked, 2, type_id, 'q' || id || ' ' || split_part(name, ' ', 2) || ' kind', 'hallazgo', [], (p_size + 4) / 50.0::DOUBLE, p_partkey, p_size FROM k UNION ALL SELECT id, asked, 3, brand_id, 'q' || id || ' ' || name || ' made by ' || p_brand, 'substance', [], (p_size + 3) / 50.0::DOUBLE, p_partkey, p_size FROM k""",
    v="SELECT * EXCLUDE (s), CASE WHEN p_partkey % 5 <> 0 THEN s END AS s, p_partkey % 3 = 0 AND pos = 1 AS anchor, p_partkey % 3 < 2 AND pos <> 2 AS supported FROM c",
    w="SELECT *, max(s) OVER (PARTITION BY id) AS best, bool_or(anchor) OVER (PARTITION BY id) AS anchored, row_number() OVER (PARTITION BY id, supported ORDER BY pos) AS nth FROM v",
    m="SELECT * FROM w WHERE CASE WHEN anchored THEN anchor WHEN best IS NOT NULL THEN s >= greatest(0.45, best - 0.12::DOUBLE) ELSE supported AND nth <= 3 END",
    x="SELECT *, min(CASE WHEN best IS NULL OR s = best THEN pos END) OVER (PARTITION BY id) AS top FROM m",
    y="""SELECT x.*, t.cid AS top_id, t.tag AS top_tag FROM x LEFT JOIN x t ON t.id = x.id AND t.pos = x.top""",
    z="""SELECT * FROM y WHERE anchored OR pos = top OR (((tag = 'substance') = (top_tag = 'substance')) AND (list_contains(up, top_id) OR supported OR EXISTS (SELECT 1 FROM x q WHERE q.id = y.id AND q.supported AND list_contains(q.up, y.cid) AND y.s >= q.s)))""",
)


@query("broad_scope", "SELECT phrase, CASE WHEN anchored THEN 'description-families' ELSE 'semantic-families' END AS basis, cid AS concept_id FROM z WHERE NOT EXISTS (SELECT 1 FROM z o WHERE o.id = z.id AND list_contains(z.up, o.cid))", "parts", **_CANDIDATES)
def broad_scope(t: Tables) -> DataFrame:
    """Families that a phrase for each part means, among the part, its type and its brand."""
    key, size, word = F.col("p_partkey"), F.col("p_size"), lambda n: F.split_part("name", F.lit(" "), F.lit(n))
    tagged = lambda *parts: F.concat_ws(" ", F.concat(F.lit("q"), "own"), *parts)
    rows = t.parts.withColumn("own", F.col("concept_id"))
    asked = F.when(key % 3 == 0, tagged("name")).when(key % 3 == 1, tagged(word(2), F.lit("of"), word(1))).otherwise(tagged(F.lit("nothing alike")))
    score = lambda more: F.when(key % 5 != 0, (size + more) / 50.0)
    one = lambda pos, c, text, tag, up, more: F.struct(F.lit(pos).alias("pos"), F.col(c).alias("concept_id"), text.alias("term"), F.lit(tag).alias("tag"), F.array(text).alias("descriptions"), up.cast("array<string>").alias("ancestor_ids"), score(more).alias("rerank_score"))
    found = F.array(one(1, "own", tagged("name"), "disorder", F.array("brand_id", "type_id"), 0), one(2, "type_id", tagged(word(2), F.lit("kind")), "hallazgo", F.array(), 4), one(3, "brand_id", tagged("name", F.lit("made by"), "p_brand"), "substance", F.array(), 3))
    candidates = rows.select(asked.alias("phrase"), F.explode(found).alias("c")).select("phrase", "c.*")
    return families(candidates).select("phrase", "basis", "concept_id")
