"""Queries on text grounding, diagnosis, codings, quality, evaluation and telemetry."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diagnosis as D
from ..operators import evaluate as E
from ..operators import quality as Q
from ..operators import telemetry as T
from ..sources.views import RELEASE_NEW, Tables, tables
from .oracle_views import with_views

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None, *views: str, **ctes: str):
    def register(f):
        QUERIES[name] = lambda spark, folder: f(tables(spark, folder))
        if sql:
            SQL[name] = with_views(sql, *views, **ctes)
        return f

    return register


# ---- diagnosis

# every field of the whole method, from the order line and the part's size
_SECTIONS, _EVIDENCE, _TAGS, _KINDS = ("Assessment", "Chief complaint", "Plan", "Family history"), ("direct", "inferred", "context"), ("disorder", "finding", "trastorno", "procedure"), ("condition", "symptom", "medication")
_PROPOSAL = dict(
    e=f"""SELECT note_id, c.concept_id, c.brand_id, c.type_id, p.name AS phrase, assertion, temporality, subject, status, line, {list(_KINDS)}[line % 5 // 2 + 1] AS kind, {list(_SECTIONS)}[line % 4 + 1] AS section,
  {list(_EVIDENCE)}[p_size % 3 + 1] AS evidence, ['disorder', 'finding', 'disorder', 'procedure'][p_size % 4 + 1] AS tag, p_size * 2 AS confidence, l_quantity::INT % 7 = 0 AS reviewed FROM codings c JOIN parts p USING (concept_id)""",
    a="SELECT *, min(CASE WHEN assertion = 'present' AND subject = 'patient' AND kind = 'condition' AND section = 'Assessment' THEN line END) OVER (PARTITION BY note_id, section) = line AS first_here, status = 'accepted' OR reviewed AS mapped FROM e",
    o="SELECT *, CASE WHEN kind = 'condition' AND section = 'Chief complaint' THEN 5 WHEN kind = 'condition' AND section = 'Assessment' AND (coalesce(first_here, false) OR line % 5 = 0) THEN 4 WHEN section = 'Chief complaint' THEN 3 WHEN kind = 'condition' AND section = 'Assessment' THEN 2 ELSE 0 END AS own FROM a",
    h="SELECT *, CASE WHEN kind = 'condition' AND assertion = 'present' AND subject = 'patient' AND temporality = 'current' THEN max(own) OVER w ELSE own END AS priority, bool_or(mapped) OVER w AS resolved FROM o WINDOW w AS (PARTITION BY note_id, phrase, kind, assertion, temporality, subject)",
    x="""SELECT *, confidence * 0.3::DOUBLE + CASE section WHEN 'Assessment' THEN 22 WHEN 'Chief complaint' THEN 12 WHEN 'Plan' THEN -12 ELSE -18 END + CASE assertion WHEN 'present' THEN 20 WHEN 'suspected' THEN 8 ELSE -30 END
  + CASE status WHEN 'accepted' THEN 6 ELSE 3 END + CASE evidence WHEN 'direct' THEN 3 WHEN 'inferred' THEN 2 ELSE -10 END + CASE tag WHEN 'disorder' THEN 18 WHEN 'finding' THEN 2 ELSE -24 END AS score,
  CASE WHEN assertion = 'present' AND subject = 'patient' AND NOT mapped AND NOT resolved THEN priority ELSE 0 END AS unresolved FROM h""",
    y="SELECT *, CASE WHEN kind = 'medication' THEN 'not-diagnostic' WHEN tag = 'procedure' THEN 'not-finding' WHEN NOT mapped THEN 'mapping-needs-review' WHEN subject <> 'patient' THEN 'not-patient' WHEN score <= 0 THEN 'non-positive-score' END AS reason FROM x",
    b="SELECT note_id, concept_id, assertion, temporality, kind, phrase, tag, round(max(score) + least(4 * (count(*) - 1), 12), 2) AS score, count(*) AS support, max(confidence) AS confidence, max(priority) AS priority, assertion = 'present' AS eligible FROM y WHERE reason IS NULL GROUP BY ALL",
    r="SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY eligible DESC, priority DESC, score DESC, support DESC, confidence DESC, phrase, concept_id, assertion, temporality, kind) AS place FROM b",
    s="""SELECT r.*, eligible AND priority >= waiting AND place <= 3 AS candidate, eligible AND priority >= waiting AND place = 1 AS principal FROM r JOIN (SELECT note_id, max(unresolved) AS waiting FROM y GROUP BY note_id) USING (note_id)""",
)


def entries(t: Tables, together: bool = False) -> DataFrame:
    """together: a note's entries in one partition, shuffled as they come from the order lines, before texts are made of them."""
    names = t.parts.select(F.col("concept_id").alias("_c"), F.col("name").alias("phrase"), "p_size")
    pick = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (k + 1).cast("int"))
    line, size = F.col("line"), F.col("p_size")
    rows = t.codings.join(names, F.col("concept_id") == F.col("_c"))
    if together:
        brief = rows.select("note_id", "concept_id", F.element_at("ancestor_ids", 2).alias("brand_id"), F.element_at("ancestor_ids", 3).alias("type_id"), "phrase", "p_size", "line", "assertion", "temporality", "subject", "status", F.col("l_quantity").cast("int").alias("l_quantity"))
        rows = brief.repartition("note_id").withColumn("ancestor_ids", F.array("concept_id", "brand_id", "type_id", F.lit("900000")))
    return rows.select(
        "note_id", "concept_id", F.col("phrase").alias("term"), pick(_TAGS, size % 4).alias("tag"), "ancestor_ids", F.lit(True).alias("active"), "phrase", pick(_KINDS, F.floor(line % 5 / 2)).alias("kind"), "assertion", "temporality", F.lit(None).cast("string").alias("clinical_status"), "subject",
        pick(_SECTIONS, line % 4).alias("section"), F.lit(None).cast("int").alias("section_start"), line.alias("start"), F.concat(F.when(line % 5 == 0, "1. ").otherwise(""), "phrase").alias("sentence"), pick(_EVIDENCE, size % 3).alias("evidence"), F.col("status").alias("decision"), (F.col("l_quantity").cast("int") % 7 == 0).alias("reviewed"), (size * 2).alias("confidence"),
    )


@query("diagnosis_buckets", "SELECT note_id, concept_id, assertion, temporality, kind, score, support, confidence::INT AS confidence, priority::INT AS priority FROM b", "codings", "parts", **_PROPOSAL)
def diagnosis_buckets(t: Tables) -> DataFrame:
    return D.concepts(D.scored(entries(t))).select("note_id", "concept_id", "assertion", "temporality", "kind", "score", "support", "confidence", "priority")


@query("diagnosis_rank", "SELECT note_id, concept_id, assertion, temporality, kind, place::INT AS place, eligible FROM r", "codings", "parts", **_PROPOSAL)
def diagnosis_rank(t: Tables) -> DataFrame:
    return D.concepts(D.scored(entries(t))).select("note_id", "concept_id", "assertion", "temporality", "kind", "place", "eligible")


@query("diagnosis_split", "SELECT note_id, concept_id, assertion, temporality, kind, concat_ws('|', CASE WHEN candidate THEN 'candidate' END, CASE WHEN eligible AND NOT principal AND kind <> 'symptom' AND tag <> 'finding' THEN 'comorbidity' END, CASE WHEN principal THEN 'principal' END, CASE WHEN assertion = 'suspected' THEN 'suspected' END, CASE WHEN eligible AND NOT principal AND (kind = 'symptom' OR tag = 'finding') THEN 'symptom' END) AS roles FROM s", "codings", "parts", **_PROPOSAL)
def diagnosis_split(t: Tables) -> DataFrame:
    return D.proposal(D.scored(entries(t))).select("note_id", "concept_id", "assertion", "temporality", "kind", F.array_join("roles", "|").alias("roles"))


@query("diagnosis_exclusion", "SELECT coalesce(reason, 'none') AS reason, count(*) AS n FROM y GROUP BY ALL", "codings", "parts", **_PROPOSAL)
def diagnosis_exclusion(t: Tables) -> DataFrame:
    return D.scored(entries(t)).groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# ---- quality and evaluation


@query("coverage_by_language", "SELECT language_code, count(DISTINCT concept_id) AS concepts, count(*) AS descriptions FROM descriptions GROUP BY language_code", "descriptions")
def coverage_by_language(t: Tables) -> DataFrame:
    return Q.coverage_by_language(t.descriptions)


@query("coverage_orphans", "SELECT DISTINCT d.concept_id FROM descriptions d WHERE NOT EXISTS (SELECT 1 FROM concepts c WHERE c.active AND c.concept_id = d.concept_id)", "descriptions", "concepts")
def coverage_orphans(t: Tables) -> DataFrame:
    return Q.orphans(t.descriptions, t.concepts).select("concept_id").distinct()


_RAW = "SELECT c_custkey AS k, CASE WHEN c_custkey % 9 = 0 THEN ['1'] END AS descendant_ids, CASE c_custkey % 4 WHEN 0 THEN 'number' ELSE 'string' END AS ancestor_type, CASE c_custkey % 5 WHEN 0 THEN 'number' ELSE 'string' END AS parent_type, CASE c_custkey % 6 WHEN 0 THEN 'number' ELSE 'string' END AS child_type, CASE c_custkey % 7 WHEN 0 THEN 'number' ELSE 'string' END AS description_type FROM customer"


def raw_concepts(t: Tables) -> DataFrame:
    """Customers as raw concepts: ids of two types, some with stored descendants or without keys."""
    k = F.col("c_custkey")
    kind = lambda n: F.when(k % n == 0, "number").otherwise("string")
    none = F.array().cast("array<string>")
    return t.table("customer").select(k.alias("k"), F.when(k % 9 == 0, F.array(F.lit("1"))).alias("descendant_ids"), kind(4).alias("ancestor_type"), kind(5).alias("parent_type"), kind(6).alias("child_type"), kind(7).alias("description_type"), F.when(k % 2 == 0, F.array(F.lit("r"))).otherwise(none).alias("relationships"), F.when(k % 3 == 0, F.array(F.lit("t|d"))).alias("relationship_keys"), F.when(k % 10 == 0, None).when(k % 3 == 0, "true").when(k % 3 == 1, k.cast("string")).otherwise("core").alias("mixed"))


@query("quality_counters", "SELECT count(*) FILTER (WHERE k % 9 = 0) AS stored_descendants, count(*) FILTER (WHERE ancestor_type = 'number') AS numeric_ancestors, count(*) FILTER (WHERE parent_type = 'number') AS numeric_parents, count(*) FILTER (WHERE child_type = 'number') AS numeric_children, count(*) FILTER (WHERE description_type = 'number') AS numeric_descriptions, count(*) FILTER (WHERE k % 2 = 0 AND k % 3 <> 0) AS missing_keys FROM r", r=_RAW)
def quality_counters(t: Tables) -> DataFrame:
    return Q.hardening_counters(raw_concepts(t))


@query("type_sets", "SELECT 'bool,null,number,string' AS mixed, 'string' AS ancestor_type, 'number' AS k FROM (SELECT count(*) FROM customer)")
def type_sets(t: Tables) -> DataFrame:
    return Q.type_sets(raw_concepts(t), "mixed", "ancestor_type", "k")


@query("existence_facts", "SELECT bool_or(k % 9 = 0) AS has_descendants, bool_or(k % 4 = 0) AS numeric_ancestors, bool_or(k < -5) AS has_nothing FROM r", r=_RAW)
def existence_facts(t: Tables) -> DataFrame:
    raw = raw_concepts(t)
    return Q.existence_facts(raw, has_descendants=F.col("descendant_ids").isNotNull(), numeric_ancestors=F.col("ancestor_type") == "number", has_nothing=F.col("k") < -5)


_FACT_NAMES = ("has_release_id", "has_effective_time", "has_release_date", "has_descendants", "numeric_ancestors", "numeric_parents", "numeric_children", "numeric_descriptions", "has_keys", "projection_release_date", "has_tag_key", "has_vectors", "indexed_release_id", "indexed_effective_time", "indexed_ancestors", "indexed_keys", "indexed_lookup", "text_ready", "vector_ready")
_READY = dict(
    f="SELECT s_suppkey, s_suppkey % 5 AS projection_rows, " + ", ".join(f"CASE (s_suppkey * {n + 3} // {n + 1}) % 4 WHEN 0 THEN NULL WHEN 1 THEN {'true' if n < 3 or n > 7 else 'false'} WHEN 2 THEN {'false' if n < 3 or n > 7 else 'true'} ELSE {'true' if n < 3 or n > 7 else 'false'} END AS {name}" for n, name in enumerate(_FACT_NAMES)) + " FROM supplier",
    p="""SELECT *, projection_rows > 0 AS projection_populated, has_vectors AS vectors_present, indexed_ancestors AS ancestor_lookup_ready, has_release_id OR has_effective_time AS diff_ready, (has_release_id AND indexed_release_id) OR (has_effective_time AND indexed_effective_time) AS diff_indexed, has_release_id AND has_release_date AND projection_release_date AS release_metadata_ready,
  NOT has_descendants AS descendants_retired, NOT (numeric_ancestors OR numeric_parents OR numeric_children OR numeric_descriptions) AS ids_are_strings, indexed_lookup AND has_tag_key AS terms_ready, has_keys AND indexed_keys AS attributes_ready FROM f""",
)


@query("readiness_report", "SELECT s_suppkey, projection_populated, text_ready, vector_ready, vectors_present, ancestor_lookup_ready, diff_ready, diff_indexed, release_metadata_ready, descendants_retired, ids_are_strings, terms_ready, attributes_ready, release_metadata_ready AND descendants_retired AND ids_are_strings AND terms_ready AND attributes_ready AS hardened_ready, projection_populated AND text_ready AND indexed_ancestors AND CASE WHEN vector_ready THEN true ELSE NOT has_vectors END AS architecture_ready FROM p", **_READY)
def readiness_report(t: Tables) -> DataFrame:
    """A model for each supplier, with facts that are true, false or weren't recorded."""
    key = F.col("s_suppkey")
    good = lambda n: n < 3 or n > 7
    fact = lambda n: F.when((k := F.floor(key * (n + 3) / (n + 1)) % 4) == 0, None).when(k == 2, not good(n)).otherwise(good(n)).cast("boolean")
    facts = t.table("supplier").select("s_suppkey", (key % 5).alias("projection_rows"), *(fact(n).alias(name) for n, name in enumerate(_FACT_NAMES)))
    return Q.readiness(facts).select("s_suppkey", *Q.REPORT)


@query("required_coverage", "SELECT r.concept_id, missing_in FROM (SELECT concept_id FROM concepts WHERE tag = 'customer' UNION SELECT '999999') r, LATERAL (SELECT unnest([CASE WHEN NOT EXISTS (SELECT 1 FROM concepts c WHERE c.active AND c.concept_id = r.concept_id) THEN 'source' END, CASE WHEN r.concept_id::INT % 2 = 1 THEN 'projection' END]) AS missing_in) WHERE missing_in IS NOT NULL", "concepts")
def required_coverage(t: Tables) -> DataFrame:
    required = t.concepts.where("tag = 'customer'").select("concept_id").union(t.spark.createDataFrame([("999999",)], "concept_id string"))
    return Q.missing_required(required, t.concepts, t.concepts.where(F.col("concept_id").cast("int") % 2 == 0))


@query("release_upsert", "SELECT concept_id, active, release_id FROM (SELECT concept_id, active, release_id FROM release_old WHERE concept_id::INT % 3 <> 0 UNION ALL SELECT concept_id, NOT active, release_id FROM release_old WHERE concept_id::INT % 3 = 0 UNION ALL SELECT concept_id, active, release_id FROM release_new WHERE concept_id::INT % 2 = 0)", "release_old", "release_new")
def release_upsert(t: Tables) -> DataFrame:
    """A stored table of two releases after an upsert into one, a clearing, and a write of the other."""
    from ..sources import readers as S
    from ..sources.storage import shared_folder

    path = f"{shared_folder(t.spark)}/releases-{uuid.uuid4().hex}"
    columns = ("concept_id", "active", "release_id")
    S.reset(t.release_old.unionByName(t.release_new).select(*columns), path)
    changed = t.release_old.where(F.col("concept_id").cast("int") % 3 == 0).select("concept_id", (~F.col("active")).alias("active"), "release_id")
    S.upsert_release(t.spark, changed, path, "concept_id")
    S.clear_release(t.spark, path, RELEASE_NEW)
    S.replace_release(t.release_new.where(F.col("concept_id").cast("int") % 2 == 0).select(*columns), path)
    return t.spark.read.schema("concept_id string, active boolean, release_id string").parquet(path)


@query("seed_overrides", "SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN 'user' ELSE 'seed' END AS origin FROM part")
def seed_overrides(t: Tables) -> DataFrame:
    """Built-in rows, with a user's in place of those with the same id."""
    from ..sources.readers import by_priority

    part = t.table("part")
    return by_priority(part.select(F.col("p_partkey").alias("id"), F.lit("seed").alias("origin")), part.where("p_size > 25").select(F.col("p_partkey").alias("id"), F.lit("user").alias("origin")), key="id")


@query("stamp_unstamped", "SELECT concept_id, CASE WHEN concept_id::INT % 2 = 0 THEN '20230101' ELSE '20240701' END AS release_id, strptime(CASE WHEN concept_id::INT % 2 = 0 THEN '20230101' ELSE '20240701' END, '%Y%m%d') AS release_date FROM release_old", "release_old")
def stamp_unstamped(t: Tables) -> DataFrame:
    rows = t.release_old.select("concept_id", F.when(F.col("concept_id").cast("int") % 2 == 0, "20230101").alias("release_id"))
    return Q.stamp_release(rows, "20240701", False).select("concept_id", "release_id", F.col("release_date").cast("timestamp_ntz").alias("release_date"))


@query("harden_concepts", "SELECT (300000 + c_custkey)::VARCHAR AS concept_id, c_custkey % 4 < 2 AS active, '20240701' AS release_id FROM customer")
def harden_concepts(t: Tables) -> DataFrame:
    """Ids that came as numbers and flags that came in four spellings."""
    key = F.col("c_custkey")
    flags = F.element_at(F.array(*map(F.lit, ("TRUE", "1", "0", "no"))), (key % 4 + 1).cast("int"))
    raw = t.table("customer").select((F.lit(300000) + key).alias("concept_id"), flags.alias("active"))
    return Q.stamp_release(Q.harden(raw), "20240701", True).select("concept_id", "active", "release_id")


_TRI = "CASE s_suppkey % 3 WHEN 0 THEN true WHEN 1 THEN false END"


@query("readiness_3vl", f"SELECT s_suppkey, coalesce((({_TRI}) AND s_acctbal > 0)::VARCHAR, 'unknown') AS both, coalesce((({_TRI}) OR s_acctbal > 0)::VARCHAR, 'unknown') AS either, coalesce((NOT ({_TRI}))::VARCHAR, 'unknown') AS neither FROM supplier")
def readiness_3vl(t: Tables) -> DataFrame:
    key = F.col("s_suppkey") % 3
    fact, other = F.when(key == 0, True).when(key == 1, False), F.col("s_acctbal") > 0
    word = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    return t.table("supplier").select("s_suppkey", word(Q.tri_and(fact, other)).alias("both"), word(Q.tri_or(fact, other)).alias("either"), word(~fact).alias("neither"))


@query("eval_precision_recall", "SELECT lang, count(*) FILTER (WHERE g AND p) AS hits, CASE WHEN count(*) FILTER (WHERE p) = 0 THEN 1 ELSE round(count(*) FILTER (WHERE g AND p) / count(*) FILTER (WHERE p), 6) END AS precision, CASE WHEN count(*) FILTER (WHERE g) = 0 THEN 1 ELSE round(count(*) FILTER (WHERE g AND p) / count(*) FILTER (WHERE g), 6) END AS recall FROM (SELECT d.lang, l.quality = 1 AS g, d.n_chars > 500 AS p FROM documents d JOIN labels l USING (doc_id)) GROUP BY lang")
def eval_precision_recall(t: Tables) -> DataFrame:
    rows = t.table("documents").join(t.table("labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("gold"), (F.col("n_chars") > 500).alias("predicted"))
    return E.precision_recall(rows, "lang")


_STOP = "['of', 'the', 'a', 'an', 'with', 'and', 'or', 'to', 'for', 'on', 'in', 'at', 'current', 'present', 'no', 'not', 'evidence', 'signs', 'review']"
_PLAIN = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g'))"
_WORDS = f"list_filter(string_split({{}}, ' '), lambda w: w <> '' AND NOT list_contains({_STOP}, w))"


@query("eval_phrase_match", f"SELECT a, b, x = y OR contains(x, y) OR contains(y, x) OR (least(len(p), len(q)) > 0 AND len(list_filter(p, lambda w: list_contains(q, w))) >= 0.6 * least(len(p), len(q))) AS matched FROM (SELECT *, {_WORDS.format('x')} AS p, {_WORDS.format('y')} AS q FROM (SELECT a, b, {_PLAIN.format('a')} AS x, {_PLAIN.format('b')} AS y FROM (SELECT DISTINCT p_name || ' of the arm' AS a, p_type || ' ' || split_part(p_name, ' ', 2) || ', arm' AS b FROM part)))")
def eval_phrase_match(t: Tables) -> DataFrame:
    pairs = t.table("part").select(F.concat("p_name", F.lit(" of the arm")).alias("a"), F.concat_ws(" ", "p_type", F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(", arm"))).alias("b")).distinct()
    return pairs.select("a", "b", E.phrase_match(F.col("a"), F.col("b")).alias("matched"))


# facts of each note: its order lines; mentions: the same lines without every fifth, with other meanings on some
_EVAL = dict(
    f="SELECT note_id, line, min(assertion) AS assertion, min(subject) AS subject FROM codings GROUP BY note_id, line",
    m="SELECT note_id, line, CASE WHEN line % 4 = 0 THEN 'absent' ELSE assertion END AS said, CASE WHEN line % 3 = 0 THEN 'family' ELSE subject END AS whom FROM f WHERE line % 5 <> 0",
)


def _facts(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.codings.groupBy("note_id", "line").agg(F.min("assertion").alias("assertion"), F.min("subject").alias("subject"))
    phrase = F.concat(F.lit("item "), F.col("line").cast("string"))
    facts = rows.select("note_id", F.col("line").alias("pos"), phrase.alias("phrase"), "assertion", "subject")
    said = rows.where("line % 5 <> 0").select("note_id", F.col("line").alias("pos"), phrase.alias("phrase"), F.when(F.col("line") % 4 == 0, "absent").otherwise(F.col("assertion")).alias("assertion"), F.when(F.col("line") % 3 == 0, "family").otherwise(F.col("subject")).alias("subject"), F.upper(phrase).alias("verbatim"))
    return facts, said


@query("fact_matching", "SELECT note_id, line::INT AS fact, line::INT AS mention FROM m", "codings", **_EVAL)
def fact_matching(t: Tables) -> DataFrame:
    return E.matched(*_facts(t))


_OK = "CASE WHEN {0} IN ('absent', 'suspected', 'planned') THEN {0} ELSE 'present' END"


@query("evidence_metrics", f"""SELECT note_id, round(avg((m.line IS NOT NULL)::INT), 6) AS detection, round(avg((m.line IS NOT NULL AND {_OK.format('said')} = {_OK.format('assertion')})::INT), 6) AS assertion_accuracy, round(avg(coalesce(whom = subject, false)::INT), 6) AS subject_accuracy,
  round(avg((m.line IS NOT NULL AND {_OK.format('said')} = {_OK.format('assertion')} AND whom = subject)::INT), 6) AS recall, 1.0::DOUBLE AS precision FROM f LEFT JOIN m USING (note_id, line) GROUP BY note_id""", "codings", **_EVAL)
def evidence_metrics(t: Tables) -> DataFrame:
    facts, said = _facts(t)
    return E.evidence_metrics(facts, said, E.matched(facts, said))


@query("retrieval_metrics", """SELECT note_id, count(*) AS expected, round(avg(exact::INT), 6) AS recall, CASE WHEN bool_or(inside) THEN round(count(*) FILTER (WHERE exact AND inside) / count(*) FILTER (WHERE inside), 6) END AS in_scope_recall, round(avg(coalesce(accepted, false)::INT), 6) AS accepted_recall, count(*) FILTER (WHERE NOT exact AND near) AS related_only
  FROM (SELECT w.note_id, w.concept_id, h.accepted, h.concept_id IS NOT NULL AS exact, w.concept_id::INT % 2 = 0 AS inside, EXISTS (SELECT 1 FROM h o JOIN closure c ON (c.concept_id = w.concept_id AND c.ancestor_id = o.concept_id) OR (c.concept_id = o.concept_id AND c.ancestor_id = w.concept_id) WHERE o.note_id = w.note_id) AS near FROM w LEFT JOIN h ON h.note_id = w.note_id AND h.concept_id = w.concept_id) GROUP BY note_id""", "codings", "closure", w="SELECT DISTINCT note_id, concept_id FROM codings", h="SELECT note_id, concept_id, bool_or(accepted) AS accepted FROM (SELECT note_id, CASE WHEN line % 4 = 0 THEN brand_id ELSE concept_id END AS concept_id, line % 2 = 0 AS accepted FROM codings WHERE line % 3 <> 0) GROUP BY ALL")
def retrieval_metrics(t: Tables) -> DataFrame:
    """Expected are a note's concepts; found are two thirds of them, some as their brand."""
    found = t.codings.where("line % 3 <> 0").select("note_id", F.when(F.col("line") % 4 == 0, F.element_at("ancestor_ids", 2)).otherwise(F.col("concept_id")).alias("concept_id"), (F.col("line") % 2 == 0).alias("accepted"))
    projected = t.concepts.where(F.col("concept_id").cast("int") % 2 == 0)
    return E.retrieval_metrics(t.codings, found, projected, t.closure)


@query("evaluation_means", "SELECT p_brand AS model, count(*) AS notes, round(avg(CASE WHEN p_size % 3 > 0 THEN p_size END), 6) AS recall, round(avg(p_retailprice), 6) AS precision FROM part WHERE p_partkey % 7 <> 0 GROUP BY p_brand")
def evaluation_means(t: Tables) -> DataFrame:
    rows = t.table("part").select(F.col("p_brand").alias("model"), (F.col("p_partkey") % 7 != 0).alias("scored"), F.when(F.col("p_size") % 3 > 0, F.col("p_size")).alias("recall"), F.col("p_retailprice").alias("precision"))
    return E.evaluation_means(rows, "recall", "precision")


@query("diagnosis_metrics", "SELECT note_id, list_contains(ranked[1:1], want) AS top1, list_contains(ranked[1:3], want) AS top3, round(CASE WHEN len(proposed) > 0 THEN len(list_intersect(expected, proposed)) / len(proposed) WHEN len(expected) = 0 THEN 1 ELSE 0 END, 6) AS precision, round(CASE WHEN len(expected) = 0 THEN 1 ELSE len(list_intersect(expected, proposed)) / len(expected) END, 6) AS recall FROM (SELECT note_id, list(concept_id ORDER BY l_quantity, concept_id) AS ranked, min(concept_id) AS want, coalesce(list(DISTINCT concept_id) FILTER (WHERE line % 2 = 0), []) AS expected, coalesce(list(DISTINCT concept_id) FILTER (WHERE line % 3 = 0), []) AS proposed FROM codings GROUP BY note_id)", "codings")
def diagnosis_metrics(t: Tables) -> DataFrame:
    some = lambda k: F.array_distinct(F.collect_list(F.when(F.col("line") % k == 0, F.col("concept_id"))))
    rows = t.codings.groupBy("note_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_quantity", "concept_id"))), lambda x: x["concept_id"]).alias("ranked"), F.min("concept_id").alias("expected_principal"), some(2).alias("expected"), some(3).alias("proposed"))
    return E.ranked_diagnoses(rows)


@query("contract_checks", "SELECT violation, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN line % 2 = 0 AND line <> 4 THEN 'span' END, CASE WHEN line % 3 = 0 THEN 'release' END, CASE WHEN status = 'accepted' AND line % 2 = 1 THEN 'support' END], lambda x: x IS NOT NULL)) AS violation FROM codings) GROUP BY violation", "codings")
def contract_checks(t: Tables) -> DataFrame:
    """Mentions whose spans, codes and acceptance don't hold; every line with an even number is anchored, the fourth rightly."""
    line = F.col("line")
    mentions = t.codings.select(F.concat_ws("-", "note_id", "line", "concept_id").alias("mention_id"), "note_id", F.when(line % 3 == 0, F.concat("concept_id", F.lit("x"))).otherwise(F.col("concept_id")).alias("concept_id"), "status", F.when(line % 2 == 0, 4).alias("start"), F.when(line % 2 == 0, 8).alias("end"), F.when(line == 4, "text").otherwise("none").alias("verbatim"))
    notes = t.notes.select("note_id", F.lit("the text of a note").alias("text"))
    return E.contract_violations(mentions, notes, t.concepts).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


@query("diagnosis_explanation", "SELECT part, said, count(*) AS n, sum(place)::BIGINT AS places FROM (SELECT 'ranking' AS part, place, CASE WHEN principal THEN 'principal' WHEN eligible THEN CASE WHEN tag = 'finding' THEN 'symptom' ELSE 'comorbidity' END WHEN assertion = 'suspected' THEN 'suspected' ELSE 'unclassified' END AS said FROM s UNION ALL SELECT 'excluded', NULL, reason FROM y WHERE reason IS NOT NULL) GROUP BY ALL", "codings", "parts", **_PROPOSAL)
def diagnosis_explanation(t: Tables) -> DataFrame:
    return D.explanation(D.scored(entries(t, together=True), together=True)).groupBy("part", "said").agg(F.count(F.lit(1)).alias("n"), F.sum("place").cast("long").alias("places"))


@query("model_recommendation", "SELECT model FROM (SELECT p_brand AS model, round(avg(p_size) / 50, 6) AS composite, count(*) AS tokens, min(p_partkey) AS latency FROM part GROUP BY p_brand) WHERE composite >= (SELECT max(c) FROM (SELECT round(avg(p_size) / 50, 6) AS c FROM part GROUP BY p_brand)) - 0.02 ORDER BY tokens, latency, model LIMIT 1")
def model_recommendation(t: Tables) -> DataFrame:
    models = t.table("part").groupBy(F.col("p_brand").alias("model")).agg(F.round(F.avg("p_size") / 50, 6).alias("composite"), F.count(F.lit(1)).alias("tokens"), F.min("p_partkey").alias("latency"))
    return E.recommend(models).select("model")


# ---- telemetry


@query("telemetry_hash_preview", "SELECT id, event_type, left(sha1(lower(trim(query_text))), 16) AS query_hash, CASE WHEN length(trim(query_text)) > 8 THEN left(trim(query_text), 5) || '...' ELSE trim(query_text) END AS query_preview FROM telemetry", "telemetry")
def telemetry_hash_preview(t: Tables) -> DataFrame:
    return T.records(t.telemetry)


@query("usage_events", "SELECT id, event_type, 'demo-minister' AS tenant_id, coalesce(nullif(trim(actor_id::VARCHAR), '7'), 'demo-user') AS actor_id, '20240701' AS release_id, '1,2' AS concept_ids, CASE WHEN length(trim(query_text)) > 0 THEN left(sha1(lower(trim(query_text))), 16) END AS query_hash, CASE WHEN id % 2 = 0 THEN 12.5 END::DOUBLE AS result_count FROM telemetry WHERE event_type <> 'error'", "telemetry")
def usage_events(t: Tables) -> DataFrame:
    """Raw events with blanks, repeated ids and numbers as text, as they are kept."""
    none, number = F.lit(None).cast("string"), F.when(F.col("id") % 2 == 0, " 12.5").otherwise("many")
    raw = t.telemetry.select(
        "id", "at", F.when(F.col("event_type") == "error", "  ").otherwise(F.concat(F.lit(" "), "event_type")).alias("event_type"), none.alias("tenant_id"), F.when(F.col("actor_id") == 7, " ").otherwise(F.col("actor_id").cast("string")).alias("actor_id"), none.alias("source"), none.alias("status"), none.alias("release_id"), none.alias("language_code"),
        F.array(F.lit("1 "), F.lit("2"), F.lit(""), F.lit("1")).alias("concept_ids"), "query_text", number.alias("result_count"), none.alias("duration_ms"),
    )
    return T.usage_events(raw, "20240701").select("id", "event_type", "tenant_id", "actor_id", "release_id", F.array_join("concept_ids", ",").alias("concept_ids"), "query_hash", "result_count")


@query("explorer_events", "SELECT event_type, count(*) AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'explorer.result.selected' WHEN 'view' THEN 'explorer.search.submitted' ELSE event_type END AS event_type FROM telemetry) WHERE starts_with(event_type, 'explorer.') GROUP BY event_type", "telemetry")
def explorer_events(t: Tables) -> DataFrame:
    named = t.telemetry.withColumn("event_type", F.when(F.col("event_type") == "click", "explorer.result.selected").when(F.col("event_type") == "view", "explorer.search.submitted").otherwise(F.col("event_type")))
    return T.allowed_events(named, T.EXPLORER_EVENTS).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("telemetry_daily", "SELECT strftime(\"at\", '%Y-%m-%d') AS day, event_type, count(*) AS n, count(DISTINCT actor_id) AS actors FROM telemetry GROUP BY ALL", "telemetry")
def telemetry_daily(t: Tables) -> DataFrame:
    return T.daily(t.telemetry)


@query("telemetry_sessions", "SELECT actor_id, session, count(*) AS n, min(\"at\") AS first_at, max(\"at\") AS last_at FROM (SELECT *, sum(new) OVER (PARTITION BY actor_id ORDER BY \"at\", id)::BIGINT AS session FROM (SELECT *, CASE WHEN \"at\" - lag(\"at\") OVER (PARTITION BY actor_id ORDER BY \"at\", id) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM telemetry)) GROUP BY actor_id, session", "telemetry")
def telemetry_sessions(t: Tables) -> DataFrame:
    return T.sessions(t.telemetry)
