"""Queries on codings as facts: merging, covered ancestors, roles, targets, lenses, resources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import records as R
from ..functions import text as X
from ..operators import codings as C
from ..operators import quality as Q
from ..sources.views import Tables, tables
from .oracle_views import with_views

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None, *views: str, **ctes: str):
    def register(f):
        QUERIES[name] = lambda spark, folder: f(tables(spark, folder))
        if sql:
            SQL[name] = with_views(sql, *views, **ctes)
        return f

    return register


# two facts of each order line: the part's, and its type's, which the part's may cover
_TAGS = ("disorder", "hallazgo", "procedimiento", "product", "régimen/tratamiento", "body structure")
_FACTS = dict(
    x=f"""SELECT c.note_id, c.line, c.concept_id AS part, c.brand_id, c.type_id, p.name, t.p_type, c.assertion, c.subject, c.temporality, c.status, l_quantity::INT AS q, {list(_TAGS)}[c.type_id::INT % 6 + 1] AS tag FROM codings c JOIN parts p USING (concept_id) JOIN types t ON t.concept_id = c.type_id""",
    y="""SELECT *, CASE WHEN q % 11 = 0 THEN NULL WHEN q % 7 = 0 THEN 'observation' WHEN q % 13 = 0 THEN 'test' ELSE 'condition' END AS kind, CASE q % 5 WHEN 0 THEN 'planned' WHEN 1 THEN 'completed' WHEN 2 THEN 'current' WHEN 3 THEN 'discussion' END AS workflow,
  CASE WHEN q % 9 = 0 THEN 'resolved' END AS clinical_status, CASE WHEN q % 3 = 0 THEN 'arm' END AS site, CASE WHEN q % 6 = 0 THEN 'left' END AS laterality,
  CASE q % 4 WHEN 0 THEN q || ' mg' WHEN 1 THEN q || '/' || (q + 40) || ' mmHg' WHEN 2 THEN q || '.5 %' END AS result FROM x""",
    f="""SELECT *, 2 * line AS pos, part AS concept_id, name AS term, CASE WHEN q % 17 = 0 THEN 'principal' ELSE 'secondary' END AS role, NULL::VARCHAR AS relative_time, 'c' || (q % 2) AS color, 'line ' || line AS e1, NULL::VARCHAR AS e2, [part, brand_id, type_id, '900000'] AS up FROM y
  UNION ALL SELECT *, 2 * line + 1, type_id, p_type, CASE WHEN q % 19 = 0 THEN 'principal' ELSE 'secondary' END, CASE WHEN q % 8 = 0 THEN 'early' END, 'type ' || (q % 3), 'type', 'line ' || line, [type_id, '900000'] FROM y""",
)


def facts(t: Tables, together: bool = False, named: bool = True) -> DataFrame:
    """together: a note's facts in one partition, shuffled as plain order lines, before they double and carry maps.
    named: with term and phrase; without them a part needs no join."""
    lines = t.codings.select("note_id", "concept_id", F.element_at("ancestor_ids", 2).alias("brand_id"), F.element_at("ancestor_ids", 3).alias("type_id"), "assertion", "subject", "temporality", "status", "line", F.col("l_quantity").cast("int").alias("q"), "row")
    if named:
        names = t.parts.select(F.col("concept_id").alias("_c"), F.col("name"))
        types = t.types.select(F.col("concept_id").alias("type_id"), "p_type")
        # merged, as a broadcast of few lines would leave all that follows to the one partition of the parts' file
        lines = lines.join(names.hint("merge"), F.col("concept_id") == F.col("_c")).join(types, "type_id")
    lines = lines.repartition("note_id") if together else lines
    # a line doubles before anything is made of it: what follows is compiled, an exploded struct is not
    base, own, q = lines.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))), F.col("_own"), F.col("q")
    either = lambda part, kind: F.when(own, part).otherwise(kind)
    pick = lambda k, *values: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    site, side = F.when(q % 3 == 0, "arm"), F.when(q % 6 == 0, "left")
    result = F.when(q % 4 == 0, F.concat(q.cast("string"), F.lit(" mg"))).when(q % 4 == 1, F.concat(q.cast("string"), F.lit("/"), (q + 40).cast("string"), F.lit(" mmHg"))).when(q % 4 == 2, F.concat(q.cast("string"), F.lit(".5 %")))
    color = either(F.concat(F.lit("c"), (q % 2).cast("string")), F.concat(F.lit("type "), (q % 3).cast("string")))
    given = (either(F.lit("Sitio"), F.lit("site")), site), (either(F.lit("lateralidad"), F.lit("Laterality")), side), (either(F.lit("Resultado"), F.lit("result")), result), (F.lit("color"), color), (F.lit("Momento"), F.when(~own & (q % 8 == 0), F.lit("early")))
    held = F.map_filter(F.map_from_arrays(F.array(*(k for k, _ in given)), F.array(*(v for _, v in given))), lambda k, v: v.isNotNull())
    line, root = F.concat(F.lit("line "), F.col("line").cast("string")), F.lit("900000")
    term = either(F.col("name"), F.col("p_type")) if named else None
    return base.select(
        "note_id", "assertion", "subject", "temporality",
        F.when(q % 5 == 0, "planned").when(q % 5 == 1, "completed").when(q % 5 == 2, "current").when(q % 5 == 3, "discussion").alias("workflow"), F.when(q % 11 == 0, None).when(q % 7 == 0, "observation").when(q % 13 == 0, "test").otherwise("condition").alias("kind"),
        F.when(q % 9 == 0, "resolved").alias("clinical_status"), (F.col("status") == "accepted").alias("accepted"), pick(F.col("type_id").cast("int") % 6, *_TAGS).alias("tag"), (2 * F.col("line") + either(F.lit(0), F.lit(1))).alias("pos"), either(F.col("concept_id"), F.col("type_id")).alias("concept_id"),
        *([term.alias("term"), term.alias("phrase")] if named else []), F.when(q % either(F.lit(17), F.lit(19)) == 0, "principal").otherwise("secondary").alias("role"), held.alias("attributes"),
        either(F.array("concept_id", "brand_id", "type_id", root), F.array("type_id", root)).alias("ancestor_ids"), either(F.array(line), F.array(F.lit("type"), line)).alias("evidence"), "row",
    )


_KEY = "note_id, concept_id, assertion, subject, temporality, workflow, kind, clinical_status, site, laterality, result, relative_time"
_MERGED = dict(
    **_FACTS,
    m=f"""SELECT {_KEY}, min(pos) AS pos, CASE WHEN bool_or(role = 'principal') THEN 'principal' ELSE min_by(role, pos) END AS role, min_by(color, pos) AS color, max_by(color, pos) AS last_color, list(color ORDER BY pos) AS colors, bool_or(status = 'accepted') AS accepted,
  list(e1 ORDER BY pos) AS es1, list(e2 ORDER BY pos) AS es2, any_value(up) AS up, any_value(term) AS term, min_by(tag, pos) AS tag FROM f GROUP BY ALL""",
    s=f"SELECT {_KEY}, string_agg(e, ',' ORDER BY k) AS evidence FROM (SELECT {_KEY}, e, min(k) AS k FROM (SELECT {_KEY}, e1 AS e, 2 * pos AS k FROM f UNION ALL SELECT {_KEY}, e2, 2 * pos + 1 FROM f) WHERE e IS NOT NULL GROUP BY ALL) GROUP BY ALL",
)
_SAME = " AND ".join(f"m.{k} IS NOT DISTINCT FROM s.{k}" for k in _KEY.split(", "))


@query("coding_merge", f"SELECT m.note_id, m.concept_id, m.assertion, m.subject, m.temporality, m.workflow, m.kind, m.pos::INT AS pos, role, m.site, m.result, m.relative_time, color, list_filter(colors, lambda x: x <> color)[-1] AS other_color, accepted, evidence FROM m JOIN s ON {_SAME}", "codings", "parts", "types", **_MERGED)
def coding_merge(t: Tables) -> DataFrame:
    of = lambda name: F.col("attributes")[name].alias(name)
    clash = F.get(F.col("conflicts")["color"], F.lit(1)).alias("other_color")
    merged = C.merge(facts(t, together=True, named=False).drop("tag", "ancestor_ids"), "row")
    return merged.select("note_id", "concept_id", "assertion", "subject", "temporality", "workflow", "kind", "pos", "role", of("site"), of("result"), of("relativeTime").alias("relative_time"), of("color"), clash, "accepted", F.array_join("evidence", ",").alias("evidence"))


_SENSE = " AND ".join(f"u.{k} IS NOT DISTINCT FROM o.{k}" for k in "assertion subject temporality kind workflow clinical_status site laterality result relative_time".split())
_COVERS = f"SELECT u.rowid AS upper, o.rowid AS lower, len(o.up) AS deep, o.pos AS pos, o.concept_id AS own FROM n u JOIN n o ON u.note_id = o.note_id AND u.concept_id <> o.concept_id AND list_contains(o.up, u.concept_id) AND {_SENSE} WHERE u.role <> 'principal' AND u.assertion = 'present' AND u.temporality = 'current' AND u.subject = 'patient' AND coalesce(u.kind, 'condition') = 'condition'"


@query("coding_covered", "SELECT note_id, concept_id, assertion, subject, temporality, workflow, kind, pos::INT AS pos, (SELECT count(*) FROM p WHERE p.lower = n.rowid) AS taken FROM n WHERE rowid NOT IN (SELECT upper FROM c)", "codings", "parts", "types", **_MERGED, n="SELECT *, row_number() OVER () AS rowid FROM m", c=_COVERS, p="SELECT upper, arg_min(lower, (-deep, pos, own)) AS lower FROM c GROUP BY upper")
def coding_covered(t: Tables) -> DataFrame:
    """Merged facts without covered ones, and how many each has taken over."""
    kept = C.drop_covered(C.merge(facts(t, together=True, named=False), "row"))
    return kept.select("note_id", "concept_id", "assertion", "subject", "temporality", "workflow", "kind", "pos", "taken")


_ROLE = "CASE WHEN kind IN ('observation', 'test') THEN kind WHEN tag IN ('disorder', 'hallazgo') THEN 'diagnosis' WHEN tag IN ('procedimiento', 'régimen/tratamiento') THEN 'procedure' WHEN tag = 'product' THEN 'medication' ELSE 'other' END"


def with_roles(t: Tables) -> DataFrame:
    return C.with_role(facts(t))


@query("coding_role", f"SELECT coalesce(kind, 'none') AS kind, tag, {_ROLE} AS role, count(*) AS n FROM f GROUP BY ALL", "codings", "parts", "types", **_FACTS)
def coding_role(t: Tables) -> DataFrame:
    return with_roles(t).groupBy(F.coalesce("kind", F.lit("none")).alias("kind"), "tag", F.col("code_role").alias("role")).agg(F.count(F.lit(1)).alias("n"))


_DONE = "CASE WHEN workflow = 'completed' THEN 'completed'"
_RESOURCE = dict(
    **_FACTS,
    r=f"SELECT *, {_ROLE} AS code_role FROM f",
    z="""SELECT *, CASE WHEN workflow = 'discussion' THEN NULL WHEN subject = 'family' THEN 'FamilyMemberHistory' WHEN kind = 'observation' THEN 'Observation' WHEN code_role IN ('procedure', 'test') THEN CASE WHEN workflow = 'planned' THEN 'ServiceRequest' ELSE 'Procedure' END
  WHEN code_role = 'medication' THEN CASE WHEN workflow = 'planned' THEN 'MedicationRequest' ELSE 'MedicationStatement' END WHEN code_role = 'diagnosis' THEN 'Condition' END AS resource_type FROM r""",
)


@query(
    "coding_resources",
    f"""SELECT note_id, pos::INT AS pos, concept_id, resource_type, CASE resource_type WHEN 'FamilyMemberHistory' THEN 'partial' WHEN 'Observation' THEN CASE WHEN workflow = 'completed' THEN 'final' ELSE 'unknown' END WHEN 'ServiceRequest' THEN 'draft' WHEN 'MedicationRequest' THEN 'draft'
      WHEN 'Procedure' THEN {_DONE} ELSE 'unknown' END WHEN 'MedicationStatement' THEN {_DONE} WHEN workflow = 'current' THEN 'active' ELSE 'unknown' END END AS status,
    CASE WHEN resource_type IS NOT NULL THEN concept_id END AS code, CASE WHEN resource_type = 'FamilyMemberHistory' THEN 'Relative not specified' END AS relation,
    CASE WHEN resource_type = 'Observation' AND q % 4 = 1 THEN q::DOUBLE::VARCHAR END AS systolic, CASE WHEN resource_type = 'Observation' AND q % 4 = 2 THEN (q + 0.5)::DOUBLE::VARCHAR || '%' END AS quantity, CASE WHEN resource_type = 'Observation' AND q % 4 = 0 THEN result END AS text,
    CASE WHEN resource_type = 'Observation' AND q % 4 = 3 THEN (assertion <> 'absent')::VARCHAR END AS seen, CASE WHEN site IS NOT NULL AND resource_type IN ('ServiceRequest', 'Procedure', 'Condition', 'Observation') THEN concat_ws(' ', laterality, site) END AS body_site,
    CASE WHEN resource_type = 'Condition' THEN CASE WHEN clinical_status = 'resolved' THEN 'resolved' WHEN assertion = 'present' AND temporality = 'current' THEN 'active' END END AS clinical,
    CASE WHEN resource_type = 'Condition' THEN CASE assertion WHEN 'absent' THEN 'refuted' WHEN 'suspected' THEN 'provisional' ELSE 'confirmed' END END AS verified,
    CASE WHEN resource_type IS NOT NULL THEN concat_ws('; ', 'Source: ' || term, 'site: ' || site, 'laterality: ' || laterality, 'result: ' || result, 'color: ' || color, 'relativeTime: ' || relative_time, 'Evidence: ' || e1, 'Evidence: ' || e2) END AS note FROM z""",
    "codings", "parts", "types", **_RESOURCE,
)
def coding_resources(t: Tables) -> DataFrame:
    """Every coding's resource, read back from its JSON, which is parsed once."""
    code = "coding array<struct<code string>>"
    read = f"status string, code struct<{code}>, medicationCodeableConcept struct<{code}>, condition array<struct<code struct<{code}>>>, relationship struct<text string>, component array<struct<valueQuantity struct<value string>>>, valueQuantity struct<value string, unit string>, valueString string, valueBoolean string, bodySite string, clinicalStatus struct<{code}>, verificationStatus struct<{code}>, note array<struct<text string>>"
    rows = C.resource_json(with_roles(t)).select("note_id", "pos", "concept_id", "resource_type", F.from_json("resource", read).alias("r"))
    r = F.col("r")
    first = lambda concept: F.get(concept["coding"], F.lit(0))["code"]
    # an observation's site is an object, the others' a list: it stays JSON until it is asked
    site = F.when(r["bodySite"].isNotNull(), F.coalesce(F.get_json_object(r["bodySite"], "$[0].text"), F.get_json_object(r["bodySite"], "$.text")))
    return rows.select(
        "note_id", "pos", "concept_id", "resource_type", r["status"].alias("status"), F.coalesce(first(r["code"]), first(r["medicationCodeableConcept"]), first(F.get(r["condition"], F.lit(0))["code"])).alias("code"), r["relationship"]["text"].alias("relation"), F.get(r["component"], F.lit(0))["valueQuantity"]["value"].alias("systolic"),
        F.concat(r["valueQuantity"]["value"], r["valueQuantity"]["unit"]).alias("quantity"), r["valueString"].alias("text"), r["valueBoolean"].alias("seen"), site.alias("body_site"),
        first(r["clinicalStatus"]).alias("clinical"), first(r["verificationStatus"]).alias("verified"), F.get(r["note"], F.lit(0))["text"].alias("note"),
    )


_PATIENT = "assertion = 'present' AND subject = 'patient' AND clinical_status IS DISTINCT FROM 'resolved'"
_VIEWS = {"problems": f"{_PATIENT} AND code_role = 'diagnosis'", "procedures": f"{_PATIENT} AND code_role = 'procedure'", "medications": f"{_PATIENT} AND code_role = 'medication'", "family": "subject = 'family'", "ruledout": "assertion = 'absent'", "corpus": _PATIENT}


@query("output_lenses", " UNION ALL ".join(f"SELECT '{k}' AS lens, count(*) AS n, count(DISTINCT note_id) AS notes FROM r WHERE status = 'accepted' AND {v}" for k, v in _VIEWS.items()), "codings", "parts", "types", **_FACTS, r=f"SELECT *, {_ROLE} AS code_role FROM f")
def output_lenses(t: Tables) -> DataFrame:
    shown = F.array_compact(F.array(*(F.when(C.lens(name), name) for name in C.LENSES)))
    return with_roles(t).select("note_id", F.explode(shown).alias("lens")).groupBy("lens").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("note_id").alias("notes"))


@query("coding_targets", "SELECT note_id, line::INT AS line, concept_id, tag, target, array_to_string(up, ',') AS up FROM (SELECT c.note_id, c.line, c.concept_id, CASE c.type_id::INT % 3 WHEN 0 THEN 'finding' WHEN 1 THEN 'disorder' ELSE 'procedure' END AS tag, CASE WHEN subject = 'family' THEN 'FamilyMemberHistory.condition.code' WHEN line % 2 = 0 AND c.type_id::INT % 3 = 0 THEN 'Observation.code' WHEN line % 2 = 0 THEN 'Condition.code' ELSE 'Procedure.code' END AS target, [concept_id, brand_id, type_id, '900000'] AS up FROM codings c)", "codings")
def coding_targets(t: Tables) -> DataFrame:
    tags = F.element_at(F.array(*map(F.lit, ("finding", "disorder", "procedure"))), (F.col("type_id").cast("int") % 3 + 1).cast("int"))
    known = t.parts.select("concept_id", tags.alias("tag"), F.array("concept_id", "brand_id", "type_id", F.lit("900000")).alias("ancestor_ids"))
    rows = t.codings.withColumn("target", F.when(F.col("line") % 2 == 0, "Condition.code").otherwise("Procedure.code"))
    return C.with_targets(rows, known).select("note_id", "line", "concept_id", "tag", "target", F.array_join("ancestor_ids", ",").alias("up"))


@query("coding_ancestry", "SELECT concept_id, string_agg(DISTINCT a, ',' ORDER BY a) AS ancestors FROM (SELECT concept_id, concept_id AS a FROM codings UNION ALL SELECT c.concept_id, l.ancestor_id FROM codings c JOIN closure l USING (concept_id)) GROUP BY concept_id", "codings", "closure")
def coding_ancestry(t: Tables) -> DataFrame:
    return C.stamp_ancestry(t.codings.select("concept_id").distinct(), t.closure).select("concept_id", F.array_join("ancestor_ids", ",").alias("ancestors"))


@query("stored_verification", "SELECT note_id, concept_id, CASE WHEN line % 5 = 0 THEN 'missing' ELSE 'ancestry' END AS problem FROM (SELECT DISTINCT note_id, concept_id, assertion, subject, line FROM codings WHERE l_quantity::INT % 10 < 2) WHERE line % 5 = 0 OR line % 5 = 1", "codings")
def stored_verification(t: Tables) -> DataFrame:
    """Expected codings against a table that lacks some and holds others with fewer ancestors."""
    expected = t.codings.where(F.col("l_quantity").cast("int") % 10 < 2).select("note_id", F.concat_ws("-", "concept_id", "line").alias("concept_id"), "assertion", "subject", "ancestor_ids", "line").distinct()
    held = expected.where("line % 5 <> 0").withColumn("ancestor_ids", F.when(F.col("line") % 5 == 1, F.slice("ancestor_ids", 1, 2)).otherwise(F.reverse("ancestor_ids")))
    return Q.stored_differences(expected, held).select("note_id", F.split_part("concept_id", F.lit("-"), F.lit(1)).alias("concept_id"), "problem")


# ---- functions


_WORDS = "SELECT p_partkey, p_name, p_type, p_brand, p_size, {tags}[p_size % 10 + 1] AS tag FROM part"
_SPANISH = ("Trastorno ", "hallazgo", "evento", "anomalia morfológica", "estructura corporal", "Procedimiento", "regimen/tratamiento", "producto medicinal", "presentación farmacéutica", "specimen")
_ENGLISH = ("disorder", "finding", "event", "morphologic abnormality", "body structure", "procedure", "regime/therapy", "product", "product", "specimen")
_KINDS = ("clinical", "clinical", "evento", "anomalia morfologica", "estructura corporal", "procedimiento", "regimen tratamiento", "medication", "presentacion farmaceutica", "specimen")


@query(
    "text_functions",
    f"""SELECT p_partkey, p_type AS tag_of, p_name AS bare, lower(replace(p_name, ' ', '-')) AS slug, {list(_ENGLISH)}[p_size % 10 + 1] AS english, {list(_KINDS)}[p_size % 10 + 1] AS kind, array_to_string(list_distinct_in_order, '|') AS variants,
    CASE WHEN p_size % 2 = 0 THEN 'es' ELSE 'en' END AS language, '0:' || length(split_part(p_name, ' ', 1)) || ',' || (length(split_part(p_name, ' ', 1)) + 3) || ':' || (length(p_name) + 2) AS offsets
    FROM (SELECT *, CASE WHEN p_size % 3 > 0 THEN [p_name] WHEN ends_with(p_name, ' rod') THEN [p_name || 's'] WHEN ends_with(p_name, 'e') THEN [p_name || 's', p_name[:-2]] ELSE [p_name || 's', p_name] END AS list_distinct_in_order FROM part)""",
)
def text_functions(t: Tables) -> DataFrame:
    size = F.col("p_size")
    tag = F.element_at(F.array(*map(F.lit, _SPANISH)), (size % 10 + 1).cast("int"))
    fsn = F.concat("p_name", F.lit(" ("), "p_type", F.lit(") "))
    asked = F.when(size % 3 == 0, F.concat(F.upper("p_name"), F.lit("s"))).otherwise(F.col("p_name"))
    text = F.when(size % 2 == 0, F.concat(F.lit("dolor con "), "p_name")).otherwise(F.concat(F.lit("patient with pain, "), "p_name"))
    spaced = F.replace("p_name", F.lit(" "), F.lit(" — "))
    places = F.array_join(F.transform(X.tokens_with_offsets(spaced), lambda w: F.concat_ws(":", w["start"].cast("string"), w["end"].cast("string"))), ",")
    return t.table("part").select("p_partkey", X.semantic_tag(fsn).alias("tag_of"), X.without_tag(fsn).alias("bare"), X.slug(F.col("p_name")).alias("slug"), X.english_tag(tag).alias("english"), X.clinical_kind(tag).alias("kind"), F.array_join(X.variants(asked), "|").alias("variants"), X.detect_language(text, F.lit("en")).alias("language"), places.alias("offsets"))


@query("record_functions", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'arm' ELSE p_brand END AS site, p_size::VARCHAR AS value, p_size % 2 = 0 AS preferred, '900000000000508004,900000000000509007' AS refsets, CASE WHEN p_size % 3 < 2 THEN '{\"a\":' || p_size || '}' END AS parsed, p_name AS code, p_size % 4 = 0 AS same, left(sha256('[\"' || p_name || '\",\"' || p_size || '\"]'), 12) AS fingerprint FROM part")
def record_functions(t: Tables) -> DataFrame:
    size = F.col("p_size")
    raw = F.map_from_arrays(F.array(F.lit("Sitio anatómico"), F.lit("Valor"), F.lit("SITIO")), F.array(F.col("p_brand"), size.cast("string"), F.when(size % 2 == 0, F.lit("arm")).otherwise(F.col("p_brand"))))
    kept = R.attributes(raw)
    accepted = F.map_from_arrays(F.array(F.lit("900000000000509007"), F.lit("900000000000508004")), F.array(F.when(size % 2 == 0, "900000000000548007").otherwise("900000000000549004"), F.lit("900000000000549004")))
    body = F.concat(F.lit('{"a": '), size.cast("string"), F.lit("}"))
    text = F.when(size % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone"))).when(size % 3 == 1, F.concat(F.lit("so "), body, F.lit(" it is"))).otherwise(F.lit("{nothing"))
    field = lambda name, **v: F.struct(F.lit(name).alias("name"), *(v.get(k, F.lit(None).cast("boolean" if k == "valueBoolean" else "string")).alias(k) for k in R.VALUE_KINDS))
    request = R.request_map(F.array(field("system", valueUri=F.lit("s")), field("code", valueCode=F.lit("x")), field("code", valueString=F.col("p_name"))))
    same = R.equality_key(F.when(size % 4 == 0, "a"), F.lit(1)) == R.equality_key(F.lit("a"), F.lit(1))
    return t.table("part").select("p_partkey", kept["site"].alias("site"), kept["value"].alias("value"), R.is_preferred(accepted, "900000000000548007").alias("preferred"), F.array_join(R.refset_ids(accepted), ",").alias("refsets"), R.loose_json(text).alias("parsed"), request["code"].alias("code"), same.alias("same"), F.substring(X.request_fingerprint(F.col("p_name"), size), 1, 12).alias("fingerprint"))


@query("date_reference", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '1998-08-02 12:00:00' ELSE max(o_orderdate) + INTERVAL 2 DAY END AS reference FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def date_reference(t: Tables) -> DataFrame:
    """The reference date of each customer's orders; every fourth has none of its own."""
    latest = t.table("customer").join(t.table("orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey").agg(F.max("o_orderdate").alias("latest"))
    own = F.when(F.col("c_custkey") % 4 != 0, F.col("latest"))
    return latest.select("c_custkey", R.date_reference(own, F.lit("1998-08-02 12:00:00").cast(latest.schema["latest"].dataType)).alias("reference"))
