import json

from pyspark.sql import functions as F

from termloom.functions.records import attributes
from termloom.operators import codings as C
from termloom.operators import grounding as G
from termloom.operators import mapping as M
from termloom.plans import catalog

SCHEMA = "note_id int, pos int, concept_id string, term string, phrase string, assertion string, subject string, temporality string, workflow string, kind string, clinical_status string, role string, attributes map<string,string>, ancestor_ids array<string>, evidence array<string>, accepted boolean, code_role string"


def coding(pos, concept, **other):
    row = dict(note_id=1, pos=pos, concept_id=concept, term=concept, phrase=None, assertion="present", subject="patient", temporality="current", workflow=None, kind="condition", clinical_status=None, role="secondary", attributes={}, ancestor_ids=[concept], evidence=[f"e{pos}"], accepted=False, code_role="diagnosis") | other
    return tuple(row[x.split()[0]] for x in SCHEMA.split(", "))


def test_merging_keeps_what_differs(spark):
    rows = [coding(0, "a", attributes={"Sitio": "arm", "color": "red"}), coding(1, "a", attributes={"sitio anatómico": "arm", "color": "blue", "size": "2"}, accepted=True, role="principal", evidence=["e0", "x"]), coding(2, "a", attributes={"site": "leg"}), coding(3, "a", kind=None)]
    merged = {r.pos: r for r in C.merge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sorted(merged) == [0, 2, 3]
    first = merged[0]
    assert first.attributes == {"site": "arm", "color": "red", "size": "2"} and first.conflicts == {"color": ["red", "blue"]}
    assert first.evidence == ["e0", "x"] and first.accepted and first.role == "principal"


def test_only_plain_present_conditions_are_covered(spark):
    child = dict(ancestor_ids=["child", "parent", "top"])
    cases = {
        "covered": ([coding(0, "parent", attributes={"size": "1"}), coding(1, "child", **child)], ["child"]),
        "absent": ([coding(0, "parent", assertion="absent"), coding(1, "child", assertion="absent", **child)], ["child", "parent"]),
        "family": ([coding(0, "parent", subject="family"), coding(1, "child", subject="family", **child)], ["child", "parent"]),
        "principal": ([coding(0, "parent", role="principal"), coding(1, "child", **child)], ["child", "parent"]),
        "other site": ([coding(0, "parent", attributes={"site": "arm"}), coding(1, "child", **child)], ["child", "parent"]),
        "other kind": ([coding(0, "parent", kind="procedure"), coding(1, "child", kind="procedure", **child)], ["child", "parent"]),
        "kindless": ([coding(0, "parent", kind=None), coding(1, "child", kind=None, **child)], ["child"]),
        "deepest": ([coding(0, "top"), coding(1, "parent", ancestor_ids=["parent", "top"]), coding(2, "child", **child)], ["child"]),
    }
    for name, (rows, want) in cases.items():
        out = C.drop_covered(C.merge(spark.createDataFrame(rows, SCHEMA))).collect()
        assert sorted(r.concept_id for r in out) == want, name
        if name == "covered":
            assert out[0].attributes == {"size": "1"} and out[0].evidence == ["e1", "e0"]
        if name == "deepest":
            assert sorted(out[0].evidence) == ["e0", "e1", "e2"]


def test_resources(spark):
    rows = [
        coding(0, "a", attributes={"sitio": "arm", "laterality": "left", "stage": "II"}, phrase="said"), coding(1, "b", subject="family", attributes={"relative": "mother"}), coding(2, "c", kind="observation", attributes={"valor": "120/80 mmHg", "site": "arm"}, workflow="completed"),
        coding(3, "d", kind="observation", attributes={"result": "-3.5 %"}), coding(4, "e", code_role="procedure", workflow="planned"), coding(5, "f", code_role="medication", attributes={"dosis": "5 mg", "via": "oral"}, workflow="continuation"), coding(6, "g", workflow="discussion"), coding(7, "h", code_role="other"),
        coding(8, "i", kind="observation", assertion="absent"),
    ]
    out = {r.concept_id: json.loads(r.resource) if r.resource else None for r in C.resource_json(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out["a"]["resourceType"] == "Condition" and out["a"]["bodySite"] == [{"text": "left arm"}] and out["a"]["stage"] == [{"summary": {"text": "II"}}] and out["a"]["clinicalStatus"]["coding"][0]["code"] == "active"
    assert out["a"]["note"][0]["text"].startswith("Source: said; ") and "status" not in out["a"]
    assert out["b"]["relationship"] == {"text": "mother"} and out["b"]["condition"][0]["code"]["text"] == "b" and "code" not in out["b"]
    assert [c["valueQuantity"]["value"] for c in out["c"]["component"]] == [120.0, 80.0] and out["c"]["status"] == "final" and out["c"]["bodySite"] == {"text": "arm"}
    assert out["d"]["valueQuantity"] == {"value": -3.5, "unit": "%", "system": C.UNIT_SYSTEM, "code": "%"} and out["i"]["valueBoolean"] is False
    assert out["e"]["resourceType"] == "ServiceRequest" and out["e"]["intent"] == "proposal"
    assert out["f"]["dosage"] == [{"text": "5 mg; oral", "route": {"text": "oral"}, "doseAndRate": [{"doseQuantity": {"value": 5.0, "unit": "mg"}}]}] and out["f"]["status"] == "active"
    assert out["g"] is None and out["h"] is None


def test_translation_resources(spark):
    schema = "concept_id string, refset_id string, target_system string, map_target string, map_group int, map_priority int, map_rule string, map_advice string"
    rows = [("1", "r", "icd", "B", 2, 1, "IFA AGE < 18", "Check age"), ("1", "r", "icd", "A", 1, 0, "TRUE", None)] + [("2", "r", "icd", f"C{k:03d}", 1, 1, "TRUE", None) for k in range(120)]
    codes = spark.createDataFrame([("1",), ("2",), ("3",)], "concept_id string")
    out = {r.concept_id: json.loads(r.resource)["parameter"] for r in M.parameters_json(codes, spark.createDataFrame(rows, schema)).collect()}
    assert out["3"] == [{"name": "result", "valueBoolean": False}, {"name": "message", "valueString": M.NO_MAPPING}]
    assert out["1"][1]["valueString"] == M.CONDITIONAL and [p["part"][1]["valueCoding"]["code"] for p in out["1"][2:]] == ["A", "B"]
    assert out["1"][3]["extension"] == [{"url": f"{M.EXTENSION}group", "valueInteger": 2}, {"url": f"{M.EXTENSION}priority", "valueInteger": 1}, {"url": f"{M.EXTENSION}rule", "valueString": "IFA AGE < 18"}, {"url": f"{M.EXTENSION}advice", "valueString": "Check age"}]
    assert len(out["2"]) == 102 and out["2"][1]["valueString"] == M.PUBLISHED + M.TRUNCATED


def test_reviewers_decisions_stand_up_to_the_source(spark):
    candidate = [("c", "finding", "Absence of fever")]
    entries = [(f"m{k}", kind, assertion, status, "has fever today", "fever", attributes, candidate) for k, (kind, assertion, status, attributes) in enumerate([("condition", "present", "anchored", {}), ("condition", "absent", "anchored", {}), ("condition", "present", "unanchored", {}), ("symptom", "present", "anchored", {"compatible": "flu"}), ("context", "present", "anchored", {}), ("medication", "present", "anchored", {})])]
    entries = spark.createDataFrame(entries, "mention_id string, kind string, assertion string, evidence_status string, sentence string, verbatim string, attributes map<string,string>, candidates array<struct<concept_id:string,tag:string,description:string>>")
    made = [(f"m{k}", "c", "equivalent", ["fever"], []) for k in range(6)]
    made[4] = ("m4", "other", "equivalent", ["fever"], [])
    out = {r.mention_id: (r.status, r.reason) for r in G.verified(entries, spark.createDataFrame(made, "mention_id string, concept_id string, relation string, quotes array<string>, missing array<string>")).collect()}
    assert out["m0"][0] == "accepted" and out["m1"] == ("abstain", "no-source-supported-candidate") and out["m2"][0] == out["m3"][0] == "review"
    assert out["m4"] == ("abstain", "invalid-semantic-evidence") and out["m5"][0] == "abstain"


def test_nothing_is_accepted_without_a_whole_description(spark):
    mentions = spark.createDataFrame([("m1", "foot ulcer", 2, "present", False, "condition"), ("m2", "foot ulcer", 2, "present", False, "condition"), ("m3", "lost", 1, "present", False, None)], "mention_id string, phrase string, n_tokens int, assertion string, relation_cue boolean, kind string")
    rows = [("m1", 1, "a", "Foot ulcer", "Foot ulcer", ["Foot ulcer"], "disorder", 1, True, 30, 100.0, None, True), ("m1", 2, "b", "Foot ulcer heel", "", ["Foot ulcer heel"], "disorder", 6, False, 10, 1.0, None, True), ("m2", 1, "b", "Foot ulcer heel", "", ["Foot ulcer heel"], "disorder", 2, True, 30, 100.0, None, True), ("m2", 2, "p", "Foot ulcer", "", ["Foot ulcer"], "procedure", 1, True, 30, 100.0, None, True)]
    candidates = spark.createDataFrame(rows, "mention_id string, pos int, concept_id string, term string, matched string, descriptions array<string>, tag string, tier int, preferred boolean, rank int, search_score double, rerank_score double, active boolean")
    out = {r.mention_id: r for r in G.grounded(mentions, candidates).collect()}
    assert (out["m1"].status, out["m1"].concept_id, out["m1"].reasons) == ("accepted", "a", ["exact-clinical-match"])
    assert (out["m2"].status, out["m2"].concept_id) == ("review", "b") and "full-description-match-not-established" in out["m2"].reasons
    assert (out["m3"].status, out["m3"].reasons, out["m3"].concept_id) == ("abstain", ["no-candidate"], None)
    assert out["m1"].confidence <= 1.0 and F is not None


def test_linked_mentions_need_both_sides_and_two_words(spark):
    sentence = "Acute kidney injury on chronic kidney injury with cough"
    rows = [(1, f"m{k}", "condition", "present", "current", "patient", sentence, phrase) for k, phrase in enumerate(("acute kidney injury", "chronic kidney injury", "cough"))]
    found = G.linked_mentions(spark.createDataFrame(rows, "note_id int, mention_id string, kind string, assertion string, temporality string, experiencer string, sentence string, phrase string"))
    assert sorted((r.mention_id, r.partner_id) for r in found.collect()) == [("m0", "m1"), ("m1", "m0")]


def test_a_fact_may_take_over_several(spark):
    rows = [coding(0, "top"), coding(1, "parent", ancestor_ids=["parent", "top"]), coding(2, "child", ancestor_ids=["child", "parent", "top"]), coding(3, "other")]
    out = C.drop_covered(C.merge(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted((r.concept_id, r.taken) for r in out) == [("child", 2), ("other", 0)]


def test_resources_are_made_in_parallel_and_read_once(spark, data):
    plan = catalog.QUERIES["coding_resources"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Generate explode([true,false])" in plan
    assert plan.count("from_json") + plan.count("JsonToStructs") > 0 and plan.count("get_json_object") < 10


def test_attribute_names_with_and_without_signs(spark):
    raw = spark.sql("SELECT map('Sitio', 'a', 'sitio anatómico', 'b', 'color', null, 'relative_time', 'x', 'RelativeTime', 'y', 'SITE', 'c') AS m UNION ALL SELECT null UNION ALL SELECT map('Vía', 'y', 'no-name', 'z')")
    kept = [r[0] for r in raw.select(attributes(F.col("m"))).collect()]
    assert kept == [{"site": "b", "color": None, "relativeTime": "y", "SITE": "c"}, {}, {"route": "y", "no-name": "z"}]


def test_merging_sorts_facts_once_and_carries_no_names(spark, data):
    plan = catalog.QUERIES["coding_merge"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "term#" not in plan and plan.count("Window [") == 1


def test_merging_keeps_the_order_of_equal_places(spark):
    rows = [coding(1, "a", attributes={"color": c}, evidence=[c, None], role=None) for c in ("red", "blue", "green")] + [coding(0, "a", attributes={}, evidence=None, role="other")]
    (merged,) = C.merge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert (merged.pos, merged.role, merged.attributes, merged.conflicts) == (0, "other", {"color": "blue"}, {"color": ["blue", "red"]})
    assert merged.evidence == ["blue", None, "green", "red"]
