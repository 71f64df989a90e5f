from datetime import datetime

import pytest
from pyspark.sql import functions as F

from termloom.plans.cohort import Filters, Group, Leaf, Plan, PlanError, cohort, leaves, parse_command, parse_question, validate_filters, validate_ids, validate_plan
from termloom.plans.broad_scope import broad_scope
from termloom.plans.ecl import Attribute, Concept, EclError, EclSpace, Refined, SetOp, parse, scope, validate


def test_or_is_weaker_than_and():
    assert parse("1 OR 2 AND 3") == SetOp("OR", Concept("1"), SetOp("AND", Concept("2"), Concept("3")))


def test_and_and_minus_go_left_to_right():
    assert parse("1 AND 2 MINUS 3") == SetOp("MINUS", SetOp("AND", Concept("1"), Concept("2")), Concept("3"))


def test_refinement_takes_and():
    assert parse("<< 1 : 2 = 3, 4 = << 5") == Refined(Concept("1", "<<"), SetOp("AND", Attribute("2", Concept("3")), Attribute("4", Concept("5", "<<"))))
    assert validate("<< 1 : 2 = 3 AND << 4")[0] is None
    assert validate("(<< 1 : 2 = 3) AND << 4")[1] is None


@pytest.mark.parametrize("text", ["<< 1 NOT 2", "<<", "1 AND", "(1", "1)", "1 # 2", ""])
def test_bad_expressions(text):
    tree, error = validate(text)
    assert tree is None and error


@pytest.fixture
def space(spark):
    concepts = spark.createDataFrame([("1", True), ("2", True), ("3", False), ("4", True)], "concept_id string, active boolean")
    closure = spark.createDataFrame([("2", "1", 1), ("3", "1", 1), ("4", "2", 1), ("4", "1", 2)], "concept_id string, ancestor_id string, depth int")
    attributes = spark.createDataFrame([("2", "9", "4"), ("3", "9", "4")], "source_id string, type_id string, destination_id string")
    return EclSpace(concepts, closure, attributes)


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_evaluation(space):
    assert ids(space.compile("<< 1")) == ["1", "2", "4"]
    assert ids(space.compile("< 1")) == ["2", "4"]
    assert ids(space.compile("<< 999")) == ["999"]
    assert ids(space.compile("<< 1 : 9 = 4")) == ["2"]
    assert ids(scope(space.compile("<< 1 MINUS << 1"))) == []


def test_size_guard(space):
    with pytest.raises(EclError):
        space.expand("1 OR 2 OR 4", most=2)


def test_question_precedence_and_exclusion():
    plan = parse_question("diabetes and kidney disease or heart failure but without pneumonia")
    assert plan.root.kind == "any" and len(leaves(plan.root)) == 4
    assert [x.exclude for x in leaves(plan.root)] == [False, False, False, True]
    assert [x.name for x in leaves(plan.root)] == ["c1", "c2", "c3", "c4"]


def test_question_prefixes():
    assert parse_question("documented absence of pneumonia").root == Leaf("pneumonia", "absent", name="c1")
    assert parse_question("family history of asthma").root.subject == "family"


def test_question_filters_in_both_languages():
    assert parse_question("show notes from the last 30 days for women over 60 with diabetes") == Plan(Leaf("diabetes", name="c1"), Filters(61, None, 30, "female"))
    assert parse_question("mujeres de 40 a 70 años").filters == Filters(40, 70, None, "female")


GOLDEN = {
    "Find notes with diabetes and kidney disease or heart failure but without pneumonia": [("diabetes", "present", "patient", False), ("kidney disease", "present", "patient", False), ("heart failure", "present", "patient", False), ("pneumonia", "present", "patient", True)],
    "Find notes with documented absence of pneumonia": [("pneumonia", "absent", "patient", False)],
    "heart failure and a history of myocardial infarction and a family history of breast cancer and planned radiotherapy": [("heart failure", "present", "patient", False), ("myocardial infarction", "historical", "patient", False), ("breast cancer", "present", "family", False), ("radiotherapy", "planned", "patient", False)],
    "suspected pneumonia but without confirmed pneumonia": [("pneumonia", "suspected", "patient", False), ("pneumonia", "present", "patient", True)],
    "Find emergency notes with confirmed asthma": [("asthma", "present", "patient", False)],
    "asthma but not gout": [("asthma", "present", "patient", False), ("gout", "present", "patient", True)],
    "diabetes excepto asma": [("diabetes", "present", "patient", False), ("asma", "present", "patient", True)],
    "diabetes except asthma": [("diabetes", "present", "patient", False), ("asthma", "present", "patient", True)],
    "cirugía programada": [("cirugía", "planned", "patient", False)],
    "about asthma": [("asthma", "present", "patient", False)],
    "confirmed pneumonia": [("pneumonia", "present", "patient", False)],
    "documented no pneumonia": [("pneumonia", "absent", "patient", False)],
    "neumonía confirmada y ausencia documentada de asma": [("neumonía", "present", "patient", False), ("asma", "absent", "patient", False)],
}


@pytest.mark.parametrize("text", GOLDEN)
def test_question_forms(text):
    assert [(x.phrase, x.assertion, x.subject, x.exclude) for x in leaves(parse_question(text).root)] == GOLDEN[text]


def test_question_settings_and_groups():
    assert parse_question("Find emergency notes with asthma").filters == Filters(setting="emergency")
    assert parse_question("Busca notas de atención primaria de los últimos 30 días con asma").filters == Filters(since_days=30, setting="primary-care")
    plan = parse_question("Find notes with (diabetes or heart failure) and kidney disease but without pneumonia").root
    assert plan.kind == "all" and plan.children[0].kind == "any" and plan.children[2].exclude
    assert parse_question("Busca notas de mujeres de 40 a 70 años con diabetes e hipertensión").filters == Filters(40, 70, None, "female")


def test_commands_and_prose():
    assert parse_command("Find notes with diabetes").root == Leaf("diabetes", name="c1")
    for text in ("Which records describe patients taking metformin with impaired kidney function?", "Find notes with diabetes requiring insulin", "Find notes with heart failure with reduced ejection fraction", "diabetes", "Find emergency notes", "Find notes with diabetes and"):
        assert parse_command(text) is None


def families(spark, phrase, *rows):
    schema = "phrase string, pos int, concept_id string, term string, tag string, descriptions array<string>, ancestor_ids array<string>, rerank_score double"
    df = spark.createDataFrame([(phrase, k, *r) for k, r in enumerate(rows)], schema)
    return [r.concept_id for r in broad_scope(df).collect()]


def test_broad_scopes(spark):
    one = lambda c, term, up, score, tag=None, terms=None: (c, term, tag, terms or [term], up, score)
    assert families(spark, "hypertension", one("59621000", "Essential hypertension", ["38341003"], 0.8), one("38341003", "Hypertensive disorder", [], 0.7, None, ["Hypertension"]), one("31992008", "Secondary hypertension", ["38341003"], 0.7)) == ["38341003"]
    assert families(spark, "type 2 diabetes mellitus", one("44054006", "Type 2 diabetes mellitus", ["73211009"], 0.9), one("73211009", "Diabetes mellitus", [], 0.85)) == ["44054006"]
    assert families(spark, "azúcar alta en sangre", one("80394007", "Hiperglucemia", [], 0.8, "trastorno"), one("73211009", "Diabetes mellitus", [], 0.76, "trastorno"), one("12345678", "Subtipo", ["80394007"], 0.75, "trastorno")) == ["80394007"]
    assert families(spark, "unrecognized", one("12345678", "Unrelated", [], 0.1)) == []
    assert families(spark, "renal impairment", one("12345678", "Unrelated finding", [], None, "finding"), one("56789012", "Persistent renal impairment", [], None, "finding")) == ["56789012"]
    assert families(spark, "enfermedad de las arterias coronarias", one("414545008", "Enfermedad coronaria", [], 0.82, "trastorno"), one("53741008", "Arteriosclerosis coronaria", ["414024009"], 0.81, "trastorno"), one("371803003", "Enfermedad de múltiples arterias coronarias", ["53741008", "414024009"], 0.80, "trastorno"), one("414024009", "Trastorno de arteria coronaria", [], 0.77, "trastorno")) == ["414545008", "53741008"]


@pytest.mark.parametrize("text", ["diabetes and", "diabetes or ()", "(diabetes", "diabetes)", "", "and"])
def test_bad_questions(text):
    with pytest.raises(PlanError):
        parse_question(text)


@pytest.mark.parametrize("raw", [{"minAge": {"$gt": 0}}, {"sinceDays": 0}, {"sinceDays": 5000}, {"minAge": 9, "maxAge": 3}, {"$where": "1"}, {"sex": "x"}])
def test_hostile_filters(raw):
    with pytest.raises(PlanError):
        validate_filters(raw)


@pytest.mark.parametrize("raw", [{"all": [{"phrase": "x"}] * 11}, {"all": [], "any": []}, {"phrase": {"$ne": 1}}, {"phrase": "x", "assertion": "maybe"}, {"all": [{"phrase": "x"}], "phrase": "y"}])
def test_hostile_plans(raw):
    with pytest.raises(PlanError):
        validate_plan(raw)


def test_ids():
    assert validate_ids(["500013", "500013"]) == ["500013"]
    with pytest.raises(PlanError):
        validate_ids(["5x"])


CODING = "array<struct<concept_id:string,ancestor_ids:array<string>,assertion:string,subject:string,status:string,temporality:string>>"


def test_all_conditions_hold_on_one_coding(spark):
    right = ("600001", ["600001", "500001"], "present", "patient", "accepted", "current")
    split = [("600001", ["600001", "500001"], "absent", "patient", "accepted", "current"), ("600002", ["600002", "500002"], "present", "patient", "accepted", "current")]
    rows = [(1, "demo", [right]), (2, "demo", split), (3, "demo", []), (4, "other", [right])]
    notes = spark.createDataFrame(rows, f"note_id int, tenant_id string, codings {CODING}")
    yes = cohort(Plan(Leaf("x", name="c1")), {"c1": ["500001"]}, datetime(2024, 1, 1))
    no = cohort(Plan(Group("all", (Leaf("x", exclude=True, name="c1"),))), {"c1": ["500001"]}, datetime(2024, 1, 1))
    assert ids(notes.where(yes).select("note_id")) == [1]
    assert ids(notes.where(no).select("note_id")) == [2, 3]


def test_window_includes_both_ends(spark):
    rows = [(1, "2026-07-31 12:00:00"), (2, "2026-10-29 12:00:00"), (3, "2026-07-31 11:59:59"), (4, "2026-10-29 12:00:01")]
    notes = spark.createDataFrame(rows, "note_id int, at string").select("note_id", F.lit("demo").alias("tenant_id"), F.col("at").cast("timestamp_ntz").alias("occurred_at"))
    assert ids(notes.where(cohort(Plan(None, Filters(since_days=90)), {}, datetime(2026, 10, 29, 12))).select("note_id")) == [1, 2]
