from pyspark.sql import functions as F

from termloom.operators import anchoring as A
from termloom.operators import diagnosis as D
from termloom.operators.evaluate import contract_violations, ranked_diagnoses
from termloom.operators import notes as N
from termloom.operators.grounding import candidate_score
from termloom.sources.corpus import synthetic_notes


def test_anchors_take_the_next_free_occurrence(spark):
    text = "Reason: asthma. HPI: asthma. Family: father with asthma."
    notes = spark.createDataFrame([(1, text), (2, None)], "note_id int, text string")
    mentions = spark.createDataFrame([(1, 0, "asthma"), (1, 1, "Asthma"), (1, 2, "asthma"), (1, 3, "gout"), (2, 0, "x")], "note_id int, pos int, phrase string")
    rows = A.anchored(notes, mentions, "note_id").orderBy("note_id", "pos").collect()
    assert [r.start for r in rows] == [8, 21, 49, None, None]
    assert all(text[r.start : r.end].lower() == "asthma" for r in rows[:3]) and rows[3].evidence == "unanchored"


def test_windows_lose_nothing(spark):
    for text in ("One two. Three four.\nFive six seven eight nine ten. Eleven", "", "x" * 100, "a b. " * 30, "\n\n\n" * 20):
        pieces = A.extraction_windows(text, 27)
        assert "".join(pieces) == text and (not text.strip() or all(p.strip() for p in pieces))
    df = spark.createDataFrame([(1, "One two. Three four. " * 5)], "k0 int, text string")
    assert "".join(r.window for r in A.window_rows(df, "k0", "text", 27).orderBy("k").collect()) == "One two. Three four. " * 5


def test_anchors_keep_to_sentence_window_and_section():
    text = "Reason for visit: cough. HPI: cough for days.\nPast medical history: cough, known asthma\nPlan: cough syrup"
    one = lambda **m: A.anchor_note(text, [{"phrase": "cough", **m}])[0]
    assert one(section="HPI")["start"] == text.index("cough for") and one(section="plan")["start"] == text.index("cough syrup")
    assert one(sentence="cough for days.")["start"] == text.index("cough for") and one(window=(40, 90))["start"] == text.index("cough, known")
    assert one(start=text.index("cough syrup"), end=text.index("cough syrup") + 5, section="HPI")["start"] == text.index("cough syrup")
    stated = dict(subject="patient", assertion="present", temporality="current", kind="condition")
    twice = A.anchor_note(text, [{"phrase": "cough", **stated}, {"phrase": "cough", **stated}, {"phrase": "cough", **stated, "assertion": "absent"}])
    assert [m["start"] for m in twice] == [18, 30, 18]
    past = A.anchor_note("Past medical history: gout", [{"phrase": "gout", **stated}])[0]
    assert (past["temporality"], past["reasons"]) == ("unknown", ["background-activity-not-stated"])
    assert A.anchor_note("Past medical history: active gout", [{"phrase": "gout", **stated}])[0]["temporality"] == "current"
    gone = A.anchor_note("No fever", [{"phrase": "fever", "assertion": "absent", "clinical_status": "resolved"}])[0]
    assert gone["clinical_status"] == "unknown"
    came = A.anchor_note("Chief complaint: fever", [{"phrase": "fever", "kind": "symptom", "assertion": "present", "temporality": "historical", "clinical_status": "resolved"}])[0]
    assert came["temporality"] == "current"


def test_phrase_windows():
    assert N.windows_of(["a", "b", "c"]) == [(0, 3)] and N.windows_of([]) == []
    assert N.windows_of(list("abcdef")) == [(2, 4), (0, 4)]


def test_sections():
    cut = lambda t: [(x[0], t[x[1] : x[3]]) for x in N.sections_of(t)]
    assert cut("plain text") == [("Note", "plain text")]
    assert cut("Intro. Plan: rest.\nDiagnóstico final: asma") == [("Note", "Intro."), ("Plan", " Plan: rest."), ("Diagnóstico final", "\nDiagnóstico final: asma")]
    assert N.slug_of("Past (medical) history") == "past-medical-history"


def test_context_precedence():
    rows = {"mother with asthma, no fever": "family-history", "no evidence of pneumonia, continue statin": "absent", "continue statin, possible gout": "planned", "possible gout": "suspected", "history of gout": "historical", "gout": "present", "nódulo": "present", "to rule out gout": "absent", "descartados ambos": "absent", "follow up": "planned"}
    assert {t: N.context_of(N.signals_of("Note", t, 0))[0] for t in rows} == rows
    titled = lambda title: N.context_of(N.signals_of(title, "gout", 0))[0]
    assert [titled(x) for x in ("Family history", "Past history", "Plan")] == ["family-history", "present", "planned"]
    assert [x[:2] for x in N.signals_of("Note", "gout due to salt with pain", 0)] == [("relation", "due-to"), ("relation", "associated-with")]


def test_phrases_of_a_note():
    found = N.phrases_of("Assessment: severe asthma due to dust mites. Patient has the flu")
    assert [(x[1], x[6]) for x in found] == [("severe asthma", 40), ("dust mites", 34)]
    assert N.phrases_of("") == [] and N.phrases_of("a\n" * 50) == []
    assert len(N.phrases_of("alpha beta. " * 200, 80)) == 80


def test_sentences(spark):
    df = spark.createDataFrame([(1, "A b. C!\n\nD"), (2, None), (3, " ")], "id int, t string")
    assert sorted((r.id, r.sentence) for r in N.sentences(df, "id", "t").collect()) == [(1, "A b."), (1, "C!"), (1, "D")]


def test_corpus_is_stable(spark):
    profiles = spark.createDataFrame([(f"p{k}", "x", "text", "texto") for k in range(32)], "profile_id string, specialty string, text_en string, text_es string")
    notes = synthetic_notes(spark, profiles, "demo", "2026-10-29")
    assert notes.count() == 512 and notes.select("note_id").distinct().count() == 512
    assert notes.exceptAll(synthetic_notes(spark, profiles.repartition(3), "demo", "2026-10-29")).count() == 0
    assert str(notes.where("variant = 0").first().occurred_at) == "2026-10-27 12:00:00"


def test_diagnosis_metrics(spark):
    rows = spark.createDataFrame([(1, "a", ["b", "a"], ["c"], ["c", "d"]), (2, "a", ["a"], [], []), (3, "a", [], ["c"], [])], "note_id int, expected_principal string, ranked array<string>, expected array<string>, proposed array<string>")
    assert [tuple(r) for r in ranked_diagnoses(rows).orderBy("note_id").collect()] == [(1, False, True, 0.5, 1.0), (2, True, True, 1.0, 1.0), (3, False, False, 0.0, 0.0)]


def test_contracts(spark):
    notes = spark.createDataFrame([(1, "has gout")], "note_id int, text string")
    release = spark.createDataFrame([("600001",)], "concept_id string")
    mentions = spark.createDataFrame([("m1", 1, "600001", "gout", 4, 8, "accepted"), ("m2", 1, "9", "gaut", 4, 8, "review"), ("m3", 1, None, None, None, None, "accepted")], "mention_id string, note_id int, concept_id string, verbatim string, start int, end int, status string")
    assert sorted(map(tuple, contract_violations(mentions, notes, release).collect())) == [("m2", "release"), ("m2", "span"), ("m3", "support")]


def test_candidate_score_has_all_penalties(spark):
    rows = [  # phrase, context, relation cue, term, matched text, tier, tag, score by the reference's formula
        ("foot ulcer", "present", False, "Foot ulcer", None, 4, None, 52.0),
        ("foot ulcer", "present", False, "Foot ulcer heel", None, 4, None, 21.5),
        ("foot ulcer", "present", False, "Ulcer of foot region", "foot ulcer", 4, None, 28.0),
        ("ulcer", "present", False, "Region", "ulcer", 4, None, 6.0),
        ("ulcer", "present", False, "Ulcer left foot", None, 4, None, -21.0),
        ("ulcer", "absent", False, "Ulcer left foot", None, 4, "Disorder", -20.0),
        ("foot ulcer", "present", False, "Foot ulcer screening", None, 4, None, 3.5),
        ("foot ulcer", "planned", False, "Foot ulcer screening", None, 4, None, 21.5),
        ("foot ulcer", "planned", False, "Foot ulcer follow-up", None, 4, None, 21.5),
        ("foot ulcer", "present", False, "Foot ulcer due to diabetes", None, 4, None, 15.5),
        ("foot ulcer", "present", True, "Foot ulcer due to diabetes", None, 4, None, 5.5),
        ("pain with fever", "present", False, "Pain with fever", None, 4, None, 52.0),
        ("pain with fever", "present", True, "Pain with fever", None, 4, None, 36.0),
        ("foot ulcer", "present", False, "Neonatal foot ulcer", None, 4, None, 7.5),
        ("foot ulcer", "present", False, "Severe foot ulcer", None, 4, None, 3.5),
        ("diabetes", "present", False, "Diabetes mellitus", None, 4, "trastorno", 20.0),
        ("foot ulcer", None, None, "Heel", "", None, None, -26.5),
    ]
    df = spark.createDataFrame(rows, "phrase string, ctx string, cue boolean, term string, matched string, tier int, tag string, want double")
    nothing = F.lit(None).cast("int")
    score = candidate_score(F.col("phrase"), F.size(F.split("phrase", " ")), F.col("ctx"), F.col("cue"), F.col("term"), F.col("matched"), F.col("tier"), F.lit(False), nothing, nothing, F.col("tag"))
    assert [(r.phrase, r.term, r.got) for r in df.withColumn("got", score).collect()] == [(r[0], r[3], r[7]) for r in rows]


DX = "note_id int, concept_id string, term string, tag string, ancestor_ids array<string>, active boolean, phrase string, kind string, assertion string, temporality string, clinical_status string, subject string, section string, section_start int, start int, sentence string, evidence string, decision string, reviewed boolean, confidence int"


def entry(note, concept, tag, kind, section, start=None, **other):
    row = dict(note_id=note, concept_id=concept, term=concept, tag=tag, ancestor_ids=[], active=True, phrase=concept, kind=kind, assertion="present", temporality="current", clinical_status=None, subject="patient", section=section, section_start=None, start=start, sentence=None, evidence="direct", decision="accepted", reviewed=False, confidence=50)
    row |= other
    return tuple(row[x.split()[0]] for x in DX.split(", "))


def test_diagnosis_scores_and_reasons(spark):
    rows = [
        entry(1, "a", "disorder", "condition", "Assessment"), entry(1, "b", "hallazgo", "symptom", "HPI", evidence="context", confidence=100), entry(1, "c", "disorder", "condition", "Assessment", decision="abstain"),
        entry(1, "d", "disorder", "condition", "Assessment", decision="rejected", reviewed=True), entry(1, None, None, "condition", None), entry(1, "f", "disorder", "medication", "Plan"), entry(1, "g", "disorder", "condition", "Plan", active=False),
        entry(1, "h", "procedure", "condition", "Plan"), entry(1, "i", "disorder", "condition", "Plan", subject="family"), entry(1, "j", "finding", "condition", "family_history", assertion="absent", evidence="system"), entry(1, "k", None, "condition", "Reactive", ancestor_ids=["404684003"]),
    ]
    got = {r.concept_id: (round(r.score, 4), r.reason) for r in D.scored(spark.createDataFrame(rows, DX)).collect()}
    assert got["a"] == (15 + 22 + 20 + 9 + 18, None) and got["b"] == (30 + 12 + 20 - 4 + 2, None)
    assert got["c"] == (15 + 22 + 20 - 9 + 18, "mapping-needs-review") and got["d"] == (15 + 22 + 20 - 19 + 18, None)
    assert got["j"] == (15 - 18 - 30 - 8 + 2, "non-positive-score") and got["k"] == (15 + 2 + 20 + 9, None)
    assert [got[x][1] for x in (None, "f", "g", "h", "i")] == ["no-code", "not-diagnostic", "inactive", "not-finding", "not-patient"]


def test_diagnosis_proposal(spark):
    rows = [
        # 1: the reason for the visit leads a better scored disorder; symptom, history, suspected, parent of a comorbidity
        entry(1, "reason", "disorder", "condition", "Chief complaint", confidence=10), entry(1, "other", "disorder", "condition", "Assessment", 5, confidence=100, ancestor_ids=["parent"]), entry(1, "parent", "disorder", "condition", "Assessment", 9),
        entry(1, "cough", "finding", "symptom", "HPI"), entry(1, "old", "disorder", "condition", "Assessment", assertion="historical"), entry(1, "maybe", "disorder", "condition", "Assessment", assertion="suspected"),
        # 2: what the visit is for has no usable code, so nothing else becomes the principal
        entry(2, "lost", "disorder", "condition", "Reason for visit", decision="review"), entry(2, "easy", "disorder", "condition", "Assessment", 3),
        # 3: an acute episode on a chronic one; the first of the assessment leads
        entry(3, "acute", "disorder", "condition", "Assessment", 1, phrase="acute kidney disease", sentence="1. Acute kidney disease on chronic kidney disease"), entry(3, "chronic", "disorder", "condition", "Assessment", 30, phrase="chronic kidney disease", confidence=100),
    ]
    got = {r.concept_id: r.roles for r in D.proposal(D.scored(spark.createDataFrame(rows, DX))).collect()}
    assert got == {
        "reason": ["candidate", "principal"], "other": ["candidate", "comorbidity"], "parent": ["candidate"], "cough": ["symptom"], "old": ["history"], "maybe": ["suspected"],
        "easy": ["comorbidity"], "acute": ["candidate", "principal"], "chronic": ["candidate", "related"],
    }


def test_equal_short_texts_are_read_once_a_task(spark):
    read = []
    once = lambda text: (read.append(text), [(len(read) - 1,)])[1]
    notes = spark.range(400).selectExpr("id", "'has asthma' AS text")
    assert {r.k for r in N.per_note(notes, "id", "text", once, "k int").collect()} == {0}
    long = notes.selectExpr("id", f"repeat('x', {N.LONGEST_KEPT + 1}) AS text")
    assert max(r.k for r in N.per_note(long, "id", "text", once, "k int").collect()) > 10


def test_explanation_reads_its_mentions_once_as_brief_lines(spark, data):
    from termloom.plans import catalog

    plan = catalog.QUERIES["diagnosis_explanation"](spark, data)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(note_id" in line]
    assert len(shuffles) == 1 and "REPARTITION_BY_COL" in shuffles[0]
