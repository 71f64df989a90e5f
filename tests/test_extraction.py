"""The external extractor: bounded calls, retry, whole notes or none, answers that are kept."""

import json
from pathlib import Path

import pytest

from termloom.operators.anchoring import extraction_windows
from termloom.operators.extraction import Answers, capitalized_words, extract


@pytest.fixture
def notes(spark):
    long = " ".join(f"Word{k} is here." for k in range(60))
    return spark.createDataFrame([(1, "Asthma and Fever."), (2, long), (3, ""), (4, None), (5, "Broken window. " + "x" * 60 + ". Good end."), (6, "Asthma and Fever.")], "note_id long, text string").repartition(3)


def failing(log: str, healed: bool):
    def service(window, note):
        with open(log, "a") as out:
            out.write("call\n")
        if "xxx" in window and not healed:
            raise TimeoutError("no answer")
        return capitalized_words(window, note)

    return service


def calls(log) -> int:
    return len(Path(log).read_text().splitlines()) if Path(log).exists() else 0


def test_a_note_with_a_failed_window_fails_whole_and_goes_on_later(spark, notes, tmp_path):
    log, answers = str(tmp_path / "log"), Answers(spark)
    run = lambda healed: {r.note_id: r for r in extract(notes, "note_id", "text", failing(log, healed), "v1", answers, size=40, tries=2).collect()}
    first = run(False)
    texts = {r.note_id: r.text for r in notes.collect()}
    windows = {w for t in set(texts.values()) if t for w in [(x, t) for x in extraction_windows(t, 40)]}
    broken = [w for w in windows if "xxx" in w[0]]
    assert {k: r.status for k, r in first.items()} == {1: "ok", 2: "ok", 3: "empty", 4: "empty", 5: "failed", 6: "ok"}
    assert first[5].mentions is None and first[5].error == "TimeoutError: no answer"
    assert calls(log) == len(windows) + len(broken)  # equal notes once, broken windows twice
    found = [json.loads(m) for m in first[2].mentions]
    assert [m["phrase"] for m in found] == [f"Word{k}" for k in range(60)]
    assert all(m["verbatim"] in texts[2][int(m["window_start"]) : int(m["window_end"])] for m in found)
    before = calls(log)
    second = {r.note_id: r for r in extract(notes, "note_id", "text", failing(log, True), "v1", Answers(spark, answers.path), size=40).collect()}
    assert calls(log) - before == len(broken)  # another session asks for what is missing only
    assert second[5].status == "ok" and [json.loads(m)["phrase"] for m in second[5].mentions] == ["Broken", "Good"]
    before = calls(log)
    assert run(True)[5].status == "ok" and calls(log) == before


def test_answers_of_another_kind_are_failures(spark, notes):
    out = extract(notes.where("note_id = 1"), "note_id", "text", lambda w, n: "text", "v2", Answers(spark), tries=1).first()
    assert out.status == "failed" and out.error == "ValueError: not a list of mentions"
    assert extract(notes.limit(0), "note_id", "text", capitalized_words, "v3", Answers(spark)).count() == 0


def test_texts_are_shuffled_once_and_blank_notes_stay(spark):
    asked = spark.sparkContext.accumulator(0)

    def service(window, note):
        asked.add(1)
        return capitalized_words(window, note)

    notes = spark.createDataFrame([(1, "Aaaa bb. Aaaa bb. Cccc d."), (2, "Aaaa bb. Aaaa bb. Cccc d."), (3, "  "), (4, None), (None, "Dddd e.")], "id int, text string")
    found = extract(notes, "id", "text", service, "p", Answers(spark), size=9)
    rows = {r.id: (r.status, r.mentions and len(r.mentions)) for r in found.collect()}
    assert rows == {1: ("ok", 3), 2: ("ok", 3), 3: ("empty", None), 4: ("empty", None), None: ("ok", 1)} and asked.value == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in line and "note" in line for line in plan.splitlines())
