from collections import Counter

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from termloom.llm import mixing, quality


@pytest.fixture(scope="module")
def steps(spark, docs, tmp_path_factory):
    """Each stage's input and output on the small odd table."""
    found, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, now, "").write.parquet(path)
        found[name] = (now, out := spark.read.parquet(path))
        now = out
    return found


def test_columns(steps, docs):
    assert [x[1].columns == docs.columns for x in steps.values()] == [True] * 4 + [False]


def test_quality_stage(steps):
    before, after = steps["quality_rules"]
    assert Counter(r.doc_id for r in after.collect()) == Counter(r.doc_id for r in quality.digest(before).where("kept").collect())


def test_line_stage(steps):
    before, after = steps["line_dedup"]
    want = brute.line_cuts([(r.doc_id, r.text) for r in before.collect()])
    assert Counter((r.doc_id, brute.sha(r.text or "")) for r in after.collect()) == Counter((d, h) for d, _, _, h in want)


def test_near_copy_stage(steps):
    before, after = steps["ngram_join"]
    brute.assert_one_of_each([tuple(r) for r in before.collect()], [tuple(r) for r in after.collect()])


def test_mixing_stage(steps):
    before, after = steps["mixing"]
    marked = before.select(*before.columns, mixing.row_mark(before).alias("own"))
    rows = {r["own"]: tuple(r)[:-1] for r in marked.collect()}
    want = Counter()
    for r in mixing.copies(before, mixing.row_mark(before)).collect():
        want[rows[r.mark]] += r.n_copies
    assert Counter(tuple(r) for r in after.collect()) == +want


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_of_an_empty_table(name, stage, spark, empty):
    out = stage(spark, empty, "")
    assert out.count() == 0 and (name == "packing" or out.columns == empty.columns)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_with_nulls_everywhere(name, stage, spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = " ".join(f"w{k}" for k in range(70))
    docs = spark.createDataFrame([(None,) * 5, (None,) * 5, (1, None, None, None, None), (None, words, None, None, None), (2, words, "en", "s", 9)], schema)
    out = [tuple(r) for r in stage(spark, docs, "").collect()]
    if name == "line_dedup":
        assert len(out) == 5
    if name == "ngram_join":
        assert sorted(out, key=str) == sorted([tuple(r) for r in docs.collect() if r.text is None or r.doc_id == 2], key=str)
    if name == "packing":
        assert len(out) == 5


def test_packing_stage(steps):
    before, after = steps["packing"]
    assert sorted(r.doc_id for r in after.where("start = 0").collect()) == sorted(r.doc_id for r in before.collect())
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0
