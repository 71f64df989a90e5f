import pytest
from compare import assert_same

from termloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(name, spark, data, duck):
    assert_same(catalog.QUERIES[name](spark, data), duck, catalog.SQL[name])


def test_notes_are_grounded_to_decisions(spark, data):
    """The one query beyond SQL: every phrase of every text gets one decision, accepted ones are exact."""
    from termloom.operators import retrieval as V
    from termloom.plans.catalog_grounding import note_phrases, note_texts
    from termloom.sources.views import tables

    assert set(catalog.QUERIES) - set(catalog.SQL) == {"note_grounding"}
    t = tables(spark, data)
    found = V.ground_notes(note_texts(t), "note_id", "text", t.search).cache()
    total = sum(r.n for r in catalog.QUERIES["note_grounding"](spark, data).collect())
    assert total == found.count() == note_phrases(t).count() > 1000
    terms = {(r.concept_id, r.normalized) for r in t.search.terms.select("concept_id", "normalized").collect()}
    accepted = found.where("status = 'accepted'").collect()
    assert accepted and all((r.concept_id, r.normalized) in terms for r in accepted)
    alone = {n for n, k in __import__("collections").Counter(x[1] for x in {(c, n) for c, n in terms}).items() if k == 1}
    assert all(r.normalized in alone for r in accepted)
