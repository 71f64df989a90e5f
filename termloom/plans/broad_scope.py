"""From a phrase to the families of concepts that it means.

Candidates of a phrase are bounded by the pool that a search returns, so each phrase's are one
array and everything is decided within its row: no windows, one shuffle by phrase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clinical_kind, normalize, tokens, variants, without_tag

# Words that don't count as support, and how near the best a candidate must score.
SUPPORT_STOPWORDS = "of the an de del la el las los un una en con a".split()
LEAST_SCORE, WITHIN, FEW = 0.45, 0.12, 3


def supported(phrase: Column, terms: Column) -> Column:
    """Whether some description holds all words of some variant of the phrase."""
    words = lambda v: F.filter(tokens(v), lambda w: ~w.isin(*SUPPORT_STOPWORDS))
    holds = lambda v: F.exists(terms, lambda t: F.size(F.array_except(words(v), tokens(normalize(t)))) == 0)
    return F.exists(variants(phrase), lambda v: (F.size(words(v)) > 0) & holds(v))


def broad_scope(candidates: DataFrame) -> DataFrame:
    """phrase, basis, concept_id, term, tag: the families that each phrase means, in order.

    candidates: phrase, pos, concept_id, term, tag, descriptions (array), ancestor_ids (array),
    rerank_score. Concepts with a whole description equal to the phrase are its anchors and all
    that counts. Without one, candidates near the best score, or where none has a score the first
    few that the phrase's words support, count as far as they are the strongest of all, its
    subtypes, supported themselves, or above a supported one and at least as near. Of what is
    left, concepts beneath another are dropped: their descendants count anyway.
    """
    normal = normalize(F.col("phrase"))
    anchor = (F.col("concept_id") == F.col("phrase")) | F.exists("descriptions", lambda d: normalize(without_tag(d)) == normal)
    rows = candidates.withColumns({"anchor": F.coalesce(anchor, F.lit(False)), "supported": F.coalesce(supported(F.col("phrase"), F.col("descriptions")), F.lit(False)), "kind": clinical_kind(F.col("tag"))})
    one = F.struct("pos", "concept_id", "term", "tag", F.coalesce("ancestor_ids", F.array().cast("array<string>")).alias("up"), F.col("rerank_score").alias("score"), "anchor", "supported", "kind")
    sets = rows.groupBy("phrase").agg(F.array_sort(F.collect_list(one)).alias("c"))
    sets = sets.withColumns({"anchors": F.filter("c", lambda x: x["anchor"]), "best": F.array_max(F.transform("c", lambda x: x["score"]))})
    near = F.filter("c", lambda x: x["score"] >= F.greatest(F.lit(LEAST_SCORE), F.col("best") - WITHIN))
    by_words = F.slice(F.filter("c", lambda x: x["supported"]), 1, FEW)
    sets = sets.withColumns({"matches": F.when(F.col("best").isNotNull(), near).otherwise(by_words)})
    strongest = F.when(F.col("best").isNotNull(), F.get(F.filter("c", lambda x: x["score"] == F.col("best")), F.lit(0))).otherwise(F.get(F.col("matches"), F.lit(0)))
    sets = sets.withColumn("strongest", strongest)

    def counts(x: Column) -> Column:
        first = F.col("strongest")
        other_kind = (F.coalesce(first["tag"], F.lit("")) != "") & (x["kind"] != first["kind"])
        covers = F.exists("matches", lambda y: y["supported"] & F.array_contains(y["up"], x["concept_id"]) & F.coalesce(x["score"] >= y["score"], F.lit(False)))
        return (x["pos"] == first["pos"]) | (~other_kind & (F.array_contains(x["up"], first["concept_id"]) | x["supported"] | covers))

    sets = sets.withColumn("kept", F.when(F.size("anchors") > 0, F.col("anchors")).otherwise(F.filter("matches", counts)))
    ids = F.transform("kept", lambda x: x["concept_id"])
    roots = F.filter("kept", lambda x: ~F.arrays_overlap(F.filter(x["up"], lambda u: u != x["concept_id"]), ids))
    basis = F.when(F.size("anchors") > 0, "description-families").otherwise("semantic-families")
    return sets.select("phrase", basis.alias("basis"), F.inline(F.transform(roots, lambda x: F.struct(x["concept_id"].alias("concept_id"), x["term"].alias("term"), x["tag"].alias("tag")))))
