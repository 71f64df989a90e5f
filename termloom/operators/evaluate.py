"""Evaluation against gold: precision and recall, phrase matching, recommendation."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_accents


def precision_recall(rows: DataFrame, *group: str) -> DataFrame:
    """gold, predicted booleans. An empty denominator gives 1."""
    hit, gold, said = F.count_if(F.col("gold") & F.col("predicted")), F.count_if("gold"), F.count_if("predicted")
    ratio = lambda n: F.when(n == 0, 1.0).otherwise(F.round(hit / n, 6))
    return rows.groupBy(*group).agg(hit.alias("hits"), ratio(said).alias("precision"), ratio(gold).alias("recall"))


# Words that don't tell phrases apart.
PHRASE_STOPWORDS = "of the a an with and or to for on in at current present no not evidence signs review".split()


def ascii_normal(text: Column) -> Column:
    """Lower case, accents folded, all but a-z, 0-9 a space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(fold_accents(F.coalesce(text, F.lit("")))), "[^a-z0-9 ]", " "), " +", " "))


def phrase_match(a: Column, b: Column) -> Column:
    """Equal, one in the other, or 60 % of the shorter one's telling words shared. Empty ones match nothing."""
    x, y = ascii_normal(a), ascii_normal(b)
    words = lambda t: F.filter(F.split(t, " "), lambda w: (w != "") & ~w.isin(*PHRASE_STOPWORDS))
    p, q = words(x), words(y)
    shared, least = F.size(F.filter(p, lambda w: F.array_contains(q, w))), F.least(F.size(p), F.size(q))
    return (x != "") & (y != "") & ((x == y) | F.contains(x, y) | F.contains(y, x) | ((least > 0) & (shared >= 0.6 * least)))


def polarity(assertion: Column) -> Column:
    return F.when(assertion.isin("absent", "suspected", "planned"), assertion).otherwise("present")


def recommend(models: DataFrame, within: float = 0.02) -> DataFrame:
    """Of the models near the best composite, that with fewest tokens, then least latency."""
    best = models.agg(F.max("composite")).scalar()
    return models.where(F.col("composite") >= best - within).orderBy("tokens", "latency", "model").limit(1)


def _plain(text: str | None) -> str:
    folded = "".join(c for c in unicodedata.normalize("NFD", text or "") if not 0x300 <= ord(c) <= 0x36F)
    return " ".join(re.sub("[^a-z0-9 ]", " ", folded.lower()).split())


def phrases_match(a: str | None, b: str | None) -> bool:
    """phrase_match() of two strings."""
    x, y = _plain(a), _plain(b)
    if not x or not y:
        return False
    p, q = ([w for w in t.split() if w not in PHRASE_STOPWORDS] for t in (x, y))
    least = min(len(p), len(q))
    return x in y or y in x or bool(least and sum(w in q for w in p) >= 0.6 * least)


def _polarity(assertion: str | None) -> str:
    return assertion if assertion in ("absent", "suspected", "planned") else "present"


def greedy_pairs(facts: list[dict], mentions: list[dict]) -> list[tuple[int, int]]:
    """One-to-one matching of one note's facts and mentions, in order of facts: each takes the first
    free mention of its phrase that agrees in subject and polarity, else in subject, else any."""
    used: set[int] = set()
    pairs = []
    for i, fact in enumerate(facts):
        fits = [j for j, m in enumerate(mentions) if j not in used and (phrases_match(m.get("verbatim"), fact["phrase"]) or phrases_match(m["phrase"], fact["phrase"]))]
        subject = [j for j in fits if (mentions[j]["subject"] or "patient") == fact["subject"]]
        exact = [j for j in subject if _polarity(mentions[j]["assertion"]) == _polarity(fact["assertion"])]
        if best := (exact or subject or fits):
            used.add(best[0])
            pairs.append((i, best[0]))
    return pairs


MATCHES = "fact int, mention int"


def matched(facts: DataFrame, mentions: DataFrame, key: str = "note_id") -> DataFrame:
    """key, fact, mention (positions): greedy_pairs of every note. A note's facts and mentions are
    one row each side; its order decides, so it runs per note over Arrow batches.

    facts: key, pos, phrase, assertion, subject. mentions: the same and verbatim.
    """
    columns = ("pos", "phrase", "assertion", "subject")
    f = facts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("facts"))
    m = mentions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns, "verbatim"))).alias("mentions"))
    rows = f.join(m, key)

    def run(batches):
        for frame in batches:
            out = []
            for note, own, said in zip(frame[key], frame["facts"], frame["mentions"], strict=True):
                own, said = ([dict(x) if isinstance(x, dict) else x.asDict() for x in xs] for xs in (own, said))
                out += [(note, own[i]["pos"], said[j]["pos"]) for i, j in greedy_pairs(own, said)]
            yield pd.DataFrame(out, columns=[key, "fact", "mention"])

    return rows.mapInPandas(run, f"{key} {dict(facts.dtypes)[key]}, {MATCHES}")


def evidence_metrics(facts: DataFrame, mentions: DataFrame, pairs: DataFrame, key: str = "note_id") -> DataFrame:
    """Per note: detection, assertion and subject accuracy, recall of facts with both right, and
    the share of mentions that matched a fact. Empty denominators give 1."""
    own = facts.select(key, F.col("pos").alias("fact"), "assertion", "subject").join(pairs, [key, "fact"], "left")
    said = mentions.select(key, F.col("pos").alias("mention"), F.col("assertion").alias("_a"), F.coalesce("subject", F.lit("patient")).alias("_s"))
    met = own.join(said, [key, "mention"], "left")
    detected = F.col("mention").isNotNull()
    asserted, about = detected & (polarity(F.col("_a")) == polarity(F.col("assertion"))), detected & (F.col("_s") == F.col("subject"))
    share = lambda c: F.round(F.count_if(c) / F.count(F.lit(1)), 6)
    by_fact = met.groupBy(key).agg(share(detected).alias("detection"), share(asserted).alias("assertion_accuracy"), share(about).alias("subject_accuracy"), share(asserted & about).alias("recall"), F.count_if(detected).alias("_hits"))
    by_mention = mentions.groupBy(key).agg(F.count(F.lit(1)).alias("_said"))
    both = by_fact.join(by_mention, key, "full_outer")
    one = lambda c: F.coalesce(c, F.lit(1.0))
    return both.select(key, *(one(c).alias(c) for c in ("detection", "assertion_accuracy", "subject_accuracy", "recall")), F.when(F.col("_said").isNull(), 1.0).otherwise(F.round(F.coalesce("_hits", F.lit(0)) / F.col("_said"), 6)).alias("precision"))


def retrieval_metrics(expected: DataFrame, found: DataFrame, projected: DataFrame, closed: DataFrame, key: str = "note_id") -> DataFrame:
    """Per note with expected concepts: exact recall, recall among projected ones (null if none is),
    recall by accepted mappings, and expected concepts that only a relative was found of.

    expected: key, concept_id. found: key, concept_id, accepted. projected: concept_id.
    """
    want = expected.select(key, "concept_id").distinct()
    have = found.groupBy(key, "concept_id").agg(F.bool_or("accepted").alias("accepted"))
    known = projected.select("concept_id").distinct().withColumn("_in", F.lit(True))
    direct = want.join(have, [key, "concept_id"], "left").join(known, "concept_id", "left")
    up = closed.select(F.col("concept_id").alias("_x"), F.col("ancestor_id").alias("_y"))
    pairs = want.withColumnRenamed("concept_id", "_want").join(have.select(key, F.col("concept_id").alias("_have")), key)
    related = pairs.join(up, ((F.col("_want") == F.col("_x")) & (F.col("_have") == F.col("_y"))), "left_semi").unionByName(pairs.join(up, ((F.col("_want") == F.col("_y")) & (F.col("_have") == F.col("_x"))), "left_semi"))
    near = related.select(key, F.col("_want").alias("concept_id")).distinct().withColumn("_near", F.lit(True))
    rows = direct.join(near, [key, "concept_id"], "left")
    exact, inside = F.col("accepted").isNotNull(), F.coalesce("_in", F.lit(False))
    n = F.count(F.lit(1))
    return rows.groupBy(key).agg(
        n.alias("expected"), F.round(F.count_if(exact) / n, 6).alias("recall"), F.when(F.count_if(inside) > 0, F.round(F.count_if(exact & inside) / F.count_if(inside), 6)).alias("in_scope_recall"),
        F.round(F.count_if(F.coalesce("accepted", F.lit(False))) / n, 6).alias("accepted_recall"), F.count_if(~exact & F.coalesce("_near", F.lit(False))).alias("related_only"),
    )


def evaluation_means(notes: DataFrame, *metrics: str, by: str = "model") -> DataFrame:
    """Means of scored notes' metrics, nulls left out: null where no note has the metric."""
    scored = notes.where("scored")
    return scored.groupBy(by).agg(F.count(F.lit(1)).alias("notes"), *(F.round(F.avg(m), 6).alias(m) for m in metrics))


def ranked_diagnoses(rows: DataFrame) -> DataFrame:
    """Per note: top1, top3, comorbidity precision and recall.

    rows: note_id, expected_principal, ranked array, expected array, proposed array. Recall is 1 if
    none is expected; precision without proposals is 1 if none is expected, else 0.
    """
    hit = F.size(F.array_intersect("expected", "proposed"))
    recall = F.when(F.size("expected") == 0, 1.0).otherwise(hit / F.size("expected"))
    precision = F.when(F.size("proposed") > 0, hit / F.size("proposed")).when(F.size("expected") == 0, 1.0).otherwise(0.0)
    top = lambda k: F.array_contains(F.slice("ranked", 1, k), F.col("expected_principal"))
    return rows.select("note_id", top(1).alias("top1"), top(3).alias("top3"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"))


def contract_violations(mentions: DataFrame, notes: DataFrame, release: DataFrame) -> DataFrame:
    """mention_id and what is wrong: a span that isn't the note's text, a code outside the
    release, an acceptance without an anchored span."""
    joined = mentions.join(notes.select("note_id", "text"), "note_id", "left").join(release.select("concept_id", F.lit(True).alias("_known")).distinct(), "concept_id", "left")
    span = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    checks = F.array_compact(F.array(F.when(F.col("start").isNotNull() & ~span.eqNullSafe(F.col("verbatim")), "span"), F.when(F.col("concept_id").isNotNull() & F.col("_known").isNull(), "release"), F.when((F.col("status") == "accepted") & F.col("start").isNull(), "support")))
    return joined.select("mention_id", F.explode(checks).alias("violation"))
