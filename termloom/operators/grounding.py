"""Grounding of mentions: candidates' scores and flags, their order, confidence, review, guards,
and the evidence graph. Weights, words and patterns are fixed values that results depend on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import english_tag, normalize, tokens

# Semantic tags that each kind of mention may ground to.
ALLOWED_TAGS = {
    "condition": ["disorder", "finding"], "symptom": ["finding"], "observation": ["finding", "observable entity"],
    "medication": ["substance", "product", "medicinal product", "medicinal product form", "clinical drug"],
    "procedure": ["procedure", "regime/therapy"], "referral": ["procedure", "regime/therapy"], "test": ["procedure", "observable entity"], "context": [],
}
# Words of candidate terms that scores look for.
STOPWORDS = "the a an and or for with without de del la las el los of on to from at by into under en y o sin con para por".split()
NEUTRAL = "mellitus type finding disorder disease".split()
LATERALITY = "left right bilateral unilateral".split()
POPULATION = "prematurity premature neonatal neonate maternal pregnancy congenital".split()
STATUS = "uncontrolled controlled poorly well stable unstable severe mild moderate advanced".split()
WORKFLOW = "follow[ -]?up|review|evaluation|screening|monitoring|check"
RELATION = "due to|associated with|with|without|following|secondary to|caused by|resulting from"
COMPOUND = ("due to", "associated with", "following", "secondary to", "with")
# Descriptions that already say that something is absent.
NEGATIVE_START = "(?i)^(?:no|without|sin|absence of|ausencia de|lack of)(?![A-Za-z0-9_])"
NEGATIVE_END = "(?i)(?<![A-Za-z0-9_])(?:absent|negative|not detected|not present|ausente|negativ[oa]|no detectad[oa])(?:\\s*\\([^)]*\\))*$"
# Attributes that a literal match can't vouch for, and those that make a symptom an interpretation.
QUALIFIED = "(?i)stage|estadio|laterality|lateralidad|site|sitio|acuity|histology|cause|etiolog|strength|potencia|concentration|concentracion|formulat|formulac|combin"
INTERPRETED = "(?i)compatible|relationship.*condition|cause|etiolog"


def kind_compatible(kind: Column, tag: Column, verified: Column | None = None) -> Column:
    """Whether a mention's kind may have a concept's tag; unknown kinds or tags may, and so may
    states among each other where a reviewer found the two equivalent."""
    english = english_tag(F.coalesce(tag, F.lit("")))
    allowed = F.create_map(*(x for k, v in ALLOWED_TAGS.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))))
    by_rule = F.when(F.coalesce(kind, F.lit("")) == "", True).when(english == "", True).otherwise(F.coalesce(F.array_contains(allowed[kind], english), F.lit(True)))
    if verified is None:
        return by_rule
    states = kind.isin("condition", "symptom", "observation") & english.isin("disorder", "finding", "observable entity")
    return by_rule | F.coalesce(verified & states, F.lit(False))


def inverts_negation(assertion: Column, tag: Column, description: Column) -> Column:
    """An absent mention on a finding that is itself an absence would mean its presence."""
    text = F.trim(F.coalesce(description, F.lit("")))
    return F.coalesce((assertion == "absent") & (english_tag(F.coalesce(tag, F.lit(""))) == "finding") & (text.rlike(NEGATIVE_START) | text.rlike(NEGATIVE_END)), F.lit(False))


def full_description(phrase: Column, *descriptions: Column) -> Column:
    """Whether a phrase is a whole description of the concept. Arrays of descriptions count as many."""
    wanted = normalize(F.coalesce(phrase, F.lit("")))
    said = F.lit(False)
    for d in descriptions:
        said = said | F.coalesce(normalize(d) == wanted, F.lit(False))
    return (wanted != "") & said


def any_description(phrase: Column, descriptions: Column) -> Column:
    wanted = normalize(F.coalesce(phrase, F.lit("")))
    return (wanted != "") & F.coalesce(F.exists(descriptions, lambda d: normalize(d) == wanted), F.lit(False))


FLAGS = ("workflow", "relation", "laterality", "population", "status", "specific", "compound")


def candidate_flags(phrase: Column, n_tokens: Column, ctx: Column, relation_cue: Column, term: Column) -> Column:
    """What speaks against a candidate term for a phrase, as a struct of FLAGS and n_extra, the
    words it has beyond the phrase. ctx is the mention's assertion."""
    return _flags(*(normalize(F.coalesce(x, F.lit(""))) for x in (phrase, term)), n_tokens, ctx, relation_cue)


def _flags(wanted: Column, name: Column, n_tokens: Column, ctx: Column, relation_cue: Column) -> Column:
    """candidate_flags() of normal forms."""
    asked = tokens(wanted)
    extras = F.filter(tokens(name), lambda w: ~F.array_contains(asked, w) & ~w.isin(*STOPWORDS, *NEUTRAL) & (F.length(w) > 3))
    has = lambda pattern: name.rlike(f"(?<![A-Za-z0-9_])({pattern})(?![A-Za-z0-9_])")
    some = lambda words: F.exists(extras, lambda w: w.isin(*words))
    yes = lambda c: F.coalesce(c, F.lit(False))
    compound = F.lit(False)
    for words in COMPOUND:
        compound = compound | F.contains(name, F.concat(F.lit(f"{words} "), wanted))
    found = {
        "workflow": has(WORKFLOW) & ~yes(ctx == "planned"), "relation": yes(relation_cue) & has(RELATION), "laterality": some(LATERALITY), "population": some(POPULATION),
        "status": some(STATUS), "specific": yes(n_tokens == 1) & (F.size(extras) > 0) & (name != wanted), "compound": compound,
    }
    return F.struct(*(found[k].alias(k) for k in FLAGS), F.size(extras).alias("n_extra"), has(RELATION).alias("relational"))


def candidate_score(phrase: Column, n_tokens: Column, ctx: Column, relation_cue: Column, term: Column, matched: Column, tier: Column, preferred: Column, rank: Column, score: Column, tag: Column) -> Column:
    """Tier, exactness, preference, rank, search score and tag, less what speaks against the term.

    A null or empty matched text is the term's; a null tier is 99; a null rank or score is 0.
    """
    wanted, name, tagged = (normalize(F.coalesce(x, F.lit(""))) for x in (phrase, term, tag))
    return _score(wanted, name, _matched(matched, term), tagged, candidate_flags(phrase, n_tokens, ctx, relation_cue, term), n_tokens, ctx, tier, preferred, rank, score)


def _matched(matched: Column, term: Column) -> Column:
    return normalize(F.when(F.coalesce(matched, F.lit("")) == "", F.coalesce(term, F.lit(""))).otherwise(matched))


def _score(wanted: Column, name: Column, other: Column, tagged: Column, flags: Column, n_tokens: Column, ctx: Column, tier: Column, preferred: Column, rank: Column, score: Column) -> Column:
    """candidate_score() of normal forms and flags."""
    one, negated = (F.coalesce(x, F.lit(False)) for x in (n_tokens == 1, ctx == "absent"))
    exact, partial, condition = name == wanted, other == wanted, tagged.isin("disorder", "finding")
    less = lambda case, points: F.when(case, -points).otherwise(0)
    base = F.greatest(50 - 8 * F.coalesce(tier, F.lit(99)), F.lit(-22)).cast("double")
    match = F.when(exact, 34).when(partial, 16).when(F.contains(name, wanted), 8).otherwise(0)
    by_tag = F.when(condition, 4).when(tagged == "", 0).otherwise(-6)
    per_extra = F.when(exact, 0.0).when(partial, F.when(one, 14.0).otherwise(6.0)).otherwise(F.when(one, 12.0).otherwise(4.5))
    relation = F.when(flags["relation"], -16).when(flags["relational"] & ~exact & ~partial, -6).otherwise(0)
    side = F.when(flags["laterality"], F.when(negated, -14).otherwise(-9)).otherwise(0)
    penalties = less(flags["workflow"], 18) + relation + side + less(flags["population"], 14) + less(flags["status"], 18) + less(flags["specific"], 14)
    worth = F.least(F.coalesce(rank, F.lit(0)), F.lit(60)) / 10.0 + F.least(F.coalesce(score, F.lit(0)), F.lit(500)) / 50.0
    return F.round(base + match + F.when(preferred, 5).otherwise(0) + worth + by_tag - flags["n_extra"] * per_extra + penalties + F.when(negated & condition, 2).otherwise(0), 4)


def synthetic_tier(rerank: Column) -> Column:
    """The tier that a candidate found by meaning alone counts as."""
    return F.when(rerank >= 0.6, 2).when(rerank >= 0.45, 4).when(rerank >= 0.3, 6).otherwise(8)


def grounding_order() -> list[Column]:
    """Of a mention's candidates: whole descriptions first, then by rerank score where both have
    one, then by grounding score and the rest. Columns: full, rerank_score, score, tier, preferred,
    rank, search_score, pos. Candidates with a rerank score precede those without, among those
    that aren't whole descriptions: an order, which comparing pairs alone wouldn't be."""
    reranked = F.when(~F.col("full"), F.col("rerank_score"))
    return [F.col("full").desc(), reranked.desc_nulls_last(), F.col("score").desc(), F.coalesce("tier", F.lit(99)).asc(), F.col("preferred").desc(), F.coalesce("rank", F.lit(0)).desc(), F.coalesce("search_score", F.lit(0.0)).desc(), F.col("pos").asc()]


def with_margin(candidates: DataFrame, key: str = "mention_id", order: list[Column] | None = None) -> DataFrame:
    """place within each mention, and the margin to the next (0 if that is negative)."""
    window = Window.partitionBy(key).orderBy(*(order or [F.col("score").desc(), F.col("concept_id").asc()]))
    following = F.coalesce(F.lead("score").over(window), F.lit(0.0))
    return candidates.withColumns({"place": F.row_number().over(window), "margin": F.greatest(F.col("score") - following, F.lit(0.0))})


def confidence(score: Column, margin: Column, exact: Column, synonym: Column, contains: Column, tier: Column, n_tokens: Column, active: Column, flags: Column) -> Column:
    """exact: the term is the phrase; synonym: the matched text is. score is the search score."""
    match = F.when(exact, 0.22).when(synonym, 0.12).when(contains, 0.08).otherwise(0.0)
    by_tier = F.when(tier <= 2, 0.18).when(tier <= 4, 0.10).when(tier <= 6, 0.04).otherwise(-0.08)
    one, whole = n_tokens == 1, exact | synonym
    less = lambda case, points: F.when(case, points).otherwise(0.0)
    against = less(one & ~whole, 0.08) + less(~active, 0.3) + less(flags["workflow"], 0.22) + less(flags["relation"], 0.16) + less(flags["laterality"], 0.12) + less(flags["population"], 0.14) + less(flags["status"], 0.16) + F.when(flags["specific"], F.when(one, 0.32).otherwise(0.18)).otherwise(0.0)
    total = 0.34 + F.least(0.22 * score, F.lit(0.24)) + F.least(margin / 25.0, F.lit(0.22)) + match + by_tier - against
    return F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 6)


def review_status(conf: Column, margin: Column, exact: Column, synonym: Column, tier: Column, n_tokens: Column, active: Column, flags: Column, full: Column, n_full: Column) -> Column:
    """abstain, accepted or review. Nothing is accepted that isn't a whole description of the
    concept, nor where several concepts have that description (n_full)."""
    guarded = ~(flags["compound"] | flags["workflow"] | flags["relation"] | flags["laterality"] | flags["population"] | flags["status"])
    sure = (exact | synonym | (tier <= 2)) & (conf >= 0.68) & (margin >= 0.03) & ((n_tokens > 1) | exact) & guarded & ~flags["specific"]
    likely = (tier <= 4) & (conf >= 0.64) & (margin >= 0.05) & (n_tokens >= 2) & guarded
    status = F.when(~active | (conf < 0.42), "abstain").when((sure | likely) & full, "accepted").otherwise("review")
    return F.when(n_full > 1, "review").otherwise(status)


def decision_reasons(status: Column, margin: Column, exact: Column, synonym: Column, contains: Column, tier: Column, n_tokens: Column, active: Column, flags: Column, full: Column, n_full: Column, n_candidates: Column) -> Column:
    whole = exact | synonym
    said = [
        (~active, "inactive-candidate"), ((n_tokens == 1) & ~whole, "short-generic-span"), ((margin < 0.05) & (n_candidates > 1), "ambiguous-top-candidate"), (~whole & ~contains, "lexical-mismatch"),
        (tier >= 7, "broad-lexical-match"), (flags["workflow"], "workflow-term-not-clinical-anchor"), (flags["laterality"], "unattributed-laterality"), (flags["population"], "population-mismatch"),
        (flags["status"], "unattributed-clinical-qualifier"), (flags["specific"], "over-specific-candidate"), (flags["compound"] | flags["relation"], "compound-descendant-match"),
        (n_full > 1, "ambiguous-full-description"), (~full, "full-description-match-not-established"), (status == "accepted", "exact-clinical-match"),
    ]
    found = F.array_compact(F.array(*(F.when(case, F.lit(word)) for case, word in said)))
    plain = F.when(status == "review", "manual-review-required").otherwise("low-confidence")
    return F.when(F.size(found) > 0, found).otherwise(F.array(plain))


def grounded(mentions: DataFrame, candidates: DataFrame) -> DataFrame:
    """The decision on every mention.

    mentions: mention_id, phrase, n_tokens, assertion, relation_cue, kind. candidates: mention_id,
    pos, concept_id, term, matched, descriptions (array), tag, tier, preferred, rank, search_score,
    rerank_score, active. Of a mention's candidates each concept counts once, at its best place,
    and only if its tag suits the mention's kind. A mention without candidates abstains.
    """
    col = lambda *names: [F.col(c) for c in names]
    form = lambda c: normalize(F.coalesce(F.col(c), F.lit("")))
    # normal forms once; what is made of them reads columns
    both = mentions.join(candidates, "mention_id").withColumns({"_wanted": form("phrase"), "_name": form("term"), "_other": _matched(F.col("matched"), F.col("term")), "_tagged": form("tag")})
    both = both.withColumn("flags", _flags(*col("_wanted", "_name", "n_tokens", "assertion", "relation_cue")))
    scored = both.withColumns({
        "score": _score(*col("_wanted", "_name", "_other", "_tagged", "flags", "n_tokens", "assertion", "tier", "preferred", "rank", "search_score")),
        "full": (F.col("_wanted") != "") & F.coalesce(F.exists("descriptions", lambda d: normalize(d) == F.col("_wanted")), F.lit(False)),
    })
    own = Window.partitionBy("mention_id", "concept_id").orderBy(*grounding_order())
    single = scored.withColumn("_k", F.row_number().over(own)).where("_k = 1").where(kind_compatible(F.col("kind"), F.col("tag"))).drop("_k")
    placed = with_margin(single, order=grounding_order())
    all_of = Window.partitionBy("mention_id")
    counted = placed.withColumns({"n_full": F.count_if("full").over(all_of), "n_candidates": F.count(F.lit(1)).over(all_of)}).where("place = 1")
    wanted, name, matched = col("_wanted", "_name", "_other")
    facts = counted.withColumns({
        "exact": name == wanted, "synonym": matched == wanted,
        "contains": (name == wanted) | (matched == wanted) | F.contains(matched, wanted) | F.contains(wanted, matched) | F.contains(name, wanted) | F.contains(wanted, name),
        "tier": F.coalesce("tier", F.lit(99)),
    })
    judged = facts.withColumn("confidence", confidence(F.coalesce("search_score", F.lit(0.0)), *col("margin", "exact", "synonym", "contains", "tier", "n_tokens", "active", "flags")))
    judged = judged.withColumn("status", review_status(*col("confidence", "margin", "exact", "synonym", "tier", "n_tokens", "active", "flags", "full", "n_full")))
    judged = judged.withColumn("reasons", decision_reasons(*col("status", "margin", "exact", "synonym", "contains", "tier", "n_tokens", "active", "flags", "full", "n_full", "n_candidates")))
    chosen = judged.select("mention_id", "concept_id", F.col("term").alias("candidate"), "tag", "score", F.round("margin", 4).alias("margin"), "confidence", "status", F.when(F.col("status") == "accepted", "direct").otherwise("inferred").alias("evidence"), "reasons")
    whole = mentions.join(chosen, "mention_id", "left")
    none = F.col("concept_id").isNull()
    return whole.withColumns({"status": F.when(none, "abstain").otherwise(F.col("status")), "confidence": F.coalesce("confidence", F.lit(0.0)), "evidence": F.when(none, "context").otherwise(F.col("evidence")), "reasons": F.when(none, F.array(F.lit("no-candidate"))).otherwise(F.col("reasons"))})


# ---- reviewers' decisions and their guards


def literal_match(kind: Column, status: Column, full: Column, attribute_names: Column) -> Column:
    """Mentions that need no reviewer: accepted states and medications whose words are the whole
    description and whose attributes qualify nothing."""
    return kind.isin("condition", "symptom", "medication") & (status == "accepted") & full & ~F.coalesce(F.exists(attribute_names, lambda k: k.rlike(QUALIFIED)), F.lit(False))


def verified(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """entries with a reviewer's decision applied, where it stands up to the source.

    entries: mention_id, kind, assertion, evidence_status, sentence, verbatim, attributes, and
    candidates (array of concept_id, tag, description). decisions: mention_id, concept_id, relation,
    quotes, missing. A decision counts only if there is one alone for its mention, it names a
    candidate or none, and quotes the source word for word.
    """
    alone = decisions.groupBy("mention_id").agg(F.count(F.lit(1)).alias("_n"), F.first("concept_id").alias("chosen"), F.first("relation").alias("relation"), F.first("quotes").alias("quotes"), F.first("missing").alias("missing")).where("_n = 1").drop("_n")
    rows = entries.join(alone, "mention_id", "left")
    text = F.array(F.coalesce("sentence", F.lit("")), F.coalesce("verbatim", F.lit("")))
    none = F.array().cast("array<string>")
    real = F.filter(F.coalesce("quotes", none), lambda q: (F.trim(q) != "") & F.exists(text, lambda t: F.contains(t, q)))
    lacking = F.filter(F.coalesce("missing", none), lambda q: F.trim(q) != "")
    candidate = F.filter("candidates", lambda c: c["concept_id"] == F.col("chosen"))
    rows = rows.withColumns({"quotes": real, "missing": lacking, "_c": F.get(candidate, F.lit(0))})
    known = F.coalesce(F.col("relation").isin("equivalent", "broader", "unsupported"), F.lit(False))
    valid = known & ((F.col("chosen") == "none") | (F.col("_c").isNotNull() & (F.size("quotes") > 0)))
    equivalent = F.col("relation") == "equivalent"
    suits = kind_compatible(F.col("kind"), F.col("_c.tag"), equivalent) & ~inverts_negation(F.col("assertion"), F.col("_c.tag"), F.col("_c.description"))
    interpreted = (F.col("kind") == "symptom") & F.coalesce(F.exists(F.map_keys("attributes"), lambda k: k.rlike(INTERPRETED)), F.lit(False))
    accepted = equivalent & (F.size("missing") == 0) & (F.col("evidence_status") == "anchored") & ~interpreted
    unsupported = F.col("_c").isNull() | (F.col("relation") == "unsupported") | ~suits
    status = F.when(~F.coalesce(valid, F.lit(False)), F.when(F.col("kind") == "context", "abstain").otherwise("review")).when(unsupported, "abstain").when(accepted, "accepted").otherwise("review")
    said = F.when(~F.coalesce(valid, F.lit(False)), "invalid-semantic-evidence").when(unsupported, "no-source-supported-candidate").when(accepted, "source-supported-semantic-match").otherwise("mapping-needs-review")
    return rows.withColumns({"status": status, "reason": said, "concept_id": F.when(status.isin("accepted", "review") & (said != "invalid-semantic-evidence"), F.col("chosen"))}).drop("_c")


def adjudicated(decisions: DataFrame, candidates: DataFrame, eligible: DataFrame) -> DataFrame:
    """decisions (mention_id, concept_id, primary) whose concept is among the mention's candidates;
    primary only where the concept is eligible (note's eligible concept ids)."""
    kept = decisions.join(candidates.select("mention_id", "concept_id").distinct(), ["mention_id", "concept_id"], "left_semi")
    able = eligible.select("concept_id").distinct().withColumn("_able", F.lit(True))
    return kept.join(able, "concept_id", "left").withColumn("primary", F.coalesce(F.col("primary") & F.col("_able"), F.lit(False))).drop("_able")


CONNECTOR = "(?i)(?<![A-Za-z0-9_])(on a background of|on|sobre)(?![A-Za-z0-9_])"
LINK_WORDS = "the with and for con del los las una por".split()


def linked_mentions(mentions: DataFrame) -> DataFrame:
    """note_id, mention_id, partner_id: current conditions of the patient that one sentence names on
    both sides of a connector, with two words in common. Mentions meet by note and sentence.

    mentions: note_id, mention_id, kind, assertion, temporality, experiencer, sentence, phrase.
    """
    able = mentions.where("kind = 'condition' AND assertion = 'present' AND temporality = 'current' AND experiencer = 'patient'")
    sentence = F.coalesce("sentence", F.lit(""))
    at, size = F.regexp_instr("sentence", F.lit(CONNECTOR)), F.length(F.regexp_extract("sentence", CONNECTOR, 0))
    # few sentences name two mentions, so they are counted before anything is matched on both sides
    sided = able.withColumns({"sentence": sentence, "_s": F.xxhash64(sentence)}).where(F.col("sentence").rlike(CONNECTOR))
    met = sided.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("note_id", "_s"))).where("_n > 1")
    told = met.groupBy("note_id", "sentence").agg(F.collect_list(F.struct("mention_id", normalize(F.col("phrase")).alias("p"))).alias("ms"))
    told = told.select("note_id", "ms", normalize(F.col("sentence").substr(F.lit(1), at - 1)).alias("left"), normalize(F.col("sentence").substr(at + size, F.length("sentence"))).alias("right"))
    pairs = told.select("note_id", "left", "right", "ms", F.inline("ms").alias("mention_id", "p")).select("note_id", "left", "right", "mention_id", "p", F.inline("ms").alias("partner_id", "q"))
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: (F.length(w) > 2) & ~w.isin(*LINK_WORDS)))
    sides = (F.contains("left", "p") & F.contains("right", "q")) | (F.contains("right", "p") & F.contains("left", "q"))
    linked = pairs.where((F.col("mention_id") != F.col("partner_id")) & sides)
    return linked.where(F.size(F.array_intersect(words("p"), words("q"))) >= 2).select("note_id", "mention_id", "partner_id")


def shared_candidates(links: DataFrame, pools: DataFrame, most: int = 20) -> DataFrame:
    """mention_id, concept_id, place: for linked mentions their own and their partners' pools by
    turns, each concept once. pools: mention_id, rank (from 0), concept_id."""
    whose = links.select("mention_id", F.col("partner_id").alias("_from"), F.lit(1).alias("_own")).unionByName(links.select("mention_id", F.col("mention_id").alias("_from"), F.lit(0).alias("_own")).distinct())
    given = whose.join(pools.where(F.col("rank") < most).withColumnRenamed("mention_id", "_from"), "_from")
    first = given.groupBy("mention_id", "concept_id").agg(F.min(F.struct("rank", "_own", "_from")).alias("_at"))
    place = F.row_number().over(Window.partitionBy("mention_id").orderBy("_at", "concept_id"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("mention_id", "concept_id", "place")


# ---- spans and the evidence graph


def overlapping(spans: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Pairs of spans of one key that overlap; the key keeps the range join local."""
    o = others.select(F.col(key).alias("_key"), F.col("span_id").alias("other_id"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    return spans.join(o, (F.col(key) == F.col("_key")) & (F.col("start") < F.col("other_end")) & (F.col("end") > F.col("other_start"))).drop("_key")


def evidence_nodes(mentions: DataFrame, signals: DataFrame) -> DataFrame:
    """note_id, node, id, start, end, text: sections, sentences, spans, cues and grounded concepts.

    mentions: note_id, mention_id, section, sentence, sentence_start, sentence_end, start, end,
    phrase, concept_id. signals: note_id, sentence_start, cue_type, value, cue, start, end.
    """
    node = lambda df, kind, name, start, end, text: df.select("note_id", F.lit(kind).alias("node"), name.alias("id"), F.col(start).cast("int").alias("start") if start else F.lit(None).cast("int").alias("start"), F.col(end).cast("int").alias("end") if end else F.lit(None).cast("int").alias("end"), F.col(text).cast("string").alias("text"))
    section = F.concat(F.lit("sec-"), F.regexp_replace(normalize(F.col("section")), " ", "-"))
    sentence = F.concat(F.lit("sent-"), F.col("sentence_start").cast("string"))
    cue = F.concat_ws("-", F.lit("cue"), "sentence_start", "cue_type", "value")
    # as many sentences as the notes have, which estimates take for a few: never broadcast
    told = mentions.select("note_id", "sentence_start").hint("merge")
    parts = [
        node(mentions.select("note_id", "section").distinct(), "section", section, None, None, "section"), node(mentions.select("note_id", "sentence", "sentence_start", "sentence_end").distinct(), "sentence", sentence, "sentence_start", "sentence_end", "sentence"),
        node(mentions, "span", F.concat(F.lit("sp-"), "mention_id"), "start", "end", "phrase"), node(signals.join(told, ["note_id", "sentence_start"], "left_semi"), "cue", cue, "start", "end", "cue"),
        node(mentions.where("concept_id IS NOT NULL"), "grounded", F.concat(F.lit("gn-"), "mention_id"), None, None, "concept_id"),
    ]
    whole = parts[0]
    for more in parts[1:]:
        whole = whole.unionByName(more)
    return whole


def evidence_edges(mentions: DataFrame, signals: DataFrame) -> DataFrame:
    """note_id, edge, source, target, weight: cues to the mentions of their sentence, and relations
    between the mentions on both sides of a relation cue: 0.88, or 0.72 where a side is empty and
    the sentence's first or next mention stands in for it."""
    cue = F.concat_ws("-", F.lit("cue"), "sentence_start", "cue_type", "value").alias("cue_id")
    cues = signals.select("note_id", "sentence_start", cue, "cue_type", "value", F.col("start").alias("cue_start"), F.col("end").alias("cue_end"))
    # both grow with the notes, whatever their estimates: never broadcast
    met = cues.join(mentions.select("note_id", "sentence_start", "mention_id", "start", "end").hint("merge"), ["note_id", "sentence_start"])
    applied = met.select("note_id", F.lit("applies").alias("edge"), F.col("cue_id").alias("source"), F.col("mention_id").alias("target"), F.lit(1.0).alias("weight"))
    order = F.struct("start", "end", "mention_id")
    sides = met.where("cue_type = 'relation'").groupBy("note_id", "cue_id", "value").agg(
        F.max_by("mention_id", F.when(F.col("end") <= F.col("cue_start"), order)).alias("_left"), F.min_by("mention_id", F.when(F.col("start") >= F.col("cue_end"), order)).alias("_right"), F.array_sort(F.collect_list(order)).alias("_all")
    )
    ids = F.col("_all.mention_id")
    source = F.coalesce("_left", ids[0])
    target = F.coalesce(F.col("_right"), F.get(F.filter(ids, lambda m: m != source), F.lit(0)))
    related = sides.where(F.size("_all") > 1).select("note_id", F.col("value").alias("edge"), source.alias("source"), target.alias("target"), F.when(F.col("_left").isNotNull() & F.col("_right").isNotNull(), 0.88).otherwise(0.72).alias("weight"))
    return applied.unionByName(related.where("source <> target"))


# ---- which mentions are looked up, and how


def wanted_for_target(context_type: Column, target: Column) -> Column:
    """With a target given, plans only ground to procedures and relatives' history to nothing."""
    asked = F.lower(F.trim(F.coalesce(target, F.lit(""))))
    pruned = (asked != "") & (((context_type == "plan") & (asked != "procedure.code")) | (context_type == "family-history"))
    return ~F.coalesce(pruned, F.lit(False))


def lookup_plan(phrase: Column, points: Column, kind: Column, evidence_status: Column) -> Column:
    """skip: no lookup; exact: whole descriptions only; broad: a search as well."""
    words = tokens(normalize(F.coalesce(phrase, F.lit(""))))
    typed = F.coalesce(kind, F.lit("")) != ""
    skip = F.coalesce(evidence_status == "unanchored", F.lit(False)) | F.coalesce(kind == "context", F.lit(False)) | (~typed & (F.coalesce(points, F.lit(0)) < 4))
    weak = (F.size(words) == 0) | ((F.size(words) == 1) & (F.length(words[0]) < 7)) | (F.coalesce(points, F.lit(0)) < 12)
    return F.when(skip, "skip").when(~typed & weak, "exact").otherwise("broad")
