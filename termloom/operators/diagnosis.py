"""Diagnosis ranking: weights, encounter priority, buckets, exclusion, proposal, explanation.

Weights and patterns are fixed values that results depend on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import english_tag, fold_accents, normalize, tokens
from ..sources.storage import stored

ASSERTION_WEIGHT = {"present": 20, "suspected": 8, "historical": -10, "planned": -18, "absent": -30, "family-history": -36}
SECTION_WEIGHT = [
    ("family|familiar", -18), ("assessment|diagnos|impression|problem list|problemas|evaluaci|valoraci|juicio cl|\\bactive\\b", 22),
    ("chief complaint|reason for|motivo|hpi|present illness|enfermedad actual|consulta", 12), ("exam|explor|findings|resultados|investigation|pruebas", 6),
    ("plan|follow|seguimiento|treatment|tratamiento|medication|procedure|procedimiento", -12), ("history|antecedentes", -8),
]


EVIDENCE_WEIGHT = {"direct": 3, "inferred": 2, "context": -10, "system": -14}
DECISION_WEIGHT = {"accepted": 6, "accepted-inferred": 5, "review": 3, "abstain": -12, "timed-out": -12, "no-code": -22, "rejected": -22}
# the first part that the English tag holds, by the part of the target's name
TAG_WEIGHT = {
    "condition": [("disorder", 18), ("finding", 2), ("event", 4), ("morphologic abnormality", -8), ("body structure", -18), ("procedure", -24), ("regime", -24), ("therapy", -24), ("substance", -30), ("product", -30), ("clinical drug", -30)],
    "observation": [("finding", 14), ("observable entity", 12), ("procedure", -10)],
    "procedure": [("procedure", 18), ("regime", 10), ("therapy", 10), ("disorder", -12)],
}
CLINICAL_FINDING = "404684003"
CONFIDENCE_WEIGHT, MAX_CANDIDATES = 0.3, 3
BUCKET = ["note_id", "concept_id", "assertion", "temporality", "kind", "clinical_status"]
SAME_MENTION = ["note_id", "_phrase", "kind", "assertion", "temporality", "subject"]
CONNECTOR = "(?i)(?<![A-Za-z0-9_])(on a background of|on|sobre)(?![A-Za-z0-9_])"
LINK_WORDS = "the with and for con del los las una por".split()


def _weights(table: dict, value: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[F.lower(F.trim(value))], F.lit(0))


def evidence_weight(evidence: Column, decision: Column) -> Column:
    return _weights(DECISION_WEIGHT, decision) + _weights(EVIDENCE_WEIGHT, evidence)


def tag_weight(tag: Column, target: str = "condition.code") -> Column:
    return _english_weight(english_tag(F.coalesce(tag, F.lit(""))), target)


def _english_weight(english: Column, target: str) -> Column:
    out = F.when(F.lit(False), 0)
    for context, weights in TAG_WEIGHT.items():
        for part, weight in weights if context in target.lower() else ():
            out = out.when(english.contains(part), weight)
    return out.otherwise(0)


def _label(section: Column) -> Column:
    """The section's name without accents, cases and underscores; Note if there is none."""
    plain = F.trim(F.coalesce(section, F.lit("")))
    return F.lower(fold_accents(F.regexp_replace(F.when(plain == "", "Note").otherwise(plain), "_", " ")))


def section_weight(section: Column) -> Column:
    """First pattern that the section's label matches; other labels 2."""
    return _label_weight(_label(section))


def _label_weight(label: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for pattern, weight in SECTION_WEIGHT:
        out = out.when(label.rlike(pattern), weight)
    return out.otherwise(2)


def mention_score(confidence: Column, section: Column, assertion: Column, evidence: Column, decision: Column, tag: Column, target: str = "condition.code") -> Column:
    """0.3 of the confidence in percent, then section, assertion, evidence and tag; unknown values weigh 0."""
    return _points(confidence, section_weight(section), assertion, evidence, decision, tag_weight(tag, target))


def _points(confidence: Column, by_section: Column, assertion: Column, evidence: Column, decision: Column, by_tag: Column) -> Column:
    parts = by_section + _weights(ASSERTION_WEIGHT, assertion) + evidence_weight(evidence, decision) + by_tag
    return F.coalesce(confidence, F.lit(0)) * CONFIDENCE_WEIGHT + parts


def supports(decision: Column, reviewed: Column) -> Column:
    """Whether a mapping can carry a diagnosis: reviewed by hand, accepted or without a decision."""
    return F.coalesce(reviewed, F.lit(False)) | F.coalesce(decision.isin("accepted", "accepted-inferred"), F.lit(True))


def with_priority(entries: DataFrame) -> DataFrame:
    """priority of each mention: 5 a condition as the reason for the visit, 4 the first of an
    assessment, 3 another reason for the visit, 2 another condition in an assessment, 0 else; and
    no less than that of a current, present condition of the patient with the same phrase.
    unresolved: that priority, if the mention is present but no mention of its phrase has a mapping.
    """
    return _prioritized(_read(entries)).drop("_english")


def _read(entries: DataFrame, together: bool = False) -> DataFrame:
    """entries, a note's together, with what patterns say of each: as columns, so that they are matched
    once for each mention and not again wherever a condition needs them. together: they lie so already."""
    none = F.lit("")
    # all windows and groups begin with the note, so its rows meet once; a section is classified once
    rows = (entries if together else entries.repartition("note_id")).withColumn("_label", _label(F.col("section"))).withColumn("_weight", _label_weight(F.col("_label")))
    rows = rows.withColumns({"_numbered": F.coalesce(F.col("sentence").rlike("^\\s*1[.)]\\s"), F.lit(False)), "_english": english_tag(F.coalesce("tag", none))})
    return rows.withColumns({"_phrase": normalize(F.coalesce("phrase", none)), "subject": F.coalesce("subject", F.lit("patient")), "kind": F.coalesce("kind", none), "assertion": F.coalesce("assertion", none), "temporality": F.coalesce("temporality", none)})


def _prioritized(rows: DataFrame) -> DataFrame:
    none = F.lit("")
    present = (F.col("assertion") == "present") & (F.col("subject") == "patient")
    assessment = F.col("_weight") == 22
    source = Window.partitionBy("note_id", "_label", F.coalesce(F.col("section_start").cast("string"), none))
    first = F.min(F.when(present & (F.col("kind") == "condition") & (F.col("temporality") != "unknown") & assessment, F.col("start"))).over(source)
    leads = F.coalesce(F.col("start") == first, F.lit(False)) | F.col("_numbered")
    condition = (F.col("kind") == "condition") | ((F.col("kind") == "") & (F.col("_english") == "disorder"))
    reason = F.col("_label").rlike("chief complaint|reason for|motivo")
    own = F.when(condition & reason, 5).when(condition & assessment & leads, 4).when(reason, 3).when(condition & assessment, 2).otherwise(0)
    rows = rows.withColumn("_own", own)
    same = Window.partitionBy(*SAME_MENTION)
    hint = F.when((F.col("_phrase") != "") & (F.col("kind") == "condition") & present & (F.col("temporality") == "current"), F.max("_own").over(same)).otherwise(0)
    mapped = supports(F.col("decision"), F.col("reviewed"))
    resolved = (F.col("_phrase") != "") & F.max(mapped & F.col("concept_id").isNotNull()).over(same)
    rows = rows.withColumn("priority", F.greatest("_own", hint))
    return rows.withColumn("unresolved", F.when(present & (F.col("temporality") != "unknown") & ~mapped & ~resolved, F.col("priority")).otherwise(0)).drop("_own", "_label", "_numbered")


def scored(entries: DataFrame, target: str = "condition.code", together: bool = False) -> DataFrame:
    """entries with priority, unresolved, score, and reason: why a mention can't count, null if it can.
    together: a note's entries lie in one partition already, and aren't shuffled again.

    entries: note_id, concept_id, term, tag, ancestor_ids, active, phrase, kind, assertion,
    temporality, clinical_status, subject, section, section_start, start, sentence, evidence,
    decision, reviewed, confidence.
    """
    tag = F.col("_english")
    rows = _read(entries, together)
    rows = rows.withColumn("score", _points(F.col("confidence"), F.col("_weight"), F.col("assertion"), F.col("evidence"), F.col("decision"), _english_weight(tag, target)))
    under = F.coalesce((F.col("concept_id") == CLINICAL_FINDING) | F.array_contains("ancestor_ids", CLINICAL_FINDING), F.lit(False))
    finding = F.when(tag != "", tag.isin("disorder", "finding")).otherwise(under)
    reason = (
        F.when(F.coalesce(F.trim("concept_id"), F.lit("")) == "", "no-code")
        .when(~F.col("kind").isin("", "condition", "symptom"), "not-diagnostic")
        .when(~F.coalesce("active", F.lit(True)), "inactive")
        .when(~finding, "not-finding")
        .when(~supports(F.col("decision"), F.col("reviewed")), "mapping-needs-review")
        .when(F.lower(F.trim("subject")) != "patient", "not-patient")
        .when(F.col("score") <= 0, "non-positive-score")
    )
    # neither needs the windows, and a condition on them must not be put together again after those
    return _prioritized(rows.withColumn("reason", reason)).drop("_weight", "_english")


def concepts(found: DataFrame, *carried: str) -> DataFrame:
    """BUCKET of the mentions that count: score, support, confidence, priority, eligible, place, and
    the greatest of each of the columns carried."""
    return _ranked(found.where("reason is null"), [], *carried)


def _ranked(count: DataFrame, apart: list[str], *carried: str) -> DataFrame:
    """concepts() of the mentions that are given. apart: more columns that keep groups apart, by which they are
    placed first, nulls before others."""
    count = count.withColumns({"assertion": F.when(F.col("assertion") == "", "present").otherwise(F.col("assertion")), "clinical_status": F.coalesce("clinical_status", F.lit("unknown"))})
    named = F.min(F.coalesce("term", "concept_id"))
    grouped = count.groupBy(*BUCKET, *apart).agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("support"), F.max(F.coalesce("confidence", F.lit(0))).alias("confidence"), F.max("priority").alias("priority"), named.alias("term"), F.min(english_tag(F.coalesce("tag", F.lit("")))).alias("tag"), F.max("ancestor_ids").alias("ancestor_ids"), *(F.max(c).alias(c) for c in carried))
    scores = grouped.withColumns({"score": F.round(F.col("best") + F.least(4 * (F.col("support") - 1), F.lit(12)), 2), "eligible": (F.col("temporality") != "unknown") & (F.lower("assertion") == "present")})
    order = Window.partitionBy("note_id").orderBy(*(F.col(x).asc_nulls_first() for x in apart), *(F.col(x).desc() for x in ("eligible", "priority", "score", "support", "confidence")), "term", *BUCKET[1:])
    return scores.withColumn("place", F.row_number().over(order))


def _linked(found: DataFrame, principals: DataFrame) -> DataFrame:
    """note_id, concept_id of conditions that a sentence links to the principal one by `on`, with two words in common."""
    current = found.where("kind = 'condition' AND assertion = 'present' AND temporality = 'current' AND subject = 'patient'").where(supports(F.col("decision"), F.col("reviewed")))
    words = lambda text: F.filter(F.array_distinct(tokens(text)), lambda w: (F.length(w) > 2) & ~w.isin(*LINK_WORDS))
    sentence = F.coalesce("sentence", F.lit(""))
    at, size = F.regexp_instr(sentence, F.lit(CONNECTOR)), F.length(F.regexp_extract(sentence, CONNECTOR, 0))
    sides = current.join(principals, ["note_id", "concept_id"], "left_semi").where(at > 0).select("note_id", "_phrase", normalize(sentence.substr(F.lit(1), at - 1)).alias("_left"), normalize(sentence.substr(at + size, F.length(sentence))).alias("_right"))
    sides = sides.where(F.contains("_left", "_phrase")).select("note_id", "_left", "_right").distinct()
    others = current.where("_phrase <> ''").select("note_id", "concept_id", "_phrase").distinct()
    pairs = others.join(sides, "note_id").where(F.contains("_right", "_phrase") & (F.size(F.array_intersect(words(F.col("_left")), words(F.col("_phrase")))) >= 2))
    return pairs.select("note_id", "concept_id").distinct()


def proposal(found: DataFrame, most: int = MAX_CANDIDATES) -> DataFrame:
    """concepts() of scored mentions with roles, sorted: principal, candidate, comorbidity,
    related, symptom, history, suspected. A mention of higher priority that has no usable code
    keeps lower ones from being candidates; a concept above another one of its kind has no role.
    Three steps read the ranks, so they are worked out once and stored.
    """
    waiting = F.max("unresolved").over(Window.partitionBy("note_id"))
    ranks = concepts(found.withColumn("_waiting", waiting), "_waiting")
    able = F.col("eligible") & (F.col("priority") >= F.col("_waiting"))
    # able ones follow each other, as eligible and priority lead the order
    ranks = stored(ranks.withColumns({"_candidate": able & (F.col("place") <= most), "_principal": able & (F.col("place") == 1)}), "ranks")
    key = ["note_id", "temporality", "kind", "assertion"]
    above = ranks.where("eligible").select(*key, F.col("concept_id").alias("_own"), F.explode("ancestor_ids").alias("concept_id")).where("_own <> concept_id").select(*key, "concept_id").distinct().withColumn("_above", F.lit(True))
    linked = _linked(found, ranks.where("_principal").select("note_id", "concept_id")).withColumn("_linked", F.lit(True))
    ranks = ranks.join(above, [*key, "concept_id"], "left").join(linked, ["note_id", "concept_id"], "left")
    active = ~F.col("_principal") & F.col("eligible") & F.col("_above").isNull()
    related, symptom = active & F.col("_linked").isNotNull(), active & ((F.col("kind") == "symptom") | (F.col("tag") == "finding"))
    past = ~F.col("eligible") & ((F.lower("assertion") == "historical") | ((F.lower("assertion") == "present") & (F.col("temporality") == "unknown")))
    roles = {"candidate": F.col("_candidate"), "comorbidity": active & ~related & ~symptom & (F.col("clinical_status") != "resolved"), "history": past, "principal": F.col("_principal"), "related": related, "suspected": ~F.col("eligible") & (F.lower("assertion") == "suspected"), "symptom": symptom}
    return ranks.withColumn("roles", F.array_compact(F.array(*(F.when(x, k) for k, x in roles.items())))).drop("_waiting", "_candidate", "_principal", "_above", "_linked")


def explanation(found: DataFrame) -> DataFrame:
    """How a note's proposal came about: each ranked concept with its place and bucket, then each
    excluded mention with its reason. found: scored() mentions, read once: an excluded one is a group
    of its own, after the ranked."""
    excluded = F.col("reason").isNotNull()
    rows = found.withColumns({"_waiting": F.max("unresolved").over(Window.partitionBy("note_id")), "_alone": F.when(excluded, F.monotonically_increasing_id()), "_term": F.col("term")})
    ranks = _ranked(rows, ["_alone"], "_waiting", "_term", "reason")
    finding = F.coalesce(F.col("tag").isin("disorder", "finding"), F.lit(False))
    low = F.lower("assertion")
    able = F.col("eligible") & (F.col("priority") >= F.col("_waiting")) & (F.col("place") == 1)
    bucket = F.when(able, "principal").when(~finding, "not-a-diagnosis").when(F.col("eligible"), F.when(F.col("tag") == "finding", "symptom").otherwise("comorbidity")).when(low == "historical", "history").when(low == "suspected", "suspected").otherwise("unclassified")
    either = lambda counts, doesnt: F.when(excluded, doesnt).otherwise(counts)
    return ranks.select("note_id", either(F.lit("ranking"), F.lit("excluded")).alias("part"), either(F.col("place"), F.lit(None).cast("int")).alias("place"), "concept_id", either(F.col("term"), F.col("_term")).alias("term"), either(bucket, F.col("reason")).alias("said"), either(F.col("score"), F.col("best")).cast("double").alias("score"))


def rules(spark) -> DataFrame:
    """part, value, weight: the weights that scores are made of."""
    rows = [("assertion", k, float(v)) for k, v in ASSERTION_WEIGHT.items()] + [("evidence", k, float(v)) for k, v in EVIDENCE_WEIGHT.items()] + [("decision", k, float(v)) for k, v in DECISION_WEIGHT.items()]
    rows += [("section", pattern, float(v)) for pattern, v in SECTION_WEIGHT] + [("tag", part, float(v)) for part, v in TAG_WEIGHT["condition"]] + [("confidence", "", CONFIDENCE_WEIGHT)]
    return spark.createDataFrame(rows, "part string, value string, weight double")
