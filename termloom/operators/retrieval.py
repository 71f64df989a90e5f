"""Candidates for many phrases at once, and notes grounded from text to decision.

Phrases repeat far more often than notes, so candidates are found once for each distinct phrase
and joined back. A phrase that is a whole description meets the projection by equality. Others
meet the token index by their rarest word, and the posting lists of their other words cut what it
gives at once: every tier but the last needs all of a phrase's words. What follows in the last
tier doesn't depend on the phrase, only on the word, so the first rows of the rarest word's list
are all that can come next, however long the list is. Nothing is cut off: the result is that of
the whole list.

With vectors, a phrase's lexical candidates and its nearest rows are fused by their ranks, and
whole descriptions come before both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens, variants
from ..sources.storage import stored
from . import notes as N
from .grounding import grounded, lookup_plan
from .search import SearchTables, Tuning, searchable
from .vectors import VectorIndex, nearest_join

#: Candidates of a phrase, as many as the reference's pool.
PER_PHRASE = 20
COLUMNS = ("concept_id", "description_id", "term", "normalized", "display", "display_term", "fsn", "synonyms", "tag", "is_preferred", "term_rank")


def _tier(phrase, row):
    """Tiers of a batch of phrases: whole term, near term, synonym, FSN, beginning, part, FSN's part, rest."""
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    near = F.startswith(row("normalized"), F.concat(phrase, F.lit(" "))) & (F.size(tokens(row("normalized"))) - F.size(tokens(phrase)) <= 1)
    return (
        F.when(row("normalized") == phrase, 1).when(near, 2).when(F.array_contains(row("synonyms"), phrase), 3).when(row("fsn") == phrase, 4).when(F.startswith(row("normalized"), phrase), 6)
        .when(F.contains(pad(row("normalized")), pad(phrase)), 8).when(F.contains(pad(row("fsn")), pad(phrase)), 9).otherwise(11)
    )


def _placed() -> list[Column]:
    """The order of candidates of one tier, which is all that the last tier goes by."""
    return [F.col("is_preferred").desc(), F.col("term_rank").desc(), F.col("concept_id").asc()]


def _lookup_score(forms: Column, row) -> Column:
    """search.phrase_lookup_score() of a batch: forms are a phrase's variants."""
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    total = F.lit(0)
    for k in range(4):
        form, base = F.get(forms, F.lit(k)), 14 if k == 0 else 10
        has = lambda text, form=form: F.contains(pad(text), pad(form))
        begins = F.contains(pad(row("display")), F.concat(F.lit(" "), form))
        for holds, boost in ((begins, base + 4), (has(row("display")), base), (F.exists(row("synonyms"), _holding(form)), base - 1), (has(row("fsn")), base - 2)):
            total = total + F.when(holds, boost).otherwise(0)
    return total.cast("double")


def _holding(form: Column):
    return lambda text: F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), form, F.lit(" ")))


def candidates(phrases: DataFrame, tables: SearchTables, limit: int = PER_PHRASE) -> DataFrame:
    """phrase, pos, strategy, search_score and COLUMNS of the best concepts of each phrase: exact
    descriptions first, then what has its rarest word, by tier. phrases: phrase (normalized,
    distinct), plan."""
    wanted = phrases.where("plan <> 'skip'").select("phrase", "plan")
    rows = searchable(tables.terms).select(*COLUMNS)
    whole = wanted.join(rows, F.col("phrase") == F.col("normalized")).withColumn("strategy", F.lit("exact"))
    broad = wanted.where("plan = 'broad'").withColumn("words", F.filter(F.array_distinct(tokens(F.col("phrase"))), lambda w: F.length(w) > 1))
    index = searchable(tables.index)
    words = broad.select("phrase", "words", F.explode("words").alias("token"))
    frequency = index.join(words.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = stored(words.join(frequency, "token").groupBy("phrase", "words").agg(F.min(F.struct("n", "token")).alias("r")).select("phrase", "words", F.col("r.token").alias("token")), "rarest")
    held = F.array_distinct(F.flatten(F.transform(F.concat(F.array("normalized", "display", "fsn"), "synonyms"), tokens)))
    lists = index.join(rarest.select("token").distinct(), "token", "left_semi").select("token", *COLUMNS, held.alias("held"))
    every = rarest.join(lists, "token").where(F.size(F.array_except("words", "held")) == 0).drop("words", "held", "token")
    # of each list the first concepts in the order of the last tier, a row each: as many may be placed higher up
    first_rows = lists.drop("held").withColumn("_k", F.row_number().over(Window.partitionBy("token", "concept_id").orderBy(*_placed(), "description_id"))).where("_k = 1")
    heads = first_rows.withColumn("_k", F.row_number().over(Window.partitionBy("token").orderBy(*_placed()))).where(F.col("_k") <= limit).drop("_k")
    rest = rarest.select("phrase", "token").join(heads, "token").drop("token")
    shared = every.unionByName(rest).withColumn("strategy", F.lit("broad"))
    found = whole.drop("plan").unionByName(shared).withColumn("tier", _tier(F.col("phrase"), F.col))
    found = found.withColumn("strategy", F.when(F.col("tier") == 1, "exact").otherwise(F.col("strategy")))
    order = ("tier", F.col("is_preferred").desc(), F.col("term_rank").desc())
    first = found.withColumn("_k", F.row_number().over(Window.partitionBy("phrase", "concept_id").orderBy(*order, "description_id"))).where("_k = 1").drop("_k")
    placed = first.withColumn("pos", F.row_number().over(Window.partitionBy("phrase").orderBy(*order, "concept_id"))).where(F.col("pos") <= limit)
    forms = wanted.select(F.col("phrase").alias("_phrase"), variants(F.col("phrase")).alias("_forms"))
    met = placed.join(forms, F.col("phrase") == F.col("_phrase"))
    return met.withColumn("search_score", _lookup_score(F.col("_forms"), F.col)).drop("_phrase", "_forms")


def hybrid_candidates(phrases: DataFrame, tables: SearchTables, index: VectorIndex, limit: int = PER_PHRASE, tuning: Tuning = Tuning(), exact: bool = False) -> DataFrame:
    """phrase, concept_id, pos, strategy, lexical_rank, semantic_rank, fused: whole descriptions
    first, in their own order, then the fused list of lexical candidates and nearest rows.

    phrases: phrase, plan, vector. index: by description_id, of the rows of tables.terms that have
    a vector. A concept's nearest row stands for it; phrases that aren't asked broadly get whole
    descriptions alone.
    """
    lexical = candidates(phrases.select("phrase", "plan"), tables, tuning.pool)
    asked = phrases.where("plan = 'broad' AND vector IS NOT NULL").select(F.col("phrase").alias("query"), "vector")
    concepts = tables.terms.select(F.col("description_id").alias("id"), "concept_id")
    # a concept has several rows, so more are asked for than concepts are wanted
    near = nearest_join(index, asked, 4 * tuning.pool, exact=exact).join(concepts, "id")
    once = near.withColumn("_k", F.row_number().over(Window.partitionBy("query", "concept_id").orderBy("rank"))).where("_k = 1")
    semantic = once.select(F.col("query").alias("phrase"), "concept_id", F.row_number().over(Window.partitionBy("query").orderBy("rank")).alias("semantic_rank")).where(F.col("semantic_rank") <= tuning.pool)
    both = lexical.select("phrase", "concept_id", F.col("pos").alias("lexical_rank"), (F.col("tier") == 1).alias("whole")).join(semantic, ["phrase", "concept_id"], "full_outer")
    part = lambda w, r: F.coalesce(F.lit(w) / (tuning.k + F.col(r)), F.lit(0.0))
    fused = both.withColumns({"whole": F.coalesce("whole", F.lit(False)), "fused": F.round(part(tuning.lexical, "lexical_rank") + part(tuning.semantic, "semantic_rank"), 9)})
    order = (F.col("whole").desc(), F.when(F.col("whole"), F.col("lexical_rank")), F.col("fused").desc(), "concept_id")
    placed = fused.withColumn("pos", F.row_number().over(Window.partitionBy("phrase").orderBy(*order))).where(F.col("pos") <= limit)
    return placed.select("phrase", "concept_id", "pos", F.when(F.col("whole"), "exact").otherwise("hybrid").alias("strategy"), "lexical_rank", "semantic_rank", "fused")


#: What a mention's decision depends on.
SIGNATURE = ["normalized", "n_tokens", "assertion", "relation_cue", "plan"]
DECISION = ["concept_id", "candidate", "tag", "score", "margin", "confidence", "status", "evidence", "reasons"]


def ground_notes(notes: DataFrame, key: str, text: str, tables: SearchTables, most: int = N.MAX_PHRASES) -> DataFrame:
    """Every note's phrases with their decisions: read, looked up, scored and judged. Mentions with
    the same phrase, length and context have the same decision, which is made once for all."""
    read = stored(N.phrases(notes, key, text, most), "mentions").withColumn("mention_id", F.concat_ws("-", key, "k"))
    mentions = read.withColumn("plan", lookup_plan(F.col("phrase"), F.col("points"), F.lit(None).cast("string"), F.lit("anchored")))
    own = mentions.select(*SIGNATURE).distinct()
    kinds = stored(own.select("*", F.concat_ws("|", *(F.col(c).cast("string") for c in SIGNATURE)).alias("mention_id"), F.col("normalized").alias("phrase"), F.lit(None).cast("string").alias("kind")), "signatures")
    rank = F.when(F.col("plan") == "broad", 2).when(F.col("plan") == "exact", 1).otherwise(0)
    asked = kinds.groupBy("phrase").agg(F.max_by("plan", rank).alias("plan"))
    found = candidates(asked, tables).withColumnRenamed("phrase", "normalized_phrase")
    met = kinds.where("plan <> 'skip'").select("mention_id", F.col("normalized").alias("normalized_phrase"), F.col("plan").alias("own_plan")).join(found, "normalized_phrase").where("own_plan = 'broad' OR strategy = 'exact'")
    rows = met.select(
        "mention_id", "pos", "concept_id", F.col("display_term").alias("term"), F.col("term").alias("matched"), F.concat(F.array("term", "display", "fsn"), "synonyms").alias("descriptions"), "tag", "tier", F.col("is_preferred").alias("preferred"),
        F.col("term_rank").alias("rank"), "search_score", F.lit(None).cast("double").alias("rerank_score"), F.lit(True).alias("active"),
    )
    decided = stored(grounded(kinds, rows).select(*SIGNATURE, *DECISION), "decisions")
    return mentions.join(decided, SIGNATURE).drop("plan")
