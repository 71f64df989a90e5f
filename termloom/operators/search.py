"""Term search: clauses, match tiers, specificity, rerank, vectors, fusion, facets."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, normalize_text, query_variants, singular, singular_text, tokens
from ..sources.storage import clustered

# Tags that are never searched, English and Spanish.
EXCLUDED_TAGS = (
    "attribute", "atributo", "foundation metadata concept", "metadato fundacional", "core metadata concept", "metadato del núcleo",
    "OWL metadata concept", "concepto de metadatos de OWL", "namespace concept", "espacio de nombres", "link assertion", "relación asertiva",
    "linkage concept", "concepto de enlace", "navigational concept", "concepto para navegación", "special concept", "concepto especial",
    "metadata", "metadato", "foundational metadata", "qualifier value", "calificador", "SNOMED RT+CTV3",
)
# Words that make a term more special than the query asked for.
RELATIONAL = ("due to", "associated with", "with", "without", "following", "secondary to", "complicating", "caused by", "resulting from", "de", "con", "secundaria a", "debido a")


def searchable(terms: DataFrame, excluded: tuple[str, ...] = EXCLUDED_TAGS) -> DataFrame:
    return terms.where(F.col("concept_active") & ~F.coalesce(F.lower("tag").isin(*(x.lower() for x in excluded)), F.lit(False)))


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" "))


def prefix_clause(normalized: Column, query: str) -> Column:
    """The query's tokens in sequence, the last one a prefix."""
    return padded(normalized).contains(f" {normalize_text(query)}")


def phrase_clause(normalized: Column, query: str) -> Column:
    return padded(normalized).contains(f" {normalize_text(query)} ")


def any_clause(normalized: Column, query: str) -> Column:
    words = sorted({w for v in query_variants(query) for w in v.split()})
    return F.arrays_overlap(tokens(normalized), F.array(*map(F.lit, words)))


def fuzzy_clause(normalized: Column, query: str, edits: int = 1, prefix: int = 2) -> Column:
    """Some token within so many edits of the query, with the same first letters."""
    word = normalize_text(query)
    return F.exists(tokens(normalized), lambda x: x.startswith(word[:prefix]) & (F.levenshtein(x, F.lit(word)) <= edits))


@dataclass(frozen=True)
class Clauses:
    """Which clauses a query of this shape gets, with their boosts."""

    concept_id: bool
    prefix: int
    fuzzy: bool
    phrases: tuple[tuple[str, int, int], ...]  # variant, boost on the display term, boost on a synonym
    words: tuple[str, ...]


FEW_WORDS = 6


def plan_clauses(query: str) -> Clauses:
    text = normalize_text(query)
    is_id, single = bool(re.fullmatch("[0-9]{4,}", query.strip())), " " not in text
    if len(text) <= 2:
        return Clauses(is_id, 11, False, (), ())
    if len(text) == 3:
        return Clauses(is_id, 10, True, (), ())
    variants = query_variants(text)
    parts = [text, *variants, *(w for v in variants for w in v.split() if len(w) >= 2)]
    words = {w for x in list(dict.fromkeys(parts))[:FEW_WORDS] for w in x.split()}
    phrases = tuple((v, max(18 - 2 * k, 10), max(15 - 2 * k, 8)) for k, v in enumerate(variants[:2]))
    return Clauses(is_id, 9, single, phrases, tuple(sorted(words)))


def _has_phrase(text: Column, phrase: str) -> Column:
    return padded(text).contains(f" {phrase} ")


def _holds(phrase: str):
    return lambda text: _has_phrase(text, phrase)


def lexical_score(query: str, display: Column, fsn: Column, synonyms: Column, concept_id: Column) -> Column:
    """Sum of the boosts of the clauses that hold; null if none does. Texts are normalized."""
    c, q = plan_clauses(query), normalize_text(query)
    begins = padded(display).contains(f" {q}") if q else F.lit(False)
    if c.fuzzy:
        begins = begins | fuzzy_clause(display, q)
    parts = [(c.prefix, begins)]
    for phrase, shown, meant in c.phrases:
        parts += [(shown, _has_phrase(display, phrase)), (meant, F.exists(synonyms, _holds(phrase)))]
    if c.words:
        wanted = F.array(*map(F.lit, c.words))
        some = lambda text: F.arrays_overlap(tokens(text), wanted)
        parts.append((4, some(display) | some(fsn) | F.exists(synonyms, some)))
    if c.concept_id:
        parts.append((30, concept_id == query.strip()))
    total = sum((F.when(holds, boost).otherwise(0) for boost, holds in parts), F.lit(0))
    return F.when(total > 0, total)


def suggestion_score(query: str, display: Column, concept_id: Column) -> Column:
    """Boosts of the display term's beginnings: of the first two variants, with a typo allowed
    from three letters on; null if none holds."""
    q = normalize_text(query)
    begins = lambda v, fuzzy: padded(display).contains(f" {v}") | (fuzzy_clause(display, v) if fuzzy and " " not in v else F.lit(False))
    if len(q) <= 3:
        parts = [(11 if len(q) <= 2 else 10, begins(q, len(q) == 3))] if q else []
    else:
        parts = [(9 if k == 0 else 7, begins(v, True)) for k, v in enumerate(query_variants(q)[:2])]
    if plan_clauses(query).concept_id:
        parts.append((30, concept_id == query.strip()))
    total = sum((F.when(holds, boost).otherwise(0) for boost, holds in parts), F.lit(0))
    return F.when(total > 0, total)


def phrase_lookup_score(query: str, display: Column, fsn: Column, synonyms: Column) -> Column:
    """Boosts of whole phrases for grounding: up to four variants on display term, synonyms and FSN."""
    parts = []
    for k, v in enumerate(query_variants(query)[:4]):
        base = 14 if k == 0 else 10
        parts += [(base + 4, padded(display).contains(f" {v}")), (base, _has_phrase(display, v)), (base - 1, F.exists(synonyms, _holds(v))), (base - 2, _has_phrase(fsn, v))]
    total = sum((F.when(holds, boost).otherwise(0) for boost, holds in parts), F.lit(0))
    return F.when(total > 0, total)


# ---- stored tables and scoped search


@dataclass(frozen=True)
class SearchTables:
    """terms: the projection, clustered by normalized. index: token and the same columns, clustered
    by token, a row for each distinct token of a row's texts. concepts: the projection with a row for
    each concept. An index that isn't given as listed is stored from it when it is first read, with a
    row for each token of a concept, which its descriptions share; they come apart when it is read.
    It leaves out definitions and texts to embed."""

    terms: DataFrame
    listed: DataFrame | None = None
    concepts: DataFrame | None = None
    partitions: int = 8

    @property
    def tokens(self) -> DataFrame:
        """The rows of the index, in no order and not stored."""
        return token_rows(self.terms) if self.concepts is None else by_description(concept_tokens(self.concepts))

    @cached_property
    def index(self) -> DataFrame:
        if self.listed is not None:
            return self.listed
        return by_description(clustered(concept_tokens(self.concepts), "tokens", "token", "concept_id", partitions=self.partitions))


def token_rows(projected: DataFrame) -> DataFrame:
    texts = F.concat(F.array("normalized", "display", "fsn"), "synonyms")
    return projected.withColumn("token", F.explode(F.array_distinct(F.flatten(F.transform(texts, tokens)))))


def concept_tokens(concepts: DataFrame) -> DataFrame:
    """concepts (terms.concept_rows) by each distinct token of their descriptions' and shared texts;
    shared: a shared text has it."""
    words = lambda texts: F.flatten(F.transform(texts, tokens))
    whole = concepts.drop("definition", "embed_text").withColumn("_shared", F.array_distinct(words(F.concat(F.array("display", "fsn"), "synonyms"))))
    # the shared ones come first
    every = F.array_distinct(F.concat("_shared", words(F.transform("descriptions", lambda d: d["normalized"]))))
    return whole.withColumn("_n", F.size("_shared")).select(*(c for c in whole.columns if c != "_shared"), "_n", F.posexplode(every).alias("_k", "token")).withColumn("shared", F.col("_k") < F.col("_n")).drop("_k", "_n")


def by_description(listed: DataFrame) -> DataFrame:
    """token_rows() of the descriptions in concept_tokens(): those whose own or shared texts have the token."""
    own = F.filter("descriptions", lambda d: F.array_contains(tokens(d["normalized"]), F.col("token")))
    return listed.select(*(c for c in listed.columns if c not in ("descriptions", "shared")), F.inline(F.when(F.col("shared"), F.col("descriptions")).otherwise(own)))


def candidate_rows(tables: SearchTables, query: str) -> DataFrame:
    """The rows that any clause of the query can match, from the token index alone: conditions on
    the token reach its files."""
    c, q = plan_clauses(query), normalize_text(query)
    words = sorted({*c.words, *(w for v in query_variants(q) for w in v.split())})
    wanted = F.col("token").isin(*words) if words else F.lit(False)
    for v in query_variants(q)[:2] or [q]:
        last = v.split(" ")[-1]
        wanted = wanted | F.col("token").startswith(last) | (F.col("token").startswith(last[:2]) if c.fuzzy and len(last) > 2 else F.lit(False))
    found = tables.index.where(wanted).drop("token")
    if c.concept_id:
        found = found.unionByName(tables.terms.where(F.col("concept_id") == query.strip()).select(*found.columns))
    return found.dropDuplicates(["description_id"])


@dataclass(frozen=True)
class Filters:
    """What a search is limited to. scope: a DataFrame of concept_id; with one the area is not asked."""

    language: str | None = None
    release: str | None = None
    area: str | None = None
    kinds: tuple[str, ...] = ("synonym", "fsn")
    scope: DataFrame | None = None


def filtered(rows: DataFrame, by: Filters) -> DataFrame:
    """Rows of active concepts and searchable tags that pass the filters; an empty scope passes none."""
    out = searchable(rows).where(F.col("kind").isin(*by.kinds))
    if by.language:
        out = out.where(F.col("language_code") == by.language)
    if by.release:
        out = out.where(F.col("release_id") == by.release)
    if by.scope is not None:
        return out.join(by.scope.select("concept_id").distinct(), "concept_id", "left_semi")
    if by.area:
        out = out.where(F.array_contains("top_roots", by.area) | (F.col("concept_id") == by.area))
    return out


def over_fetch(limit: int, times: int, most: int) -> int:
    return min(max(times * limit, limit), most)


def scoped_search(tables: SearchTables, query: str, by: Filters, limit: int) -> DataFrame:
    """The best concepts: more rows than asked by score, then tiers, then one row per concept."""
    display, fsn = F.col("display"), F.col("fsn")
    scored = filtered(candidate_rows(tables, query), by).withColumn("score", lexical_score(query, display, fsn, F.col("synonyms"), F.col("concept_id"))).where("score IS NOT NULL")
    fetched = scored.orderBy(F.col("score").desc(), "concept_id", "description_id").limit(over_fetch(limit, 8, 200))
    return tiered(with_tiers(fetched, query), limit)


def scoped_suggestions(tables: SearchTables, query: str, by: Filters, limit: int) -> DataFrame:
    limit = min(max(limit, 1), 25)
    scored = filtered(candidate_rows(tables, query), by).withColumn("score", suggestion_score(query, F.col("display"), F.col("concept_id"))).where("score IS NOT NULL")
    fetched = scored.orderBy(F.col("score").desc(), F.col("is_preferred").desc(), F.col("term_rank").desc(), "term", "concept_id", "description_id").limit(over_fetch(limit, 6, 100))
    return tiered(with_tiers(fetched, query), limit)


def exact_description(tables: SearchTables, phrase: str, by: Filters, limit: int = 100) -> DataFrame:
    """Rows whose whole description is the phrase; the equality reaches the clustered files."""
    hits = filtered(tables.terms.where(F.col("normalized") == normalize_text(phrase)), by).withColumn("score", F.lit(1))
    return hits.orderBy(F.col("is_preferred").desc(), F.col("term_rank").desc(), "concept_id", "description_id").limit(limit)


def phrase_lookup(tables: SearchTables, phrase: str, by: Filters, limit: int) -> DataFrame:
    """Rows with the phrase or its variants, for grounding: more than asked, by score."""
    scored = filtered(candidate_rows(tables, phrase), by).withColumn("score", phrase_lookup_score(phrase, F.col("display"), F.col("fsn"), F.col("synonyms"))).where("score IS NOT NULL")
    return scored.orderBy(F.col("score").desc(), F.col("is_preferred").desc(), F.col("term_rank").desc(), "term", "concept_id", "description_id").limit(min(max(40 * limit, 120), 200))


# ---- tiers


def containment_rank(text: Column, variants: list[str]) -> Column:
    """Of the first variant that fits: 0 equal, 1 begins, 3 contains; 8 if none does, 99 without text."""
    out = F.when(F.coalesce(text, F.lit("")) == "", 99)
    for v in variants:
        out = out.when(text == v, 0).when(text.startswith(v), 1).when(text.contains(v), 3)
    return out.otherwise(8)


def specificity(query: str, term: Column, fsn: Column) -> Column:
    """How much more the better of term and FSN says than the query; 4 decimals, less is better."""
    variants = query_variants(query)
    q = variants[0] if variants else ""
    by_term, by_fsn = containment_rank(term, variants), containment_rank(fsn, variants)
    best = F.when(by_term <= by_fsn, term).otherwise(fsn)
    extra = F.greatest(F.size(tokens(best)) - len(q.split()), F.lit(0))
    relational = sum((F.when(padded(best).contains(f" {w} "), 2).otherwise(0) for w in RELATIONAL), F.lit(0))
    contradicted = sum((F.when(best.contains(f"non{w}"), 8).otherwise(0) for w in q.split() if len(w) >= 5 and f"non{w}" not in q), F.lit(0))
    distance = F.least(F.abs(F.length(best) - len(q)), F.lit(40)) / 10.0
    return F.round(10 * F.least(by_term, by_fsn) + 1.5 * extra + relational + contradicted + distance, 4)


def hit_text(text: Column, query: str) -> Column:
    """The words of a text that the query has, in the text's order: what a highlight shows."""
    words = sorted({w for v in query_variants(query) for w in v.split()})
    return F.array_join(F.filter(tokens(text), lambda w: w.isin(*words) if words else F.lit(False)), " ")


def highlighted(text: Column, query: str) -> Column:
    """The words of a text with those of the query between brackets."""
    words = sorted({w for v in query_variants(query) for w in v.split()})
    return F.array_join(F.transform(tokens(text), lambda w: F.when(w.isin(*words) if words else F.lit(False), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)), " ")


def match_tier(query: str, term: Column, fsn: Column, synonyms: Column, display: Column, concept_id: Column) -> Column:
    """0 id, 1 term, 2 near term, 3 synonym, 4 FSN, 5 lemma, 6 prefix, 7 the beginning of what a
    synonym shares with the query, 8 contains, 9 FSN contains, 10 whole display term, 11 rest.
    Texts are normalized; a query's variants stand in for it up to tier 7."""
    variants, q = query_variants(query), normalize_text(query)
    lemma = lambda x: F.array_join(F.transform(tokens(x), singular), " ")
    own = " ".join(singular_text(w) for w in q.split())
    near = F.when(F.lit(False), False)
    for v in variants:  # the first variant that the term begins with decides
        near = near.when((term == v) | term.startswith(f"{v} "), F.size(tokens(term)) - len(v.split()) <= 1)
    any_of = lambda text: text.isin(*variants) if variants else F.lit(False)
    begins = lambda text: reduce(lambda a, b: a | b, (text.startswith(v) for v in variants), F.lit(False))
    within = lambda text: (text != "") & (text.contains(q) | F.contains(F.lit(q), text)) if q else F.lit(False)
    is_id = (concept_id == query.strip()) if re.fullmatch("[0-9]{4,}", query.strip()) else F.lit(False)
    shared = lambda s: hit_text(s, query)
    return (
        F.when(is_id, 0).when(any_of(term), 1).when(near.otherwise(False), 2).when(F.exists(synonyms, any_of), 3).when(any_of(fsn), 4).when((lemma(term) == own) | (lemma(fsn) == own), 5)
        .when(begins(term), 6).when(F.exists(synonyms, lambda s: begins(shared(s))), 7).when(within(term), 8).when(within(fsn), 9).when(any_of(display), 10).otherwise(11)
    )


def with_tiers(rows: DataFrame, query: str) -> DataFrame:
    """rows with tier, specificity and the distance of the matched text's length."""
    term, fsn, display = F.col("normalized"), F.col("fsn"), F.col("display")
    tier = match_tier(query, term, fsn, F.col("synonyms"), display, F.col("concept_id"))
    return rows.withColumns({"tier": tier, "specificity": specificity(query, term, fsn), "distance": F.abs(F.length("term") - len(query.strip()))})


def tier_order() -> list[Column]:
    return [F.col("tier").asc(), F.col("specificity").asc(), F.col("is_preferred").desc(), F.col("distance").asc(), F.col("term_rank").desc(), F.col("score").desc(), F.col("term").asc(), F.col("concept_id").asc(), F.col("description_id").asc()]


def first_per(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def tiered(rows: DataFrame, limit: int) -> DataFrame:
    """Best row of each concept, then the best concepts, in tier_order()."""
    return first_per(rows, "concept_id", *tier_order()).orderBy(*tier_order()).limit(limit)


# ---- vectors and fusion


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_top(rows: DataFrame, vector: str, query: list[float], limit: int) -> DataFrame:
    """Exact cosine search: one pass, a top-k per partition, no index. Filter rows before."""
    scored = rows.withColumn("score", F.round(cosine(F.col(vector), F.array(*(F.lit(float(x)) for x in query))), 6))
    return scored.orderBy(F.col("score").desc(), "vec_id").limit(limit)


def reciprocal_rank_fusion(left: DataFrame, right: DataFrame, key: str, weights: tuple[float, float] = (0.55, 0.45), k: int = 60) -> DataFrame:
    """key, score, left_rank, right_rank of two ranked lists (columns key, rank)."""
    l, r = left.select(F.col(key), F.col("rank").alias("left_rank")), right.select(F.col(key), F.col("rank").alias("right_rank"))
    share = lambda w, rank: F.coalesce(F.lit(w) / (k + F.col(rank)), F.lit(0.0))
    return l.join(r, key, "full_outer").select(key, F.round(share(weights[0], "left_rank") + share(weights[1], "right_rank"), 9).alias("score"), "left_rank", "right_rank")


def score_fusion(left: DataFrame, right: DataFrame, key: str, weights: tuple[float, float] = (0.55, 0.45)) -> DataFrame:
    """Weighted sum of both scores, each squeezed by a sigmoid."""
    squeeze = lambda c: F.lit(1.0) / (1.0 + F.exp(-F.col(c).cast("double")))
    l, r = left.select(F.col(key), F.col("score").alias("ls")), right.select(F.col(key), F.col("score").alias("rs"))
    part = lambda w, c: F.coalesce(w * squeeze(c), F.lit(0.0))
    return l.join(r, key, "full_outer").select(key, F.round(part(weights[0], "ls") + part(weights[1], "rs"), 6).alias("score"))


@dataclass(frozen=True)
class Tuning:
    """Fusion settings, clamped to what is allowed."""

    lexical: float = 0.55
    semantic: float = 0.45
    k: int = 60
    pool: int = 40

    @classmethod
    def of(cls, lexical: float = 0.55, semantic: float = 0.45, k: int = 60, pool: int = 40) -> "Tuning":
        clamp = lambda x, low, high: min(max(x, low), high)
        lexical, semantic = clamp(lexical, 0.0, 1.0), clamp(semantic, 0.0, 1.0)
        if not lexical and not semantic:
            lexical, semantic = cls.lexical, cls.semantic
        return cls(lexical, semantic, clamp(k, 1, 1000), clamp(pool, 5, 200))


def rerank(fused: DataFrame, scorer, text: str, query: str, pool: int, limit: int) -> DataFrame:
    """The fused list's top pool by a scorer(text column, query) -> column, then the rest in fused
    order up to the limit. fused_place: the place before."""
    order = (F.col("score").desc(), F.col("concept_id").asc())
    # the window sees no more rows than the limit before it
    placed = fused.orderBy(*order).limit(max(pool, limit)).withColumn("fused_place", F.row_number().over(Window.orderBy(*order)))
    scored = placed.withColumn("relevance", F.when(F.col("fused_place") <= pool, scorer(F.col(text), F.lit(query))))
    return scored.orderBy(F.col("relevance").desc_nulls_last(), "fused_place").limit(limit)


def merged_provenance(lexical: DataFrame, semantic: DataFrame, columns: list[str], weights: tuple[float, float] = (0.55, 0.45), k: int = 60) -> DataFrame:
    """One row per concept of two ranked lists (concept_id, rank, score, columns): the lexical
    list's fields where it has them, which lists found it, and what each contributed."""
    side = lambda df, x: df.select("concept_id", F.col("rank").alias(f"{x}_rank"), F.col("score").alias(f"{x}_score"), *(F.col(c).alias(f"{x}_{c}") for c in columns))
    both = side(lexical, "lexical").join(side(semantic, "semantic"), "concept_id", "full_outer")
    part = lambda w, x: F.round(F.coalesce(F.lit(w) / (k + F.col(f"{x}_rank")), F.lit(0.0)), 9)
    found = F.array_compact(F.array(*(F.when(F.col(f"{x}_rank").isNotNull(), x) for x in ("lexical", "semantic"))))
    own, other = part(weights[0], "lexical"), part(weights[1], "semantic")
    return both.select("concept_id", *(F.coalesce(f"lexical_{c}", f"semantic_{c}").alias(c) for c in columns), found.alias("found_by"), "lexical_rank", "semantic_rank", F.col("semantic_score").alias("vector_score"), own.alias("lexical_part"), other.alias("semantic_part"), F.round(own + other, 9).alias("score"))


def fused_term_rows(lexical: DataFrame, semantic: DataFrame, weights: tuple[float, float], limit: int, k: int = 60) -> DataFrame:
    """Fusion of ranked term rows (description_id, rank), then the best row of each concept. Rows
    have concept_id, is_preferred, term_rank."""
    rows = lexical.select("description_id", "concept_id", "is_preferred", "term_rank").unionByName(semantic.select("description_id", "concept_id", "is_preferred", "term_rank")).dropDuplicates(["description_id"])
    scored = reciprocal_rank_fusion(lexical, semantic, "description_id", weights, k).join(rows, "description_id")
    order = (F.col("score").desc(), F.col("is_preferred").desc(), F.col("term_rank").desc())
    return first_per(scored, "concept_id", *order, "description_id").orderBy(*order, "concept_id").limit(limit)


def concat_first_wins(*lists: DataFrame, key: str = "concept_id") -> DataFrame:
    """Rows of several lists in order (pos within each), each key once, at its first place; with
    the fields of its first row, place, and the number of the list it came from."""
    whole = None
    for n, rows in enumerate(lists):
        numbered = rows.withColumn("list", F.lit(n))
        whole = numbered if whole is None else whole.unionByName(numbered, allowMissingColumns=True)
    return first_per(whole.where(F.col(key).isNotNull()), key, "list", "pos")


def with_provenance(exact: DataFrame, hybrid: DataFrame, columns: list[str]) -> DataFrame:
    """exact rows with the hybrid list's columns where it found the same concept too."""
    other = hybrid.select("concept_id", *(F.col(c).alias(f"_{c}") for c in columns))
    return exact.join(other, "concept_id", "left").select(*exact.columns, *(F.col(f"_{c}").alias(c) for c in columns))


# ---- offline discovery

# Words that don't count in discovery, and words of procedures that it may leave out.
DISCOVERY_STOPWORDS = "the of in with and for due to a de del en con la el los las por para y or on both ambos bilateral".split()
DISCOVERY_NEUTRAL = "test tests measurement measurements level procedure review referral repeat visit follow up medicion prueba analitica revision derivacion consulta repetir valoracion control".split()
MOST_DISCOVERED = 12


def discovery_variants(phrase: str) -> list[list[str]]:
    """Sets of words to look for, strictest first: all, the telling ones, those without one each,
    the longest alone."""
    every = [w for w in normalize_text(phrase).split() if w not in DISCOVERY_STOPWORDS]
    core = [w for w in every if w not in DISCOVERY_NEUTRAL]
    longest = sorted(core, key=lambda w: -len(w))[:1]
    return [x[:8] for x in (every, core, *([w for j, w in enumerate(core) if j != i] for i in range(len(core))), longest) if x]


def discovered(terms: DataFrame, phrase: str, most: int = MOST_DISCOVERED) -> DataFrame:
    """The best concepts for a phrase by sets of words that a description holds, in any order:
    whole descriptions first, then by strictness, by words beyond, by term."""
    words = tokens(F.col("normalized"))
    tier = F.when(F.lit(False), 0)
    for k, wanted in enumerate(discovery_variants(phrase)):
        tier = tier.when(F.size(F.array_except(F.array(*map(F.lit, wanted)), words)) == 0, k)
    beyond = F.size(F.filter(words, lambda w: ~w.isin(*DISCOVERY_STOPWORDS, *DISCOVERY_NEUTRAL)))
    hits = terms.withColumns({"tier": tier, "exact": F.col("normalized") == normalize_text(phrase), "beyond": beyond}).where("tier IS NOT NULL")
    order = (F.col("exact").desc(), "tier", "beyond", "term", "concept_id", "description_id")
    return first_per(hits, "concept_id", *order).orderBy(*order).limit(most)


# ---- views of a result


EXPLORER_SORTS = {"term": ["term"], "concept_id": ["concept_id"], "match": ["tier"], "rank": []}


def explorer(rows: DataFrame, sort: str = "rank", preferred_only: bool = False, **equal: str | None) -> DataFrame:
    """A ranked result (column rank) as filters leave it: columns with a value other than None must equal it."""
    if sort not in EXPLORER_SORTS:
        raise ValueError(f"unknown order {sort!r}")
    out = rows.where("is_preferred") if preferred_only else rows
    for column, value in equal.items():
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.orderBy(*EXPLORER_SORTS[sort], "rank")


def value_set_members(members: DataFrame, tag: str | None = None, text: str = "") -> DataFrame:
    """Members with the tag whose term, FSN or id holds the text."""
    out = members if tag is None else members.where(F.col("tag") == tag)
    needle = normalize_text(text)
    return out.where(normalize(F.concat_ws(" ", "term", "fsn", "concept_id")).contains(needle)) if needle else out


def embedding_estimate(rows: DataFrame) -> DataFrame:
    """docs, tokens that embedding the rows' texts would take, four characters to a token."""
    return rows.where("embed_text IS NOT NULL").agg(F.count(F.lit(1)).alias("docs"), F.ceil(F.coalesce(F.sum(F.length("embed_text")), F.lit(0)) / 4).cast("long").alias("tokens"))


EMBED_CHARACTERS = 4000


def embedded(rows: DataFrame, embed, dimensions: int) -> DataFrame:
    """rows with a vector for those that lack one: embed(list of texts) -> list of lists, called on
    Arrow batches; it stands for an external service."""
    import pandas as pd

    has = rows.where("vector IS NOT NULL OR embed_text IS NULL")
    schema = rows.schema

    def run(batches):
        for frame in batches:
            made = embed([x[:EMBED_CHARACTERS] for x in frame["embed_text"]])
            if any(len(v) != dimensions for v in made):
                raise ValueError(f"a vector hasn't {dimensions} dimensions")
            yield frame.assign(vector=pd.Series(list(made), index=frame.index, dtype=object))

    return has.unionByName(rows.where("vector IS NULL AND embed_text IS NOT NULL").mapInPandas(run, schema))


def hashed_embedding(texts: list[str], dimensions: int = 16) -> list[list[float]]:
    """Deterministic stand-in for an embedding service: counts of words by their CRC."""
    import zlib

    out = []
    for text in texts:
        v = [0.0] * dimensions
        for w in normalize_text(text).split():
            v[zlib.crc32(w.encode()) % dimensions] += 1.0
        out.append(v)
    return out


def overlap_scorer(text: Column, query: Column) -> Column:
    """Deterministic stand-in for a cross-encoder: shared words over all words."""
    a, b = F.array_distinct(tokens(F.lower(text))), F.array_distinct(tokens(F.lower(query)))
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def facets(rows: DataFrame, *columns: str) -> DataFrame:
    """facet, value, n for each column, in one pass by grouping sets."""
    sets = [[c] for c in columns]
    grouped = rows.groupingSets(sets, *columns).agg(F.count(F.lit(1)).alias("n"), *(F.grouping(c).alias(f"g_{c}") for c in columns))
    facet, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in columns:
        facet, value = F.when(F.col(f"g_{c}") == 0, c).otherwise(facet), F.when(F.col(f"g_{c}") == 0, F.col(c).cast("string")).otherwise(value)
    return grouped.select(facet.alias("facet"), value.alias("value"), "n")
