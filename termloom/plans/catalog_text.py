"""Queries on the text and vector indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieval as V
from ..operators import search as S
from ..operators import textindex as X
from ..operators import vectors as W
from ..sources.views import Tables, tables
from .oracle_views import with_views

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None, *views: str, **ctes: str):
    def register(f):
        QUERIES[name] = lambda spark, folder: f(tables(spark, folder))
        if sql:
            SQL[name] = with_views(sql, *views, **ctes)
        return f

    return register


# ---- scored search

_TOKENS = dict(
    d="SELECT * FROM terms WHERE concept_active",
    fw="SELECT description_id AS doc, 'display' AS field, unnest(string_split(display, ' ')) AS token FROM d UNION ALL SELECT description_id, 'fsn', unnest(string_split(fsn, ' ')) FROM d UNION ALL SELECT description_id, 'synonyms', unnest(string_split(array_to_string(synonyms, ' '), ' ')) FROM d",
    tf="SELECT token, field, doc, count(*) AS f FROM fw WHERE token <> '' GROUP BY ALL",
    ln="SELECT field, doc, sum(f) AS n FROM tf GROUP BY ALL",
    mean="SELECT field, avg(n) AS mean FROM ln GROUP BY field",
    df="SELECT token, field, count(*) AS documents FROM tf GROUP BY ALL",
    bm="SELECT token, field, doc, ln(1 + ((SELECT count(*) FROM d) - documents + 0.5) / (documents + 0.5)) * f / (f + 1.2 * (1 - 0.75 + 0.75 * n / mean)) AS part FROM tf JOIN df USING (token, field) JOIN ln USING (field, doc) JOIN mean USING (field)",
)


def _best(words: str, limit: int, boosts: str = "4.0", where: str = "true") -> str:
    return f"SELECT doc AS description_id, round(sum({boosts} * part), 6)::DOUBLE AS score FROM bm WHERE token IN ({words}) AND {where} GROUP BY doc ORDER BY score DESC, doc LIMIT {limit}"


@query("search_bm25", _best("'small', 'widget', 'part'", 30), "terms", **_TOKENS)
def search_bm25(t: Tables) -> DataFrame:
    """Two telling words and one that every part's FSN has."""
    return X.bm25_top(t.text_index, "Small widget (part)", 30).select(F.col("doc").alias("description_id"), "score")


@query("search_bm25_boosts", _best("'brand', '13', 'bolt'", 25, "CASE field WHEN 'display' THEN 6.0 ELSE 1.5 END", "field <> 'fsn'"), "terms", **_TOKENS)
def search_bm25_boosts(t: Tables) -> DataFrame:
    return X.bm25_top(t.text_index, "Brand#13 bolt", 25, {"display": 6.0, "synonyms": 1.5}).select(F.col("doc").alias("description_id"), "score")


@query("search_bm25_scoped", _best("'red', 'gear', 'item'", 20, where="doc IN (SELECT description_id FROM d WHERE language_code = 'es' AND list_contains(top_roots, '510001'))"), "terms", **_TOKENS)
def search_bm25_scoped(t: Tables) -> DataFrame:
    allowed = S.filtered(t.search.terms, S.Filters("es", area="510001")).select(F.col("description_id").alias("doc"))
    return X.bm25_top(t.text_index, "red gear item", 20, allowed=allowed).select(F.col("doc").alias("description_id"), "score")


@query("search_bm25_words", "SELECT token, field, documents, round(ln(1 + ((SELECT count(*) FROM d) - documents + 0.5) / (documents + 0.5)), 6) AS idf, round(max(part), 6) AS bound FROM bm JOIN df USING (token, field) GROUP BY ALL", "terms", **_TOKENS)
def search_bm25_words(t: Tables) -> DataFrame:
    """Every word's statistics and the most that a posting of it scores."""
    return t.text_index.words.select("token", "field", "documents", F.round("idf", 6).alias("idf"), F.round("bound", 6).alias("bound"))


@query("phrase_positions", "SELECT description_id, (len(string_split(substr(' ' || fsn || ' ', 1, instr(' ' || fsn || ' ', ' widget part ')), ' ')) - 2)::INT AS start FROM terms WHERE concept_active AND contains(' ' || fsn || ' ', ' widget part ')", "terms")
def phrase_positions(t: Tables) -> DataFrame:
    return X.phrase_documents(t.text_index, "Widget (part)", "fsn").select(F.col("doc").alias("description_id"), "start")


_LOOSE = dict(p="SELECT description_id, unnest(range(len(w))) AS k, w FROM (SELECT description_id, string_split(fsn, ' ') AS w FROM terms WHERE concept_active)", pairs="SELECT a.description_id, a.k AS a, min(b.k) AS b FROM p a JOIN p b ON a.description_id = b.description_id AND b.k > a.k AND a.w[a.k + 1] = 'red' AND b.w[b.k + 1] = 'part' GROUP BY ALL")


@query("phrase_positions_slop", "SELECT description_id, min(a)::INT AS start FROM pairs WHERE b - a - 1 <= 1 GROUP BY description_id", "terms", **_LOOSE)
def phrase_positions_slop(t: Tables) -> DataFrame:
    """Two words with at most one between them."""
    return X.phrase_documents(t.text_index, "red part", "fsn", slop=1).select(F.col("doc").alias("description_id"), "start")


# ---- fragments

_RUN = "[\\p{L}\\p{N}]+"
_SHOWN = dict(
    tx="SELECT description_id, 'term' AS path, term AS text FROM terms WHERE concept_active UNION ALL SELECT description_id, 'definition', definition FROM terms WHERE concept_active AND definition IS NOT NULL",
    sp=f"SELECT *, regexp_extract_all(text, '{_RUN}') AS m, string_split_regex(text, '{_RUN}') AS g FROM tx",
    ws="SELECT description_id, path, text, k, m[k + 1] AS word, lower(strip_accents(m[k + 1])) AS normal, (list_sum(list_transform(g[1:k + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k], lambda x: length(x))), 0))::INT AS a FROM (SELECT *, unnest(range(len(m))) AS k FROM sp)",
    hit="SELECT * FROM ws WHERE normal IN ('named', 'red', 'widget', 'widgets', 'part')",
    win="SELECT x.description_id, x.path, any_value(x.text) AS text, x.k, count(DISTINCT y.normal) AS different, count(*) AS n, min(y.a)::INT AS a, max(y.a + length(y.word))::INT AS b, string_agg(y.word, ' ' ORDER BY y.k) AS hit FROM hit x JOIN hit y ON x.description_id = y.description_id AND x.path = y.path AND y.k >= x.k AND y.k < x.k + 3 GROUP BY x.description_id, x.path, x.k",
)


@query("highlight_fragments", "SELECT description_id, path, substr(text, a + 1, b - a) AS fragment, a AS start, b AS \"end\", hit, n::INT AS hits FROM win QUALIFY row_number() OVER (PARTITION BY description_id, path ORDER BY different DESC, n DESC, k) = 1", "terms", **_SHOWN)
def highlight_fragments(t: Tables) -> DataFrame:
    """The best three words of each term and definition, as they are written."""
    found = X.fragments(S.searchable(t.search.terms), "description_id", "named red Widgets part", "term", "definition", most=3)
    return found.select("description_id", "path", "fragment", "start", "end", "hit", F.size("hits").alias("hits"))


# ---- beginnings and typos


@query("autocomplete_grams", "SELECT description_id FROM terms WHERE concept_active AND contains(' ' || display, ' red wi')", "terms")
def autocomplete_grams(t: Tables) -> DataFrame:
    return X.completions(t.beginnings, "Red wi").select(F.col("doc").alias("description_id"))


_VOCABULARY = dict(v="SELECT DISTINCT unnest(string_split(display, ' ')) AS token FROM terms WHERE concept_active", q="SELECT DISTINCT token[1:2] || token[4:] AS query FROM v WHERE length(token) > 4 UNION SELECT token[1:2] || 'x' || token[3:] FROM v UNION SELECT token[1:3] || 'q' || token[5:] FROM v WHERE length(token) > 3")


@query("fuzzy_vocabulary", "SELECT query, token FROM q JOIN v ON query[1:2] = token[1:2] AND abs(length(query) - length(token)) <= 1 AND levenshtein(query, token) <= 1", "terms", **_VOCABULARY)
def fuzzy_vocabulary(t: Tables) -> DataFrame:
    """Every word with a letter less, more and replaced, against the whole vocabulary at once."""
    token = F.col("token")
    words = t.beginnings.words.select("token")
    less = words.where(F.length(token) > 4).select(F.concat(F.substring(token, 1, 2), F.expr("substring(token, 4)")).alias("query"))
    more = words.select(F.concat(F.substring(token, 1, 2), F.lit("x"), F.expr("substring(token, 3)")).alias("query"))
    other = words.where(F.length(token) > 3).select(F.concat(F.substring(token, 1, 3), F.lit("q"), F.expr("substring(token, 5)")).alias("query"))
    return X.within_one_edit(less.union(more).union(other).distinct(), t.beginnings.near)


@query("fuzzy_documents", "SELECT DISTINCT description_id FROM (SELECT description_id, unnest(string_split(display, ' ')) AS token FROM terms WHERE concept_active) WHERE token[1:2] = 'wi' AND levenshtein(token, 'widgt') <= 1", "terms")
def fuzzy_documents(t: Tables) -> DataFrame:
    return X.fuzzy_documents(t.beginnings, "widgt").select(F.col("doc").alias("description_id"))


# ---- vectors

_NEAR = "SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS score FROM embeddings"


def _asked(t: Tables) -> list[float]:
    return list(t.table("embeddings").where("vec_id = 7").first()["embedding"])


@query("vector_index_exact", f"{_NEAR} ORDER BY score DESC, vec_id LIMIT 20")
def vector_index_exact(t: Tables) -> DataFrame:
    return W.index_top(t.vectors, _asked(t), 20, exact=True).select("vec_id", "label", "score")


@query("vector_index_filtered", f"{_NEAR} WHERE label IN (2, 4) AND vec_id % 3 = 0 ORDER BY score DESC, vec_id LIMIT 10")
def vector_index_filtered(t: Tables) -> DataFrame:
    return W.index_top(t.vectors, _asked(t), 10, F.col("label").isin(2, 4) & (F.col("vec_id") % 3 == 0), exact=True).select("vec_id", "label", "score")


@query("vector_nearest_join", "SELECT a.vec_id::VARCHAR AS query, b.vec_id::VARCHAR AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id::VARCHAR)::INT AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 QUALIFY rank <= 10")
def vector_nearest_join(t: Tables) -> DataFrame:
    """The ten nearest rows of every hundredth row."""
    asked = t.table("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return W.exact_join(t.table("embeddings"), "vec_id", "embedding", asked, 10)


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(text) -> F.Column:
    """A vector that SQL can follow, in place of an embedding service's."""
    return F.array(*((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in _LETTERS))


def _letters(column: str) -> str:
    return "[" + ", ".join(f"(length({column}) - length(replace({column}, '{c}', '')))::DOUBLE" for c in _LETTERS) + "]"


_HYBRID = dict(
    w="SELECT DISTINCT lower(p_type) AS phrase FROM part UNION SELECT DISTINCT 'shiny ' || split_part(p_name, ' ', 2) FROM part",
    ix="SELECT DISTINCT description_id, concept_id, normalized, fsn, synonyms, is_preferred, term_rank, unnest(string_split(normalized || ' ' || display || ' ' || fsn || ' ' || array_to_string(synonyms, ' '), ' ')) AS token FROM terms WHERE concept_active",
    fr="SELECT token, count(*) AS n FROM ix GROUP BY token",
    ra="SELECT phrase, min((n, token)) AS r FROM (SELECT phrase, unnest(string_split(phrase, ' ')) AS token FROM w) JOIN fr USING (token) WHERE length(token) > 1 GROUP BY phrase",
    hit="SELECT phrase, description_id, concept_id, normalized, fsn, synonyms, is_preferred, term_rank FROM ra JOIN ix ON token = r[2] UNION SELECT phrase, description_id, concept_id, normalized, fsn, synonyms, is_preferred, term_rank FROM w JOIN terms ON normalized = phrase WHERE concept_active",
    ti="""SELECT *, CASE WHEN normalized = phrase THEN 1 WHEN starts_with(normalized, phrase || ' ') AND len(string_split(normalized, ' ')) - len(string_split(phrase, ' ')) <= 1 THEN 2 WHEN list_contains(synonyms, phrase) THEN 3 WHEN fsn = phrase THEN 4 WHEN starts_with(normalized, phrase) THEN 6
  WHEN contains(' ' || normalized || ' ', ' ' || phrase || ' ') THEN 8 WHEN contains(' ' || fsn || ' ', ' ' || phrase || ' ') THEN 9 ELSE 11 END AS tier FROM hit""",
    fi="SELECT * FROM ti QUALIFY row_number() OVER (PARTITION BY phrase, concept_id ORDER BY tier, is_preferred DESC, term_rank DESC, description_id) = 1",
    lex="SELECT phrase, concept_id, tier, row_number() OVER (PARTITION BY phrase ORDER BY tier, is_preferred DESC, term_rank DESC, concept_id) AS r FROM fi QUALIFY r <= 40",
    vecs=f"SELECT description_id, concept_id, {_letters('normalized')} AS v FROM terms WHERE concept_active AND is_preferred AND tag IN ('part', 'type', 'brand')",
    cs=f"SELECT phrase, description_id, concept_id, round(list_cosine_similarity({_letters('phrase')}, v), 6) AS score FROM w, vecs",
    near="SELECT phrase, concept_id, row_number() OVER (PARTITION BY phrase ORDER BY score DESC, description_id) AS place FROM cs QUALIFY place <= 160",
    sem="SELECT phrase, concept_id, row_number() OVER (PARTITION BY phrase ORDER BY min(place)) AS s FROM near GROUP BY phrase, concept_id QUALIFY s <= 40",
    fu="SELECT coalesce(l.phrase, s.phrase) AS phrase, coalesce(l.concept_id, s.concept_id) AS concept_id, coalesce(tier = 1, false) AS whole, r, s, round(coalesce(0.55 / (60 + r), 0) + coalesce(0.45 / (60 + s), 0), 9)::DOUBLE AS fused FROM lex l FULL JOIN sem s ON l.phrase = s.phrase AND l.concept_id = s.concept_id",
)


@query("note_candidates_hybrid", "SELECT phrase, concept_id, row_number() OVER (PARTITION BY phrase ORDER BY whole DESC, CASE WHEN whole THEN r END, fused DESC, concept_id)::INT AS place, CASE WHEN whole THEN 'exact' ELSE 'hybrid' END AS strategy, r::INT AS lexical_rank, s::INT AS semantic_rank, fused FROM fu QUALIFY place <= 20", "terms", **_HYBRID)
def note_candidates_hybrid(t: Tables) -> DataFrame:
    """Phrases by words and by vectors, fused; some are whole descriptions, some no description at all."""
    part = t.table("part")
    phrases = part.select(F.lower("p_type").alias("phrase")).union(part.select(F.concat(F.lit("shiny "), F.split("p_name", " ")[1]))).distinct()
    asked = phrases.withColumns({"plan": F.lit("broad"), "vector": letter_counts(F.col("phrase"))})
    found = V.hybrid_candidates(asked, t.search, t.term_vectors, exact=True)
    return found.select("phrase", "concept_id", F.col("pos").alias("place"), "strategy", "lexical_rank", "semantic_rank", "fused")


# ---- the extractor


@query("extracted_mentions", "SELECT o_orderkey AS note_id, 'ok' AS status, 3::BIGINT AS n, 'Order' || o_orderkey AS first_phrase FROM orders")
def extracted_mentions(t: Tables) -> DataFrame:
    """A text for every order through the local stand-in of the service, in windows of forty characters."""
    from ..operators.extraction import Answers, capitalized_words, extract

    text = F.concat(F.lit("Order"), F.col("o_orderkey").cast("string"), F.lit(" was seen by the patient today. Then a Plan was made and nothing else at all."))
    notes = t.table("orders").select(F.col("o_orderkey").alias("note_id"), text.alias("text"))
    found = extract(notes, "note_id", "text", capitalized_words, "stand-in", Answers(t.spark), size=40)
    return found.select("note_id", "status", F.size("mentions").cast("long").alias("n"), F.get_json_object(F.col("mentions")[0], "$.phrase").alias("first_phrase"))
