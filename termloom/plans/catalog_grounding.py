"""Queries on notes' texts and on the grounding of their mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize, tokens
from ..operators import grounding as G
from ..operators import notes as N
from ..operators import retrieval as V
from ..operators.anchoring import anchored, window_rows
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


# a text for each order, of four forms, about things that parts are called
_FIRST, _SECOND = ("red", "blue", "small", "large", "hot", "cold", "green"), ("bolt", "widget", "rod", "gear", "plate", "ring")
_TEXTS = dict(
    words=f"SELECT o_orderkey AS note_id, {list(_FIRST)}[o_orderkey % 7 + 1] || ' ' || {list(_SECOND)}[o_custkey % 6 + 1] AS a, {list(_FIRST)}[(o_custkey + 1) % 7 + 1] || ' ' || {list(_SECOND)}[o_orderkey % 6 + 1] AS b, ['economy', 'promo', 'standard', 'economy brand'][o_custkey % 4 + 1] AS c FROM orders",
    texts="""SELECT note_id, CASE note_id % 4 WHEN 0 THEN 'Assessment: severe ' || a || ' due to ' || b || '.' || chr(10) || 'Plan: repeat ' || c || ' scan.' WHEN 1 THEN 'Chief complaint: ' || a || '. No evidence of ' || b || '; denies ' || c || '.' || chr(13) || chr(10) || 'Family history: mother with ' || b
  WHEN 2 THEN 'Paciente con ' || a || ' sin ' || b || '. Antecedentes: ' || c || ' control' ELSE a || ' and ' || b || ' very well polished ' || c || ' were suspected? History of ' || c || ' follow-up. Past medical history: ' || a END AS text FROM words""",
    plain="SELECT note_id, replace(text, chr(13) || chr(10), chr(10)) AS t FROM texts",
)
_HEADER = "(?m)(?:^|[\\n\\r]+|[.!?]\\s+)([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ /()_-]{0,40}):[ \\t]*"
_SENTENCE = "[^\\n.!?]+[.!?]*"
_LENGTHS = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
_SECTIONS = dict(
    **_TEXTS,
    h=f"SELECT note_id, t, i, m[i] AS head, {_LENGTHS.format('g[1:i]')} + {_LENGTHS.format('m[1:i-1]')} AS raw FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT *, regexp_extract_all(t, '{_HEADER}') AS m, string_split_regex(t, '{_HEADER}') AS g FROM plain))",
    hs=f"SELECT note_id, t, trim(regexp_extract(head, '{_HEADER}', 1)) AS section, (raw + regexp_matches(head, '^[.!?]')::INT)::INT AS a, (raw + length(head))::INT AS content FROM h",
    sec="""SELECT *, coalesce(lead(a) OVER (PARTITION BY note_id ORDER BY a), length(t))::INT AS b FROM hs UNION ALL SELECT note_id, t, 'Note', 0, 0, coalesce((SELECT min(a) FROM hs WHERE hs.note_id = plain.note_id), length(t))::INT FROM plain WHERE NOT EXISTS (SELECT 1 FROM hs WHERE hs.note_id = plain.note_id AND a = 0)""",
)
_SENTENCES = dict(
    **_SECTIONS,
    ss=f"SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT note_id, t, section, content, regexp_extract_all(x, '{_SENTENCE}') AS m, string_split_regex(x, '{_SENTENCE}') AS g FROM (SELECT *, substr(t, content + 1, b - content) AS x FROM sec))",
    sen=f"SELECT note_id, t, section, trim(m[i]) AS sentence, (content + {_LENGTHS.format('g[1:i]')} + {_LENGTHS.format('m[1:i-1]')} + length(m[i]) - length(ltrim(m[i])))::INT AS a FROM ss WHERE trim(m[i]) <> ''",
)


def note_texts(t: Tables) -> DataFrame:
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (F.pmod(k, F.lit(len(words))) + 1).cast("int"))
    a, b = F.concat_ws(" ", pick(_FIRST, order), pick(_SECOND, customer)), F.concat_ws(" ", pick(_FIRST, customer + 1), pick(_SECOND, order))
    c = pick(("economy", "promo", "standard", "economy brand"), customer)
    text = (
        F.when(order % 4 == 0, F.concat(F.lit("Assessment: severe "), a, F.lit(" due to "), b, F.lit(".\nPlan: repeat "), c, F.lit(" scan.")))
        .when(order % 4 == 1, F.concat(F.lit("Chief complaint: "), a, F.lit(". No evidence of "), b, F.lit("; denies "), c, F.lit(".\r\nFamily history: mother with "), b))
        .when(order % 4 == 2, F.concat(F.lit("Paciente con "), a, F.lit(" sin "), b, F.lit(". Antecedentes: "), c, F.lit(" control")))
        .otherwise(F.concat(a, F.lit(" and "), b, F.lit(" very well polished "), c, F.lit(" were suspected? History of "), c, F.lit(" follow-up. Past medical history: "), a))
    )
    return t.table("orders").select(order.alias("note_id"), text.alias("text"))


@query("note_sections", "SELECT note_id, section, lower(replace(section, ' ', '-')) AS slug, a AS start, content, b AS \"end\" FROM sec WHERE b > a", **_SECTIONS)
def note_sections(t: Tables) -> DataFrame:
    return N.sections(note_texts(t), "note_id", "text").select("note_id", "section", "slug", "start", "content", "end")


@query("note_sentences", "SELECT note_id, section, sentence, a AS start, (a + length(sentence))::INT AS \"end\" FROM sen", **_SENTENCES)
def note_sentences(t: Tables) -> DataFrame:
    return N.sentences(note_texts(t), "note_id", "text")


def _cue(family: str) -> str:
    return "(?i)\\b(?:" + "|".join(N.CUES[family]) + ")\\b"


_MEANING = {"family": ("family-history", "family-history"), "history": ("history", "historical"), "plan": ("plan", "planned"), "negation": ("negation", "absent"), "hypothetical": ("certainty", "suspected"), "due-to": ("relation", "due-to"), "associated-with": ("relation", "associated-with"), "caused-by": ("relation", "caused-by")}
_CUES = dict(
    **_SENTENCES,
    cue=" UNION ALL ".join(f"SELECT note_id, a, '{kind}' AS kind, '{value}' AS value, regexp_extract(sentence, '{_cue(f)}') AS cue, (a + length(string_split_regex(sentence, '{_cue(f)}')[1]))::INT AS start FROM sen WHERE regexp_matches(sentence, '{_cue(f)}')" for f, (kind, value) in _MEANING.items()),
    said="""SELECT note_id, a, kind, value, 'sentence' AS source, cue, start, (start + length(cue))::INT AS stop FROM cue
  UNION ALL SELECT note_id, a, 'family-history', 'family-history', 'section', section, NULL, NULL FROM sen WHERE regexp_matches(section, '(?i)\\bfamily history\\b') AND (note_id, a) NOT IN (SELECT (note_id, a) FROM cue WHERE kind = 'family-history')
  UNION ALL SELECT note_id, a, 'history', 'historical', 'section', section, NULL, NULL FROM sen WHERE regexp_matches(section, '(?i)\\b(history|antecedentes)\\b') AND (note_id, a) NOT IN (SELECT (note_id, a) FROM cue WHERE kind = 'history')
  UNION ALL SELECT note_id, a, 'plan', 'planned', 'section', section, NULL, NULL FROM sen WHERE regexp_matches(section, '(?i)\\b(plan|seguimiento)\\b') AND (note_id, a) NOT IN (SELECT (note_id, a) FROM cue WHERE kind = 'plan')""",
    ctx="""SELECT note_id, t, section, sentence, a, CASE WHEN bool_or(kind = 'family-history') THEN 'family-history' WHEN bool_or(kind = 'negation') THEN 'negated' WHEN bool_or(kind = 'plan') THEN 'plan' WHEN bool_or(kind = 'certainty') THEN 'hypothetical' WHEN bool_or(kind = 'history' AND source = 'sentence') THEN 'history' ELSE 'current' END AS context,
  coalesce(bool_or(kind = 'relation'), false) AS related, list({'x': start, 'y': stop}) FILTER (WHERE start IS NOT NULL) AS spans FROM sen LEFT JOIN said USING (note_id, a) GROUP BY ALL""",
)


@query("note_signals", "SELECT note_id, a AS sentence_start, kind AS cue_type, value, source, cue, start, stop AS \"end\" FROM said", **_CUES)
def note_signals(t: Tables) -> DataFrame:
    return N.signals(note_texts(t), "note_id", "text")


_LOW = ", ".join(f"'{w}'" for w in sorted(N.LOW_VALUE))
_BREAK = ", ".join(f"'{w}'" for w in sorted(N.BREAKS))
_POINTS = "(CASE WHEN {n} = 1 THEN 10 WHEN {n} <= 4 THEN 24 ELSE greatest(16 - 3 * ({n} - 4), 0) END + 6 * len(list_filter({w}, lambda x: length(x) >= 5)) + CASE WHEN len(list_filter({w}, lambda x: regexp_full_match(x, '[0-9]+'))) > 0 THEN 2 ELSE 0 END + {c} - CASE WHEN len({w}) = 1 AND length({w}[1]) < 6 THEN 8 ELSE 0 END)"
_PHRASES = dict(
    **_CUES,
    tok="SELECT note_id, t, section, sentence, a, context, related, spans, i, lower(m[i]) AS w, (a + coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::INT AS x, length(m[i])::INT AS n FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT *, regexp_extract_all(sentence, '[\\p{L}\\p{N}]+') AS m, string_split_regex(sentence, '[\\p{L}\\p{N}]+') AS g FROM ctx))",
    brk=f"SELECT *, w IN ({_LOW}) OR w IN ({_BREAK}) OR len(list_filter(coalesce(spans, []), lambda s: x < s.y AND x + n > s.x)) > 0 AS stops FROM tok",
    isl="SELECT *, sum(stops::INT) OVER (PARTITION BY note_id, a ORDER BY i) AS island FROM brk",
    seg="SELECT note_id, t, section, sentence, a, context, related, island, list(w ORDER BY i) AS ws, list(x ORDER BY i) AS xs, list(n ORDER BY i) AS ns FROM isl WHERE NOT stops GROUP BY ALL",
    win=f"""SELECT *, 0 AS p, len(ws) AS size, 0 AS value FROM seg WHERE len(ws) <= 4 UNION ALL SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY note_id, a, island ORDER BY value DESC, size DESC, p) AS k FROM (SELECT *, {_POINTS.format(n='size', w='ws[p+1:p+size]', c='4')} + CASE WHEN p + size = len(ws) THEN 3 ELSE 0 END - p AS value FROM
      (SELECT *, unnest(range(0, len(ws) - size + 1)) AS p FROM (SELECT *, unnest([4, 3, 2, 1]) AS size FROM seg WHERE len(ws) > 4)) ORDER BY ALL)) WHERE k <= 2""".replace("SELECT *, 0 AS p, len(ws) AS size, 0 AS value FROM seg", "SELECT note_id, t, section, sentence, a, context, related, island, ws, xs, ns, len(ws)::INT AS size, 0::INT AS p, 0::INT AS value FROM seg"),
    phr=f"SELECT note_id, section, sentence, a, context, related, xs[p+1] AS x, xs[p+size] + ns[p+size] AS y, substr(t, xs[p+1] + 1, xs[p+size] + ns[p+size] - xs[p+1]) AS phrase, array_to_string(ws[p+1:p+size], ' ') AS normalized, size, {_POINTS.format(n='size', w='ws[p+1:p+size]', c=chr(123) + 'c' + chr(125))} AS points FROM win".replace("{c}", "CASE context WHEN 'current' THEN 4 WHEN 'history' THEN 2 WHEN 'negated' THEN 2 WHEN 'plan' THEN -4 WHEN 'family-history' THEN -30 ELSE 0 END"),
    men="SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY points DESC, size DESC, x) - 1 AS k FROM phr WHERE length(normalized) >= CASE WHEN size = 1 THEN 5 ELSE 3 END",
)


def note_phrases(t: Tables) -> DataFrame:
    return N.phrases(note_texts(t), "note_id", "text")


@query("note_phrases", "SELECT note_id, k::INT AS k, phrase, x::INT AS start, y::INT AS \"end\", size::INT AS n_tokens, points::INT AS points, section, context AS context_type, related AS relation_cue FROM men WHERE k < 80", **_PHRASES)
def note_phrase_rows(t: Tables) -> DataFrame:
    return note_phrases(t).select("note_id", "k", "phrase", "start", "end", "n_tokens", "points", "section", "context_type", "relation_cue")


@query("cue_context", "SELECT context, count(*) AS n, count(*) FILTER (WHERE related) AS related FROM ctx GROUP BY context", **_CUES)
def cue_context(t: Tables) -> DataFrame:
    """Sentences by context, from their cues."""
    said = N.signals(note_texts(t), "note_id", "text")
    has = lambda kind: F.bool_or(F.col("cue_type") == kind)
    found = said.groupBy("note_id", F.col("sentence_start").alias("start")).agg(*(has(k).alias(k) for k in ("family-history", "negation", "plan", "certainty", "relation")), F.bool_or((F.col("cue_type") == "history") & (F.col("source") == "sentence")).alias("history"))
    rows = N.sentences(note_texts(t), "note_id", "text").join(found, ["note_id", "start"], "left")
    order = {"family-history": "family-history", "negation": "negated", "plan": "plan", "certainty": "hypothetical", "history": "history"}
    context = F.coalesce(*(F.when(F.col(k), v) for k, v in order.items()), F.lit("current"))
    return rows.groupBy(context.alias("context")).agg(F.count(F.lit(1)).alias("n"), F.count_if("relation").alias("related"))


_SENTENCE_SQL = "SELECT doc_id, unnest(range(len(s))) AS k, trim(unnest(s)) AS sentence FROM (SELECT doc_id, regexp_extract_all(text, '[^\\n.!?]+[.!?]*') AS s FROM documents)"


@query("phrase_score", f"SELECT concept_id, context, max({_POINTS.format(n='n', w='w', c='CASE context WHEN $current$ THEN 4 WHEN $family-history$ THEN -30 ELSE 2 END')})::INT AS score FROM (SELECT *, string_split(phrase, ' ') AS w, len(string_split(phrase, ' ')) AS n FROM (SELECT c.concept_id, p.name || CASE WHEN line % 2 = 0 THEN ' stage 3 of left review arm' ELSE '' END AS phrase, CASE WHEN subject = 'family' THEN 'family-history' WHEN assertion = 'absent' THEN 'negated' ELSE 'current' END AS context FROM codings c JOIN parts p USING (concept_id))) GROUP BY ALL".replace("$", "'").replace("+ CASE context", "- 10 * len(list_filter(w, lambda x: x = 'review')) + CASE context"), "codings", "parts")
def phrase_score(t: Tables) -> DataFrame:
    names = t.parts.select("concept_id", "name")
    rows = t.codings.join(names, "concept_id")
    phrase = F.concat("name", F.when(F.col("line") % 2 == 0, " stage 3 of left review arm").otherwise(""))
    context = F.when(F.col("subject") == "family", "family-history").when(F.col("assertion") == "absent", "negated").otherwise("current")
    return rows.groupBy("concept_id", context.alias("context")).agg(F.max(N.phrase_score(phrase, F.size(F.split(phrase, " ")), context)).alias("score"))


@query("kind_compatible", "SELECT kind, tag, count(*) AS n, CASE kind WHEN 'condition' THEN tag IN ('disorder', 'hallazgo') WHEN 'procedure' THEN tag = 'procedure' ELSE tag = 'substance' END AS compatible FROM (SELECT kind, unnest(['disorder', 'procedure', 'substance', 'hallazgo']) AS tag FROM codings) GROUP BY ALL", "codings")
def kind_compatible(t: Tables) -> DataFrame:
    tags = F.explode(F.array(*map(F.lit, ("disorder", "procedure", "substance", "hallazgo"))))
    rows = t.codings.select("kind", tags.alias("tag")).groupBy("kind", "tag").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("compatible", G.kind_compatible(F.col("kind"), F.col("tag")))


@query("mention_context", "SELECT note_id, line::INT AS line, assertion, CASE WHEN assertion = 'absent' THEN 'absent/negated/patient' WHEN subject = 'family' THEN 'family-history/family-history/family' WHEN assertion = 'suspected' THEN 'suspected/hypothetical/patient' WHEN temporality = 'historical' THEN 'historical/history/patient' ELSE 'present/current/patient' END AS meaning FROM codings", "codings")
def mention_context(t: Tables) -> DataFrame:
    meaning = N.mention_context(F.col("assertion"), F.col("subject"), F.col("temporality"))
    return t.codings.select("note_id", "line", "assertion", F.concat_ws("/", meaning["assertion"], meaning["context_type"], meaning["experiencer"]).alias("meaning"))


@query("mention_normalization", "SELECT note_id, line::INT AS line, CASE WHEN assertion = 'present' THEN 'present' WHEN line % 3 = 0 THEN 'absent' ELSE 'suspected' END AS assertion, CASE WHEN line % 2 = 0 THEN 'family' ELSE 'patient' END AS subject, CASE WHEN line % 4 = 0 THEN 'current' ELSE 'unknown' END AS temporality, CASE WHEN line % 3 = 1 THEN 'condition' END AS kind FROM codings WHERE line <> 2", "codings")
def mention_normalization(t: Tables) -> DataFrame:
    line = F.col("line")
    raw = t.codings.select("note_id", "line", F.when(line == 2, "  ").otherwise(" x ").alias("phrase"), F.when(F.col("assertion") == "present", "present").when(line % 3 == 0, "absent").otherwise("historical").alias("assertion"), F.when(line % 2 == 0, "family").when(line % 3 == 0, "mother").alias("subject"), F.when(line % 4 == 0, "current").otherwise("past").alias("temporality"), F.when(line % 3 == 1, "condition").otherwise("diagnosis").alias("kind"))
    return N.normalized_mentions(raw).select("note_id", "line", "assertion", "subject", "temporality", "kind")


@query("lookup_plan", "SELECT CASE WHEN kind = 'context' THEN 'skip' WHEN kind IS NULL AND points < 4 THEN 'skip' WHEN kind IS NULL AND (length(p_type) < 7 OR points < 12) THEN 'exact' ELSE 'broad' END AS plan, count(*) AS n FROM (SELECT p_type, p_size - 5 AS points, CASE p_size % 3 WHEN 0 THEN 'condition' WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'context' END END AS kind FROM part) GROUP BY 1")
def lookup_plan(t: Tables) -> DataFrame:
    size = F.col("p_size")
    kind = F.when(size % 3 == 0, "condition").when((size % 3 == 1) & (size % 2 == 0), "context")
    plan = G.lookup_plan(F.col("p_type"), size - 5, kind, F.lit("anchored"))
    return t.table("part").groupBy(plan.alias("plan")).agg(F.count(F.lit(1)).alias("n"))


@query("target_pruning", "SELECT context, target, context = 'current' OR (context = 'plan' AND target IN ('procedure.code', 'none')) OR target = 'none' AS wanted, n FROM (SELECT context, target, count(*) AS n FROM (SELECT CASE line % 3 WHEN 0 THEN 'plan' WHEN 1 THEN 'family-history' ELSE 'current' END AS context, CASE WHEN l_quantity::INT % 3 = 0 THEN 'procedure.code' WHEN l_quantity::INT % 3 = 1 THEN 'condition.code' ELSE 'none' END AS target FROM codings) GROUP BY ALL)", "codings")
def target_pruning(t: Tables) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    context = F.when(F.col("line") % 3 == 0, "plan").when(F.col("line") % 3 == 1, "family-history").otherwise("current")
    target = F.when(q % 3 == 0, "Procedure.code").when(q % 3 == 1, "condition.code").otherwise("")
    rows = t.codings.groupBy(context.alias("context"), target.alias("asked")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("context", F.when(F.col("asked") == "", "none").otherwise(F.lower("asked")).alias("target"), G.wanted_for_target(F.col("context"), F.col("asked")).alias("wanted"), "n")


@query("negation_inversion", "SELECT p_partkey, p_size % 2 = 0 AND p_size % 3 < 2 AS inverts FROM part")
def negation_inversion(t: Tables) -> DataFrame:
    size = F.col("p_size")
    text = F.when(size % 3 == 0, F.concat(F.lit("Absence of "), "p_name")).when(size % 3 == 1, F.concat("p_name", F.lit(" not detected (finding)"))).otherwise(F.concat("p_name", F.lit(" nodule absentia")))
    return t.table("part").select("p_partkey", G.inverts_negation(F.when(size % 2 == 0, "absent").otherwise("present"), F.when(size % 5 == 0, "hallazgo").otherwise("finding"), text).alias("inverts"))


@query("synthetic_tier", "SELECT vec_id, CASE WHEN s >= 0.6 THEN 2 WHEN s >= 0.45 THEN 4 WHEN s >= 0.3 THEN 6 ELSE 8 END::INT AS tier FROM (SELECT vec_id, label / 10.0 AS s FROM embeddings)")
def synthetic_tier(t: Tables) -> DataFrame:
    return t.table("embeddings").select("vec_id", G.synthetic_tier(F.col("label") / 10.0).alias("tier"))


@query("span_overlap_join", "SELECT a.note_id, count(*) AS pairs, sum(least(a.b, o.b) - greatest(a.a, o.a))::BIGINT AS shared FROM s a JOIN s o ON a.note_id = o.note_id AND a.a < o.b AND a.b > o.a GROUP BY a.note_id", "codings", s="SELECT note_id, line * 10 AS a, line * 10 + l_quantity::INT AS b FROM codings")
def span_overlap_join(t: Tables) -> DataFrame:
    spans = t.codings.select("note_id", F.concat_ws("-", "line", "concept_id").alias("span_id"), (F.col("line") * 10).alias("start"), (F.col("line") * 10 + F.col("l_quantity").cast("int")).alias("end"))
    shared = F.least("end", "other_end") - F.greatest("start", "other_start")
    return G.overlapping(spans, spans, "note_id").groupBy("note_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum(shared).cast("long").alias("shared"))


@query("sentence_windows", "SELECT doc_id, count(*) AS n, sum(length(sentence))::BIGINT AS chars FROM s WHERE sentence <> '' GROUP BY doc_id", s=_SENTENCE_SQL.replace("FROM documents", "FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), ':', ';', 'g') AS text FROM documents)"))
def sentence_windows(t: Tables) -> DataFrame:
    """Sentences of whole documents, none of which has a header."""
    flat = t.table("documents").select("doc_id", F.replace("text", F.lit(":"), F.lit(";")).alias("text"))
    return N.sentences(flat, "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sentence")).alias("chars"))


@query("extraction_windows", "SELECT doc_id, length(coalesce(text, ''))::BIGINT AS chars, sha256(coalesce(text, '')) AS whole FROM documents WHERE coalesce(text, '') <> ''")
def extraction_windows(t: Tables) -> DataFrame:
    """Windows of whole documents: put together again, they are the text."""
    rows = window_rows(t.table("documents"), "doc_id", "text", 2000)
    whole = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", "window"))).alias("w"))
    text = F.array_join(F.col("w.window"), "")
    return whole.select("doc_id", F.length(text).cast("long").alias("chars"), F.sha2(text.cast("binary"), 256).alias("whole"))


@query("mention_anchoring", "SELECT note_id, k::INT AS pos, CASE WHEN k = 1 THEN instr(text, a) - 1 WHEN note_id % 4 = 3 THEN length(text) - length(a) END::BIGINT AS start, CASE WHEN k = 2 AND note_id % 4 = 3 THEN 'unknown' ELSE 'current' END AS temporality FROM texts JOIN words USING (note_id), (SELECT unnest([1, 2]) AS k) WHERE note_id % 4 > 1 AND a <> b", **_TEXTS)
def mention_anchoring(t: Tables) -> DataFrame:
    """The same condition twice in each note of two forms: its first occurrence, then its second,
    which is background, or none."""
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (F.pmod(k, F.lit(len(words))) + 1).cast("int"))
    a, b = F.concat_ws(" ", pick(_FIRST, order), pick(_SECOND, customer)), F.concat_ws(" ", pick(_FIRST, customer + 1), pick(_SECOND, order))
    one = lambda n, phrase: F.struct(F.lit(n).alias("pos"), phrase.alias("phrase"))
    asked = t.table("orders").where((order % 4 > 1) & (a != b)).select(order.alias("note_id"), F.explode(F.array(one(1, F.upper(a)), one(2, a))).alias("m")).select("note_id", "m.*")
    stated = asked.withColumns({"subject": F.lit("patient"), "assertion": F.lit("present"), "temporality": F.lit("current"), "kind": F.lit("condition")})
    return anchored(note_texts(t), stated, "note_id").select("note_id", "pos", "start", "temporality")


# ---- candidates whose terms carry qualifiers, for phrases of one and two words in three contexts

_QUALIFIERS = ("", "left", "neonatal", "severe", "with", "follow-up", "due to", "mellitus")
_CONTEXTS = ("present", "absent", "planned")
_FLAGS = {
    "workflow": "workflow AND ctx <> 'planned'", "related": "cue AND relation", "side": "len(list_intersect(extra, ['left', 'right', 'bilateral', 'unilateral'])) > 0",
    "people": "len(list_intersect(extra, ['prematurity', 'premature', 'neonatal', 'neonate', 'maternal', 'pregnancy', 'congenital'])) > 0",
    "state": "len(list_intersect(extra, ['uncontrolled', 'controlled', 'poorly', 'well', 'stable', 'unstable', 'severe', 'mild', 'moderate', 'advanced'])) > 0",
    "narrow": "words = 1 AND len(extra) > 0 AND t <> p", "joined": "contains(t, 'due to ' || p) OR contains(t, 'with ' || p) OR contains(t, 'following ' || p) OR contains(t, 'secondary to ' || p)",
}
_FULL = dict(
    e=f"SELECT concept_id AS mention_id, concept_id, brand_id, type_id, name, p_size, p_brand, p_partkey, CASE p_partkey % 2 WHEN 0 THEN name ELSE split_part(name, ' ', 1) END AS phrase, {list(_QUALIFIERS)}[p_partkey % 8 + 1] AS qualifier, {list(_CONTEXTS)}[p_partkey % 3 + 1] AS ctx, p_partkey % 5 = 0 AS cue FROM parts",
    k="""SELECT mention_id, phrase, ctx, cue, p_size, concept_id, 1 AS tier, true AS preferred, 'Disorder' AS tag, name AS term, name AS matched, 0 AS pos FROM e
  UNION ALL SELECT mention_id, phrase, ctx, cue, p_size, type_id, 4, false, 'finding', CASE WHEN p_partkey % 7 = 0 THEN phrase ELSE qualifier || ' ' || phrase || ' of ' || p_brand END, CASE WHEN p_partkey % 4 = 0 THEN phrase END, 1 FROM e
  UNION ALL SELECT mention_id, phrase, ctx, cue, p_size, brand_id, NULL, false, 'product', qualifier || ' ' || p_brand, '', 2 FROM e""",
    n="SELECT *, trim(regexp_replace(lower(phrase), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS p, trim(regexp_replace(lower(term), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t, trim(regexp_replace(lower(coalesce(nullif(matched, ''), term)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS m FROM k",
    x="""SELECT *, list_filter(string_split(t, ' '), lambda w: NOT list_contains(string_split(p, ' '), w) AND length(w) > 3
    AND w NOT IN ('with', 'without', 'from', 'into', 'under', 'para', 'mellitus', 'type', 'finding', 'disorder', 'disease')) AS extra,
  len(string_split(p, ' ')) AS words, regexp_matches(t, '\\b(follow[ -]?up|review|evaluation|screening|monitoring|check)\\b') AS workflow,
  regexp_matches(t, '\\b(due to|associated with|with|without|following|secondary to|caused by|resulting from)\\b') AS relation FROM n""",
    g=f"""SELECT *, {', '.join(f'({v}) AS f_{k}' for k, v in _FLAGS.items())}, (greatest(50 - 8 * coalesce(tier, 99), -22) + CASE WHEN t = p THEN 34 WHEN m = p THEN 16 WHEN contains(t, p) THEN 8 ELSE 0 END + CASE WHEN preferred THEN 5 ELSE 0 END
  + least(p_size, 60) / 10.0::DOUBLE + least(p_size, 500) / 50.0::DOUBLE + CASE WHEN lower(tag) IN ('disorder', 'finding') THEN 4 ELSE -6 END
  - len(extra) * CASE WHEN t = p THEN 0 WHEN m = p AND words = 1 THEN 14 WHEN m = p THEN 6 WHEN words = 1 THEN 12 ELSE 4.5::DOUBLE END
  - CASE WHEN {_FLAGS['workflow']} THEN 18 ELSE 0 END - CASE WHEN {_FLAGS['related']} THEN 16 WHEN relation AND t <> p AND m <> p THEN 6 ELSE 0 END
  - CASE WHEN NOT ({_FLAGS['side']}) THEN 0 WHEN ctx = 'absent' THEN 14 ELSE 9 END - CASE WHEN {_FLAGS['people']} THEN 14 ELSE 0 END - CASE WHEN {_FLAGS['state']} THEN 18 ELSE 0 END
  - CASE WHEN {_FLAGS['narrow']} THEN 14 ELSE 0 END + CASE WHEN ctx = 'absent' AND lower(tag) IN ('disorder', 'finding') THEN 2 ELSE 0 END)::DOUBLE AS score FROM x""",
    o="SELECT *, row_number() OVER w AS place, greatest(score - coalesce(lead(score) OVER w, 0), 0) AS margin, t = p AS exact, m = p AS synonym, t = p AS full_match FROM g WINDOW w AS (PARTITION BY mention_id ORDER BY round(score, 4) DESC, concept_id)",
)
_CONF = """round(least(greatest(0.34::DOUBLE + least(0.22::DOUBLE * p_size, 0.24::DOUBLE) + least(margin / 25.0::DOUBLE, 0.22::DOUBLE) + CASE WHEN exact THEN 0.22::DOUBLE WHEN synonym THEN 0.12::DOUBLE WHEN m = p OR contains(m, p) OR contains(p, m) OR contains(t, p) OR contains(p, t) THEN 0.08::DOUBLE ELSE 0 END
  + CASE WHEN tier <= 2 THEN 0.18::DOUBLE WHEN tier <= 4 THEN 0.10::DOUBLE WHEN tier <= 6 THEN 0.04::DOUBLE ELSE -0.08::DOUBLE END - (CASE WHEN words = 1 AND NOT (exact OR synonym) THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN f_workflow THEN 0.22::DOUBLE ELSE 0 END + CASE WHEN f_related THEN 0.16::DOUBLE ELSE 0 END
  + CASE WHEN f_side THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN f_people THEN 0.14::DOUBLE ELSE 0 END + CASE WHEN f_state THEN 0.16::DOUBLE ELSE 0 END + CASE WHEN f_narrow AND words = 1 THEN 0.32::DOUBLE WHEN f_narrow THEN 0.18::DOUBLE ELSE 0 END), 0), 1), 6)"""
_GUARDED = "NOT (f_joined OR f_workflow OR f_related OR f_side OR f_people OR f_state)"
_STATUS = f"""CASE WHEN n_full > 1 THEN 'review' WHEN conf < 0.42 THEN 'abstain' WHEN full_match AND (((exact OR synonym OR coalesce(tier, 99) <= 2) AND conf >= 0.68 AND margin >= 0.03 AND (words > 1 OR exact) AND {_GUARDED} AND NOT f_narrow)
  OR (coalesce(tier, 99) <= 4 AND conf >= 0.64 AND margin >= 0.05 AND words >= 2 AND {_GUARDED})) THEN 'accepted' ELSE 'review' END"""


def _full_parts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """mentions and candidates as grounded() takes them."""
    key, word = F.col("p_partkey"), lambda words, n: F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % n + 1).cast("int"))
    entries = t.parts.withColumns({"mention_id": F.col("concept_id"), "phrase": F.when(key % 2 == 0, F.col("name")).otherwise(F.split_part("name", F.lit(" "), F.lit(1))), "qualifier": word(_QUALIFIERS, 8), "assertion": word(_CONTEXTS, 3), "relation_cue": key % 5 == 0})
    one = lambda pos, c, tier, preferred, tag, term, matched: F.struct(F.lit(pos).alias("pos"), F.col(c).alias("concept_id"), F.lit(tier).cast("int").alias("tier"), F.lit(preferred).alias("preferred"), F.lit(tag).alias("tag"), term.alias("term"), matched.alias("matched"))
    found = F.array(
        one(0, "concept_id", 1, True, "Disorder", F.col("name"), F.col("name")),
        one(1, "type_id", 4, False, "finding", F.when(key % 7 == 0, F.col("phrase")).otherwise(F.concat_ws(" ", "qualifier", "phrase", F.lit("of"), "p_brand")), F.when(key % 4 == 0, F.col("phrase"))),
        one(2, "brand_id", None, False, "product", F.concat_ws(" ", "qualifier", "p_brand"), F.lit("")),
    )
    mentions = entries.select("mention_id", "phrase", F.size(tokens(normalize(F.col("phrase")))).alias("n_tokens"), "assertion", "relation_cue", F.lit("condition").alias("kind"))
    rows = entries.select("mention_id", "p_size", F.explode(found).alias("c")).select("mention_id", "p_size", "c.*")
    candidates = rows.select("mention_id", "pos", "concept_id", "term", "matched", F.array("term").alias("descriptions"), "tag", "tier", "preferred", F.col("p_size").alias("rank"), F.col("p_size").cast("double").alias("search_score"), F.lit(None).cast("double").alias("rerank_score"), F.lit(True).alias("active"))
    return mentions, candidates


def full_candidates(t: Tables) -> DataFrame:
    mentions, candidates = _full_parts(t)
    both = mentions.join(candidates, "mention_id")
    score = G.candidate_score(*(F.col(c) for c in ("phrase", "n_tokens", "assertion", "relation_cue", "term", "matched", "tier", "preferred", "rank", "search_score", "tag")))
    return G.with_margin(both.withColumn("score", score))


@query("grounding_score", "SELECT mention_id, concept_id, round(score, 4) AS score FROM g", "parts", **_FULL)
def grounding_score(t: Tables) -> DataFrame:
    return full_candidates(t).select("mention_id", "concept_id", "score")


@query("margin_to_next", "SELECT mention_id, concept_id, place::INT AS place, round(margin, 6) AS margin FROM o", "parts", **_FULL)
def margin_to_next(t: Tables) -> DataFrame:
    return full_candidates(t).select("mention_id", "concept_id", "place", F.round("margin", 6).alias("margin"))


# whole descriptions first; products don't suit a condition
_DECIDED = dict(
    **_FULL,
    u="SELECT *, count(*) FILTER (WHERE full_match) OVER (PARTITION BY mention_id) AS n_full FROM (SELECT *, row_number() OVER w AS spot, greatest(round(score, 4) - coalesce(lead(round(score, 4)) OVER w, 0), 0) AS gap FROM o WHERE tag <> 'product' WINDOW w AS (PARTITION BY mention_id ORDER BY full_match DESC, round(score, 4) DESC, coalesce(tier, 99), preferred DESC, p_size DESC, pos))",
    c=f"SELECT *, {_CONF} AS conf FROM (SELECT * REPLACE (gap AS margin) FROM u WHERE spot = 1)",
)


@query("review_status", f"SELECT mention_id, concept_id, conf AS confidence, round(margin, 4) AS margin, {_STATUS} AS status FROM c", "parts", **_DECIDED)
def review_status(t: Tables) -> DataFrame:
    return G.grounded(*_full_parts(t)).select("mention_id", "concept_id", "confidence", "margin", "status")


# ---- from texts to decisions


_ASKED = dict(w="SELECT DISTINCT phrase FROM (SELECT p_name AS phrase FROM part UNION ALL SELECT lower(p_type) FROM part)")


@query("note_candidates", """SELECT phrase, concept_id, place::INT AS place, strategy FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY k, concept_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY phrase, concept_id ORDER BY k) AS first_of FROM (
  SELECT w.phrase, concept_id, row_number() OVER (PARTITION BY w.phrase ORDER BY is_preferred DESC, term_rank DESC, concept_id, description_id) AS k, 'exact' AS strategy FROM w JOIN terms ON normalized = w.phrase WHERE concept_active)) WHERE first_of = 1) WHERE place <= 8""", "terms", **_ASKED)
def note_candidates(t: Tables) -> DataFrame:
    """Candidates of phrases that are whole descriptions: the best eight concepts of each."""
    return V.candidates(_asked(t, "exact"), t.search, limit=8).select("phrase", "concept_id", F.col("pos").alias("place"), "strategy")


def _asked(t: Tables, plan: str) -> DataFrame:
    part = t.table("part")
    return part.select(F.col("p_name").alias("phrase")).union(part.select(F.lower("p_type"))).distinct().withColumn("plan", F.lit(plan))


_BROAD = dict(
    **_ASKED,
    ix="SELECT DISTINCT description_id, concept_id, normalized, fsn, synonyms, is_preferred, term_rank, unnest(string_split(normalized || ' ' || display || ' ' || fsn || ' ' || array_to_string(synonyms, ' '), ' ')) AS token FROM terms WHERE concept_active",
    fr="SELECT token, count(*) AS n FROM ix GROUP BY token",
    ra="SELECT phrase, min((n, token)) AS r FROM (SELECT phrase, unnest(string_split(phrase, ' ')) AS token FROM w) JOIN fr USING (token) WHERE length(token) > 1 GROUP BY phrase",
    hit="SELECT phrase, description_id, concept_id, normalized, fsn, synonyms, is_preferred, term_rank FROM ra JOIN ix ON token = r[2] UNION SELECT phrase, description_id, concept_id, normalized, fsn, synonyms, is_preferred, term_rank FROM w JOIN terms ON normalized = phrase WHERE concept_active",
    ti="""SELECT *, CASE WHEN normalized = phrase THEN 1 WHEN starts_with(normalized, phrase || ' ') AND len(string_split(normalized, ' ')) - len(string_split(phrase, ' ')) <= 1 THEN 2 WHEN list_contains(synonyms, phrase) THEN 3 WHEN fsn = phrase THEN 4 WHEN starts_with(normalized, phrase) THEN 6
  WHEN contains(' ' || normalized || ' ', ' ' || phrase || ' ') THEN 8 WHEN contains(' ' || fsn || ' ', ' ' || phrase || ' ') THEN 9 ELSE 11 END AS tier FROM hit""",
    fi="SELECT * FROM ti QUALIFY row_number() OVER (PARTITION BY phrase, concept_id ORDER BY tier, is_preferred DESC, term_rank DESC, description_id) = 1",
)


@query("note_candidates_broad", "SELECT phrase, concept_id, row_number() OVER (PARTITION BY phrase ORDER BY tier, is_preferred DESC, term_rank DESC, concept_id)::INT AS place, CASE WHEN tier = 1 THEN 'exact' ELSE 'broad' END AS strategy FROM fi QUALIFY place <= 20", "terms", **_BROAD)
def note_candidates_broad(t: Tables) -> DataFrame:
    """Candidates by each phrase's rarest word as well, however many rows have it."""
    return V.candidates(_asked(t, "broad"), t.search).select("phrase", "concept_id", F.col("pos").alias("place"), "strategy")


@query("note_grounding", None)
def note_grounding(t: Tables) -> DataFrame:
    """Every order's text, read, grounded and decided: statuses by context and section."""
    found = V.ground_notes(note_texts(t), "note_id", "text", t.search)
    return found.groupBy("section", "assertion", "status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("concept_id").alias("concepts"))


_LINKED = "SELECT note_id, line, concept_id || '-' || line AS mention_id, sentence, p, CASE WHEN line % 2 = 0 THEN lft ELSE rgt END AS phrase FROM (SELECT c.note_id, c.line, c.concept_id, 'acute ' || p.name || ' on a background of chronic ' || p.name || ' disease' AS sentence, p.name AS p, 'acute ' || p.name AS lft, 'chronic ' || p.name AS rgt FROM codings c JOIN parts p USING (concept_id))"


@query("linked_mentions", "SELECT x.note_id, x.mention_id, y.mention_id AS partner_id FROM l x JOIN l y ON x.note_id = y.note_id AND x.sentence = y.sentence AND x.mention_id <> y.mention_id AND x.line % 2 <> y.line % 2", "codings", "parts", l=_LINKED)
def linked_mentions(t: Tables) -> DataFrame:
    return G.linked_mentions(_linked(t))


def _linked(t: Tables) -> DataFrame:
    names = t.parts.select("concept_id", "name")
    # a note's lines meet before they are given their sentences
    rows = t.codings.select("note_id", "line", "concept_id").join(names, "concept_id").repartition("note_id")
    side = F.when(F.col("line") % 2 == 0, F.concat(F.lit("acute "), "name")).otherwise(F.concat(F.lit("chronic "), "name"))
    sentence = F.concat(F.lit("acute "), "name", F.lit(" on a background of chronic "), "name", F.lit(" disease"))
    return rows.select("note_id", F.concat_ws("-", "concept_id", "line").alias("mention_id"), F.lit("condition").alias("kind"), F.lit("present").alias("assertion"), F.lit("current").alias("temporality"), F.lit("patient").alias("experiencer"), sentence.alias("sentence"), side.alias("phrase"), "concept_id")


_POOLS = dict(l=_LINKED, k="SELECT x.mention_id, y.mention_id AS source, 1 AS own FROM l x JOIN l y ON x.note_id = y.note_id AND x.sentence = y.sentence AND x.mention_id <> y.mention_id AND x.line % 2 <> y.line % 2", w="SELECT * FROM k UNION SELECT mention_id, mention_id, 0 FROM k", p="SELECT mention_id, unnest([0, 1]) AS rank, unnest([split_part(mention_id, '-', 1), mention_id]) AS concept_id FROM l")


@query("shared_candidates", "SELECT mention_id, concept_id, row_number() OVER (PARTITION BY mention_id ORDER BY spot, concept_id)::INT AS place FROM (SELECT w.mention_id, p.concept_id, min((p.rank, own, source)) AS spot FROM w JOIN p ON p.mention_id = w.source GROUP BY ALL) QUALIFY place <= 20", "codings", "parts", **_POOLS)
def shared_candidates(t: Tables) -> DataFrame:
    rows = _linked(t)
    pools = rows.select("mention_id", F.posexplode(F.array("concept_id", "mention_id")).alias("rank", "concept_id"))
    return G.shared_candidates(G.linked_mentions(rows), pools)


@query("verified_decisions", "SELECT mention_id, CASE WHEN k = 0 THEN CASE WHEN line % 2 = 0 THEN 'accepted' ELSE 'review' END WHEN k IN (1, 4) THEN 'review' WHEN k = 2 THEN 'review' ELSE 'abstain' END AS status FROM (SELECT note_id || '-' || line || '-' || concept_id || '-' || l_quantity::INT AS mention_id, line, l_quantity::INT % 6 AS k FROM codings)", "codings")
def verified_decisions(t: Tables) -> DataFrame:
    """Decisions of six kinds: equivalent and quoted, quoted wrongly, broader, unsupported, given
    twice, none; anchored mentions on even lines."""
    k, line = F.col("l_quantity").cast("int") % 6, F.col("line")
    rows = t.codings.withColumns({"mention_id": F.concat_ws("-", "note_id", "line", "concept_id", F.col("l_quantity").cast("int")), "k": k})
    candidate = F.struct("concept_id", F.lit("disorder").alias("tag"), F.lit("a disorder").alias("description"))
    entries = rows.select("mention_id", F.lit("condition").alias("kind"), F.lit("present").alias("assertion"), F.when(line % 2 == 0, "anchored").otherwise("unanchored").alias("evidence_status"), F.lit("has asthma today").alias("sentence"), F.lit("asthma").alias("verbatim"), F.create_map().cast("map<string,string>").alias("attributes"), F.array(candidate).alias("candidates"))
    relation = F.when(F.col("k").isin(0, 1, 4), "equivalent").when(F.col("k") == 2, "broader").when(F.col("k") == 3, "unsupported").otherwise("equivalent")
    quotes = F.array(F.when(F.col("k") == 1, "no such words").otherwise("asthma"))
    made = rows.select("mention_id", F.when(F.col("k") == 5, "none").otherwise(F.col("concept_id")).alias("concept_id"), relation.alias("relation"), quotes.alias("quotes"), F.array().cast("array<string>").alias("missing"), "k")
    return G.verified(entries, made.unionByName(made.where("k = 4")).drop("k")).select("mention_id", "status")


@query("adjudicated", "SELECT note_id || '-' || line AS mention_id, concept_id, line % 2 = 0 AND concept_id::INT % 2 = 0 AS \"primary\", count(*) AS n FROM codings c WHERE EXISTS (SELECT 1 FROM codings o WHERE o.note_id = c.note_id AND o.line = c.line AND o.concept_id = c.concept_id AND o.l_quantity::INT % 3 <> 0) GROUP BY ALL", "codings")
def adjudicated(t: Tables) -> DataFrame:
    rows = t.codings.withColumn("mention_id", F.concat_ws("-", "note_id", "line"))
    decisions = rows.select("mention_id", "concept_id", (F.col("line") % 2 == 0).alias("primary"))
    offered = rows.where(F.col("l_quantity").cast("int") % 3 != 0).select("mention_id", "concept_id")
    return G.adjudicated(decisions, offered, t.parts.where(F.col("concept_id").cast("int") % 2 == 0)).groupBy("mention_id", "concept_id", "primary").agg(F.count(F.lit(1)).alias("n"))


_GRAPH = dict(
    **{k: f"MATERIALIZED {v}" if k in ("men", "said") else v for k, v in _PHRASES.items()},
    mm="MATERIALIZED SELECT *, note_id || '-' || k AS id FROM men WHERE k < 80",
    met="SELECT s.note_id, s.a, s.value, s.start, s.stop, m.id, m.x, m.y, row_number() OVER (PARTITION BY s.note_id, s.a, s.value, s.start ORDER BY m.x, m.y, m.id) AS o FROM said s JOIN mm m ON s.note_id = m.note_id AND s.a = m.a WHERE kind = 'relation'",
    sides="SELECT note_id, value, count(*) AS n, arg_max(id, o) FILTER (WHERE y <= start) AS lft, arg_min(id, o) FILTER (WHERE x >= stop) AS rgt, arg_min(id, o) AS one, arg_min(id, o) FILTER (WHERE o > 1) AS two FROM met GROUP BY note_id, a, value, start",
    linked="SELECT note_id, value, coalesce(lft, one) AS source, coalesce(rgt, CASE WHEN coalesce(lft, one) = one THEN two ELSE one END) AS target, CASE WHEN lft IS NOT NULL AND rgt IS NOT NULL THEN 0.88 ELSE 0.72 END::DOUBLE AS weight FROM sides WHERE n > 1",
)


@query("evidence_edges", "SELECT m.note_id, 'applies' AS edge, 'cue-' || m.a || '-' || kind || '-' || value AS source, m.id AS target, 1.0::DOUBLE AS weight FROM mm m JOIN said s ON s.note_id = m.note_id AND s.a = m.a UNION ALL SELECT note_id, value, source, target, weight FROM linked WHERE source <> target", **_GRAPH)
def evidence_edges(t: Tables) -> DataFrame:
    mentions = note_phrases(t).withColumn("mention_id", F.concat_ws("-", "note_id", "k"))
    return G.evidence_edges(mentions, N.signals(note_texts(t), "note_id", "text"))


@query("evidence_nodes", """SELECT DISTINCT note_id, 'section' AS node, 'sec-' || replace(lower(section), ' ', '-') AS id, NULL::INT AS start, NULL::INT AS "end", section AS text FROM mm
  UNION ALL SELECT DISTINCT m.note_id, 'sentence', 'sent-' || m.a, m.a::INT, (m.a + length(n.sentence))::INT, n.sentence FROM mm m JOIN sen n ON n.note_id = m.note_id AND n.a = m.a
  UNION ALL SELECT note_id, 'span', 'sp-' || id, x::INT, y::INT, phrase FROM mm
  UNION ALL SELECT note_id, 'cue', 'cue-' || a || '-' || kind || '-' || value, start::INT, stop::INT, cue FROM said WHERE (note_id, a) IN (SELECT (note_id, a) FROM mm)""", **_GRAPH)
def evidence_nodes(t: Tables) -> DataFrame:
    mentions = note_phrases(t).withColumns({"mention_id": F.concat_ws("-", "note_id", "k"), "concept_id": F.lit(None).cast("string")})
    return G.evidence_nodes(mentions, N.signals(note_texts(t), "note_id", "text"))
