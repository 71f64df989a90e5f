"""Indexes over the terms: scored full-text search, phrases by position, fragments of the original
text, beginnings of words, and words within one edit.

Each index is a table that is stored in ranges of what it is looked up by, so that a search reads
the files of its own words only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize, normalize_text, query_variants, tokens
from ..sources.storage import clustered, stored

#: The usual parameters of BM25, and a boost for each field that is searched.
K1, B = 1.2, 0.75
FIELDS = {"display": 4.0, "fsn": 4.0, "synonyms": 4.0}


# ---- scored search


@dataclass(frozen=True)
class TextIndex:
    """postings: token, field, doc, positions, frequency, share (the part of BM25 that depends on the
    posting alone), clustered by token. words: token, field, documents, idf, bound (no posting of the
    token in the field scores more), clustered by token. rows: the documents, by doc."""

    postings: DataFrame
    words: DataFrame
    rows: DataFrame
    doc: str


def _field_tokens(rows: DataFrame, doc: str, fields: tuple[str, ...]) -> DataFrame:
    """doc, field, words (of an array of texts all, one after the other, a place apart)."""
    kinds = dict(rows.dtypes)
    gap = F.array(F.lit(""))  # between two texts of a field, so that no phrase spans both
    listed = lambda f: F.flatten(F.transform(f, lambda x: F.concat(tokens(x), gap))) if kinds[f].startswith("array") else tokens(F.col(f))
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(listed(f), F.array().cast("array<string>")).alias("words")) for f in fields))
    return rows.select(F.col(doc).alias("doc"), F.explode(each).alias("e")).select("doc", "e.field", "e.words")


def text_index(rows: DataFrame, doc: str, fields: tuple[str, ...] = tuple(FIELDS), partitions: int = 8) -> TextIndex:
    """The index of rows (fields normalized texts or arrays of them). Rows of one doc count together.
    Texts are shuffled by doc once, and their words never before they are ordered by token."""
    texts = rows.select(doc, *fields).repartition(doc)
    worded = _field_tokens(texts, doc, fields).withColumn("own", F.size(F.filter("words", lambda w: w != "")))
    worded = worded.withColumn("length", F.sum("own").over(Window.partitionBy("doc", "field")))
    whole = worded.where("length > 0").groupBy("doc", "field").agg(F.first("length").alias("length"))
    lengths = stored(whole.groupBy("field").agg(F.avg("length").alias("mean")), "field-lengths")  # a row for each field
    total = rows.count()
    placed = worded.select("doc", "field", "length", F.posexplode("words").alias("position", "token")).where("token <> ''")
    found = placed.groupBy("token", "field", "doc").agg(F.sort_array(F.collect_list("position")).alias("positions"), F.first("length").alias("length"))
    frequency = F.size("positions")
    share = frequency / (frequency + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    whole = stored(found.join(F.broadcast(lengths), "field").select("token", "field", "doc", "positions", frequency.alias("frequency"), share.alias("share")), "found")
    postings = clustered(whole, "postings", "token", "doc", partitions=partitions)
    idf = F.log1p((F.lit(total) - F.col("documents") + 0.5) / (F.col("documents") + 0.5))
    words = postings.groupBy("token", "field").agg(F.count(F.lit(1)).alias("documents"), F.max("share").alias("most")).withColumn("idf", idf).withColumn("bound", F.col("idf") * F.col("most")).drop("most")
    return TextIndex(postings, clustered(words, "words", "token", partitions=partitions), rows, doc)


def _scores(postings: DataFrame, weights: dict[tuple[str, str], float]) -> DataFrame:
    """doc, score of the postings, each worth its (token, field)'s weight."""
    table = F.create_map(*(x for (token, field), w in sorted(weights.items()) for x in (F.lit(f"{field} {token}"), F.lit(w))))
    worth = F.col("share") * table[F.concat_ws(" ", "field", "token")]
    return postings.withColumn("part", worth).where("part IS NOT NULL").groupBy("doc").agg(F.sum("part").alias("score"))


def bm25_top(index: TextIndex, query: str, limit: int, boosts: dict[str, float] | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """doc, score of the best documents for any of the query's words, summed over fields with their
    boosts; equal scores by doc. allowed: a DataFrame of doc that limits the search before it.

    Bounds spare the long lists of common words. The lists that can score most give a first top list
    and its last score; words that together can't reach it never bring in a document of their own,
    and are read only to complete the scores of the others.
    """
    boosts = boosts or FIELDS
    words = sorted(set(normalize_text(query).split()))
    known = [(r.token, r.field, r.idf, r.bound) for r in index.words.where(F.col("token").isin(*words)).collect()] if words else []  # words times fields rows
    weights = {(t, f): idf * boosts[f] for t, f, idf, _ in known if f in boosts}
    reach = {t: sum(b * boosts[f] for u, f, _, b in known if u == t and f in boosts) for t in words}
    order = sorted((t for t in words if reach[t] > 0), key=lambda t: (-reach[t], t))
    if not order:
        return index.postings.limit(0).select("doc", F.lit(0.0).alias("score"))
    mine = index.postings.where(F.col("token").isin(*order) & F.col("field").isin(*boosts)).select("doc", "token", "field", "share")
    if allowed is not None:
        mine = mine.join(allowed.select(F.col("doc")).distinct(), "doc", "left_semi")
    ranked = lambda df: df.withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), "doc").limit(limit)
    if len(order) > 1:
        first = ranked(_scores(mine.where(F.col("token") == order[0]), weights)).agg(F.min("score"), F.count(F.lit(1))).first()
        least = first[0] if first[1] == limit else 0.0
        alone = essential_words([(t, reach[t]) for t in order], least)
        if len(alone) < len(order):
            candidates = mine.where(F.col("token").isin(*alone)).select("doc").distinct()
            mine = mine.join(candidates, "doc", "left_semi")
    return ranked(_scores(mine, weights))


def essential_words(reach: list[tuple[str, float]], least: float) -> list[str]:
    """Words, by what they can score at most, without the longest tail that stays below least in sum."""
    kept, rest = [t for t, _ in reach], 0.0
    for token, most in reversed(reach):
        rest += most
        if rest >= least - 1e-6:
            break
        kept.remove(token)
    return kept


def _next_place(places: str):
    """A chain of places gone on to the next one of a column."""
    return lambda s: F.struct(s["start"].alias("start"), F.array_min(F.filter(places, lambda q: q > s["at"])).alias("at"))


def phrase_documents(index: TextIndex, phrase: str, field: str, slop: int = 0) -> DataFrame:
    """doc, start: the first place where a field has the phrase's words in order, with up to slop
    words between them in all. Positions meet by document, from the rarest word on."""
    words = normalize_text(phrase).split()
    if not words:
        return index.postings.select("doc", F.lit(0).alias("start")).limit(0)
    counts = {r.token: r.documents for r in index.words.where(F.col("token").isin(*words) & (F.col("field") == field)).collect()}
    out = None
    for k in sorted(range(len(words)), key=lambda k: (counts.get(words[k], 0), k)):
        own = index.postings.where((F.col("token") == words[k]) & (F.col("field") == field)).select("doc", F.col("positions").alias(f"p{k}"))
        out = own if out is None else out.join(own, "doc")
    starts = F.transform("p0", lambda p: F.struct(p.alias("start"), p.alias("at")))
    for k in range(1, len(words)):
        starts = F.filter(F.transform(starts, _next_place(f"p{k}")), lambda s: s["at"].isNotNull())
    fits = F.filter(starts, lambda s: s["at"] - s["start"] - (len(words) - 1) <= slop)
    return out.select("doc", F.array_min(F.transform(fits, lambda s: s["start"])).alias("start")).where("start IS NOT NULL")


# ---- fragments of the original text


FRAGMENT_WORDS = 12
_WORD = "[\\p{L}\\p{N}][\\p{L}\\p{N}\\p{M}]*"


def words_at(text: Column) -> Column:
    """The words of a text as they are written, with their normal form, 0-based start and end (exclusive)."""
    gaps, words = F.split(text, _WORD, -1), F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(words)), words, lambda g, w: F.struct(F.length(g).alias("g"), w.alias("w")))
    none = F.array().cast("array<struct<word:string,start:int,end:int>>")
    start = lambda acc, x: F.coalesce(F.element_at(acc, -1)["end"], F.lit(0)) + x["g"]
    add = lambda acc, x: F.concat(acc, F.array(F.struct(x["w"].alias("word"), start(F.nullif(acc, none), x).alias("start"), (start(F.nullif(acc, none), x) + F.length(x["w"])).alias("end"))))
    return F.transform(F.aggregate(pairs, none, add), lambda x: F.struct(x["word"].alias("word"), normalize(x["word"]).alias("normal"), x["start"].alias("start"), x["end"].alias("end")))


def best_fragment(text: Column, query: str, most: int = FRAGMENT_WORDS) -> Column:
    """The stretch of at most so many words of a text that shows the query best: most different
    words of it, then most words, then the earliest; it begins and ends where a word of the query
    does. A struct of fragment (as written), start, end, hit (the words found, as written) and hits
    (their places in the fragment); null if no word of the query or its variants occurs."""
    wanted = sorted({w for v in query_variants(query) for w in v.split()})
    if not wanted:
        return F.lit(None).cast("struct<fragment:string,start:int,end:int,hit:string,hits:array<struct<start:int,end:int>>>")
    numbered = F.transform(words_at(text), lambda x, k: F.struct(k.alias("k"), x["word"].alias("word"), x["normal"].alias("normal"), x["start"].alias("start"), x["end"].alias("end")))
    found = F.filter(numbered, lambda x: x["normal"].isin(*wanted))

    def scored(hits: Column) -> Column:
        within = lambda h: F.filter(hits, lambda x: (x["k"] >= h["k"]) & (x["k"] < h["k"] + most))
        rate = lambda h: F.struct(F.size(F.array_distinct(F.transform(within(h), lambda x: x["normal"]))).alias("different"), F.size(within(h)).alias("n"), (-h["k"]).alias("early"), within(h).alias("hits"))
        # arrays compare by their first elements, so the best window is the greatest struct without its hits
        rated = F.transform(hits, rate)
        key = lambda r: F.struct(r["different"], r["n"], r["early"])
        best = F.array_max(F.transform(rated, key))
        return F.get(F.filter(rated, lambda r: key(r) == best), F.lit(0))["hits"]

    # an aggregate over one element names a value without working it out again
    named = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))

    def shown(hits: Column) -> Column:
        start, end = hits[0]["start"], F.element_at(hits, -1)["end"]
        places = F.transform(hits, lambda x: F.struct((x["start"] - start).alias("start"), (x["end"] - start).alias("end")))
        made = F.struct(F.substring(text, start + 1, end - start).alias("fragment"), start.alias("start"), end.alias("end"), F.array_join(F.transform(hits, lambda x: x["word"]), " ").alias("hit"), places.alias("hits"))
        return F.when(F.size(hits) > 0, made)

    return named(found, lambda hits: F.when(F.size(hits) > 0, named(scored(hits), shown)))


def fragments(rows: DataFrame, key: str, query: str, *paths: str, most: int = FRAGMENT_WORDS) -> DataFrame:
    """key, path and the best fragment of each of the row's texts (columns, or arrays of texts) that has one."""
    kinds = dict(rows.dtypes)
    texts = lambda p: F.col(p) if kinds[p].startswith("array") else F.array(p)
    named = lambda p: lambda x, k: F.struct(F.lit(p).alias("path"), k.alias("place"), x.alias("text"))
    every = F.flatten(F.array(*(F.transform(F.coalesce(texts(p), F.array().cast("array<string>")), named(p)) for p in paths)))
    each = rows.select(key, F.explode(every).alias("t")).select(key, "t.path", "t.place", F.col("t.text").alias("text"))
    return each.withColumn("best", best_fragment(F.col("text"), query, most)).where("best IS NOT NULL").select(key, "path", "place", "best.*")


# ---- beginnings of words, and words within an edit

MIN_GRAM, MAX_GRAM = 2, 24


def edge_grams(rows: DataFrame, doc: str, field: str) -> DataFrame:
    """gram, doc, position, size: the beginnings, of 2 to 24 characters, of every word of a normalized
    text, and the word's length; a word of one letter is its own."""
    word = F.posexplode(tokens(F.col(field))).alias("position", "token")
    lengths = F.sequence(F.least(F.length("token"), F.lit(MIN_GRAM)), F.least(F.length("token"), F.lit(MAX_GRAM)))
    spread_out = rows.select(F.col(doc).alias("doc"), word).select("doc", "position", "token", F.explode(lengths).alias("n"))
    return spread_out.select(F.substring("token", F.lit(1), F.col("n")).alias("gram"), "doc", "position", F.length("token").alias("size"))


def deletions(word: Column, keep: int) -> Column:
    """The word, and the word without each one of its characters after the first few that stay."""
    left = F.when(F.length(word) > keep, F.transform(F.sequence(F.lit(keep + 1), F.length(word)), lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, F.length(word)))))
    return F.array_distinct(F.concat(F.array(word), F.coalesce(left, F.array().cast("array<string>"))))


#: Characters at the beginning that a typo never changes.
FIXED_PREFIX = 2


def vocabulary(rows: DataFrame, field: str) -> DataFrame:
    """token, documents of a normalized text."""
    return rows.select(F.explode(F.array_distinct(tokens(F.col(field)))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("documents"))


@dataclass(frozen=True)
class BeginningIndex:
    """The indexes of a field (a normalized text) of rows, each stored when it is first read."""

    rows: DataFrame
    doc: str
    field: str
    partitions: int = 8

    @cached_property
    def words(self) -> DataFrame:
        """token, documents."""
        return stored(vocabulary(self.rows, self.field), "vocabulary")

    @cached_property
    def grams(self) -> DataFrame:
        """gram, doc, position, size, clustered by gram."""
        return clustered(edge_grams(self.rows, self.doc, self.field), "grams", "gram", "doc", partitions=self.partitions)

    @cached_property
    def near(self) -> DataFrame:
        """form, token, a row for each form of a word without one character, clustered by form."""
        return clustered(forms(self.words, "token").select("form", "token"), "near", "form", "token", partitions=self.partitions)

    @cached_property
    def holders(self) -> DataFrame:
        """token, doc, clustered by token."""
        held = self.rows.select(F.col(self.doc).alias("doc"), F.explode(F.array_distinct(tokens(F.col(self.field)))).alias("token"))
        return clustered(held.select("token", "doc"), "holders", "token", "doc", partitions=self.partitions)


def beginning_index(rows: DataFrame, doc: str, field: str, partitions: int = 8) -> BeginningIndex:
    return BeginningIndex(rows, doc, field, partitions)


def forms(words: DataFrame, word: str) -> DataFrame:
    """A word's column, form: the word and what it is without one character."""
    return words.select(word, F.explode(deletions(F.col(word), FIXED_PREFIX)).alias("form"))


def completions(index: BeginningIndex, query: str) -> DataFrame:
    """doc of the texts that have the query's words in sequence, the last as a beginning. Every word
    is an equality on a gram; a word of more than 24 characters is known by its length and its
    first 24, and a beginning of one letter finds words of one letter only."""
    words = normalize_text(query).split()
    if not words:
        return index.grams.select("doc").limit(0)
    gram = lambda w, k: index.grams.where(F.col("gram") == w[:MAX_GRAM]).select("doc", (F.col("position") - k).alias("start"), "size")
    found = gram(words[-1], len(words) - 1).where(F.col("size") >= len(words[-1])).select("doc", "start")
    for k, w in enumerate(words[:-1]):
        found = found.join(gram(w, k).where(F.col("size") == len(w)).select("doc", "start"), ["doc", "start"], "left_semi")
    return found.select("doc").distinct()


def within_one_edit(queries: DataFrame, near: DataFrame) -> DataFrame:
    """query, token for words at most one insertion, deletion or replacement apart that begin alike.
    queries: query. Words one edit apart share a form without one character, so they meet by
    equality, many queries at once; the distance is then worked out for those alone."""
    met = forms(queries, "query").join(near, "form").select("query", "token")
    alike = F.substring("query", 1, FIXED_PREFIX) == F.substring("token", 1, FIXED_PREFIX)
    return met.where(alike & (F.levenshtein("query", "token") <= 1)).distinct()


def near_words(index: BeginningIndex, word: str) -> DataFrame:
    """token within one edit of a word: its few forms are conditions on the stored files."""
    text = normalize_text(word)
    forms = sorted({text} | {text[:k] + text[k + 1 :] for k in range(FIXED_PREFIX, len(text))})
    met = index.near.where(F.col("form").isin(*forms)).select("token").distinct()
    return met.where(F.col("token").startswith(text[:FIXED_PREFIX]) & (F.levenshtein("token", F.lit(text)) <= 1))


def fuzzy_documents(index: BeginningIndex, word: str) -> DataFrame:
    """doc of the texts with a word within one edit."""
    return index.holders.join(near_words(index, word), "token", "left_semi").select("doc").distinct()
