"""Text functions as column expressions; query-side variants in plain Python."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def _unmarked(c: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", c) if not 0x300 <= ord(x) <= 0x36F)


#: Letters with accents, from Unicode's own decompositions: source and folded. What decomposes into
#: several letters (Hangul) or keeps a mark of its own (kana) stays whole.
_FOLDED = {chr(c): d for c in range(0xC0, 0x10000) if len(d := _unmarked(chr(c))) == 1 and d != chr(c)}
ACCENTED, PLAIN = "".join(_FOLDED), "".join(_FOLDED.values())
_FOLDING = str.maketrans(_FOLDED)
_SEPARATORS = re.compile(r"[\W_]+")


def fold_accents(text: Column) -> Column:
    """Letters without accents; loose combining marks go as well. Plain ASCII has neither."""
    folded = F.regexp_replace(F.translate(text, ACCENTED, PLAIN), "[\\u0300-\\u036F]", "")
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(folded)


def normalize(text: Column) -> Column:
    """Accents folded, lower case, everything but letters and digits one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(text)), "[^\\p{L}\\p{N}]+", " "))


def normalize_text(text: str) -> str:
    """normalize() for query strings, by the same table."""
    folded = re.sub("[\u0300-\u036f]", "", text.translate(_FOLDING))
    return _SEPARATORS.sub(" ", folded.lower()).strip(" ")


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda x: x != "")


def singular(token: Column) -> Column:
    """Without a plural ending, then with the masculine or plain form of an adjective's ending,
    of English and Spanish; short tokens keep their plural."""
    cut = lambda text, k: text.substr(F.lit(1), F.length(text) - k)
    n = F.length(token)
    one = F.when((n > 5) & token.endswith("es"), cut(token, 2)).when((n > 4) & token.endswith("s"), cut(token, 1)).otherwise(token)
    return (
        F.when(one.endswith("icas"), F.concat(cut(one, 4), F.lit("ico")))
        .when(one.endswith("ica"), F.concat(cut(one, 3), F.lit("ico")))
        .when(one.endswith("iques"), F.concat(cut(one, 5), F.lit("ic")))
        .when(one.endswith("ies") & (F.length(one) > 5), F.concat(cut(one, 3), F.lit("y")))
        .otherwise(one)
    )


def singular_text(token: str) -> str:
    """singular() for query strings."""
    n = len(token)
    one = token[:-2] if n > 5 and token.endswith("es") else token[:-1] if n > 4 and token.endswith("s") else token
    for ending, new, least in (("icas", "ico", 0), ("ica", "ico", 0), ("iques", "ic", 0), ("ies", "y", 6)):
        if one.endswith(ending) and len(one) >= least:
            return one[: -len(ending)] + new
    return one


# Catalan and misspelt forms and what they stand for.
REPLACEMENTS = {
    "diabetis": "diabetes", "cancer": "cancer", "canceres": "cancer", "càncer": "cancer", "tumoracio": "tumoracion", "tumefaccio": "tumefaccion",
    "inflamatori": "inflamatorio", "inflamatoria": "inflamatoria", "inflamatoris": "inflamatorios", "inflamatories": "inflamatorias",
    "proliferatiu": "proliferativo", "proliferativa": "proliferativa", "proliferatius": "proliferativos", "proliferatives": "proliferativas",
}
MAX_VARIANTS = 6


def query_variants(text: str, most: int = MAX_VARIANTS) -> list[str]:
    """Normal form, lemma form, and one form per replaced token, without repeats."""
    words = normalize_text(text).split()
    swapped = [[*words[:k], other, *words[k + 1 :]] for k, w in enumerate(words) for other in (singular_text(w), REPLACEMENTS.get(w, w)) if other != w]
    forms = [words, [singular_text(w) for w in words], *swapped]
    return [x for x in dict.fromkeys(" ".join(f) for f in forms) if x][:most]


def variants(text: Column, most: int = MAX_VARIANTS) -> Column:
    """query_variants() of a column of phrases."""
    words = tokens(normalize(text))
    table = F.create_map(*(F.lit(x) for pair in REPLACEMENTS.items() for x in pair))
    swap = lambda k, other: F.array_join(F.transform(words, lambda w, i: F.when(i == k, other).otherwise(w)), " ")
    per_word = F.flatten(F.transform(words, lambda w, k: F.array(swap(k, singular(w)), swap(k, F.coalesce(table[w], w)))))
    whole = F.array(F.array_join(words, " "), F.array_join(F.transform(words, singular), " "))
    return F.slice(F.filter(F.array_distinct(F.concat(whole, per_word)), lambda x: x != ""), 1, most)


def tokens_with_offsets(text: Column) -> Column:
    """Runs of letters and digits with their 0-based start and end (exclusive)."""
    gaps = F.split(text, "[\\p{L}\\p{N}]+", -1)
    words = F.regexp_extract_all(text, F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    lengths = lambda x, n: F.aggregate(F.transform(F.slice(x, 1, n), F.length), F.lit(0), lambda a, b: a + b)
    start = lambda i: lengths(gaps, i + 1) + lengths(words, i)
    return F.transform(words, lambda w, i: F.struct(w.alias("word"), start(i).alias("start"), (start(i) + F.length(w)).alias("end")))


def semantic_tag(fsn: Column) -> Column:
    """What stands in the last parentheses; null if there are none."""
    found = F.regexp_extract(fsn, "\\(([^()]+)\\)\\s*$", 1)
    return F.when(found != "", F.trim(found))


def without_tag(fsn: Column) -> Column:
    return F.trim(F.regexp_replace(fsn, "\\s*\\([^()]+\\)\\s*$", ""))


def slug(text: Column) -> Column:
    return F.regexp_replace(normalize(text), " ", "-")


# Patterns of Spanish tags and the English tags that they stand for, first hit wins.
TAGS_ES_EN = [
    ("^trastorno$", "disorder"),
    ("^hallazgo$", "finding"),
    ("^evento$", "event"),
    ("^anomal[ií]a morfol[oó]gica$", "morphologic abnormality"),
    ("^estructura corporal$", "body structure"),
    ("^procedimiento$", "procedure"),
    ("^r[eé]gimen/tratamiento$", "regime/therapy"),
    ("^sustancia$", "substance"),
    ("^entidad observable$", "observable entity"),
    ("producto|f[aá]rmaco|presentaci[oó]n farmac[eé]utica|forma farmac[eé]utica", "product"),
]


# Tags that are English already, and that no pattern changes.
ENGLISH_TAGS = ("disorder", "finding", "event", "morphologic abnormality", "body structure", "procedure", "regime/therapy", "substance", "observable entity", "product")
# One pattern for all of them: most tags match none.
_SPANISH = "|".join(pattern for pattern, _ in TAGS_ES_EN)


def english_tag(tag: Column) -> Column:
    low = F.lower(F.trim(tag))
    out = None
    for pattern, english in TAGS_ES_EN:
        out = F.when(low.rlike(pattern), english) if out is None else out.when(low.rlike(pattern), english)
    return F.when(low.isin(*ENGLISH_TAGS), low).when(low.rlike(_SPANISH), out).otherwise(low)


# Tags that mean a clinical state, and those that mean something given.
CLINICAL_TAGS = ("disorder", "finding", "observable entity", "trastorno", "hallazgo", "entidad observable")
MEDICATION_TAGS = ("substance", "medicinal product", "clinical drug", "product", "sustancia", "producto medicinal", "producto")


def clinical_kind(tag: Column) -> Column:
    plain = normalize(F.coalesce(tag, F.lit("")))
    return F.when(plain.isin(*CLINICAL_TAGS), "clinical").when(plain.isin(*MEDICATION_TAGS), "medication").otherwise(plain)


# Words that hint at a language.
LANGUAGE_HINTS = {
    "es": "paciente con sin para retinopatia diabetica oncologico mama dolor plan".split(),
    "en": "patient with without follow pain history finding procedure diabetic plan".split(),
}


def detect_language(text: Column, requested: Column) -> Column:
    """The language with more hints, two more for a Spanish accent; of equals the requested one, else es."""
    plain = normalize(F.coalesce(text, F.lit("")))
    hits = lambda lang: sum((F.contains(plain, F.lit(w)).cast("int") for w in LANGUAGE_HINTS[lang]), F.lit(0))
    es = hits("es") + F.when(F.lower(text).rlike("[áéíóúñ]"), 2).otherwise(0)
    asked = normalize(F.coalesce(requested, F.lit("")))
    return F.when(es > hits("en"), "es").when(es < hits("en"), "en").when(asked.isin("en", "es"), asked).otherwise("es")


# Relationship type terms of the "other" category.
OTHER_RELATIONS = "module|status|map|historical|replaced|same as|alternative|equivalent|association|refset"


def relationship_category(type_id: Column, term: Column) -> Column:
    return F.when(type_id == "116680003", "defining").when(F.lower(term).rlike(OTHER_RELATIONS), "other").otherwise("attribute")


def truthy(value: Column) -> Column:
    """Flags that come as numbers, strings or booleans."""
    return F.coalesce(F.lower(value.cast("string")).isin("true", "1"), F.lit(False))


def parse_release_date(text: Column) -> Column:
    return F.try_to_timestamp(F.when(text.rlike("^[0-9]{8}$"), text), F.lit("yyyyMMdd"))


def preview(text: Column, most: int = 120) -> Column:
    trimmed = F.trim(text)
    return F.when(F.length(trimmed) > most, F.concat(F.substring(trimmed, 1, most - 3), F.lit("..."))).otherwise(trimmed)


def request_fingerprint(*parts: Column) -> Column:
    """SHA-256 of a request's parts as JSON: equal requests, equal values."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts))).cast("binary"), 256)


def query_hash(text: Column) -> Column:
    return F.substring(F.sha1(F.lower(F.trim(text)).cast("binary")), 1, 16)


def locale_order(term: Column, language: Column, own: tuple[str, ...] = ("es",)) -> list[Column]:
    """Sort keys of a term: by the collation of its language where that has one of its own, else by
    the root collation. Letters first, then accents, then case. Compares terms of one language."""
    keys = [F.collate(F.when(language == x, term), x) for x in own]
    return [*keys, F.collate(F.when(~F.coalesce(language.isin(*own), F.lit(False)), term), "UNICODE")]
