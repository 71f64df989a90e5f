"""Quality rules with distribution divergence.

Every document gets the base counts of the contract, a histogram over nine character
classes and one over its language's common words. The histograms of the documents that pass
the base rule add up, by language, to the references; a document whose Jensen-Shannon
distance from its language's reference is too large is rejected, unless it is too short to
tell. How far a clean text may be from the reference of common words depends on its length:
n words drawn from the reference itself lie sqrt((k - 1) / (8 n ln 2)) away from it on k
classes, and WORD_MARGIN more is allowed.

One pass reads the texts and stores only the counts. The references are as many rows as
there are word lists plus one, whatever the corpus holds, so joining them by broadcast is
bounded.

Defined cases: a null or empty text has no words and fails the base rule; a null or
unlisted language uses the reference of all unlisted languages, which has no word list, so
only character classes count; a language none of whose documents passes the base rule has no
reference, and nothing more to reject; a very long text is counted whole, and distances
equal to a limit pass; repeated rows each get their own row and count as often; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import base_columns, released, ship, slices, stored

# The most frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on with as be at by this are from or an not have".split(),
    "fr": "de la le et les des en un une du que est pour dans qui par sur au plus ne pas ce se son".split(),
    "es": "de la que el en y a los se del las un por con una para su al es lo como más o pero".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden".split(),
}
# The characters that the base rule counts as symbols.
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "line", "punctuation", "symbol", "beyond_ascii", "other")
OTHER = "other"
N_WORDS = max(map(len, COMMON_WORDS.values())) + 1

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_CHAR_DISTANCE, MIN_CHARS = 0.30, 200
# A text without a listed word is 0.37 to 0.38 from a reference in which a quarter of the words are listed.
MAX_WORD_DISTANCE, WORD_MARGIN = 0.25, 0.08
WORD_NOISE = (N_WORDS - 1) / (8 * log(2))

_EDGE = ".,;:!?\"'()[]"
_TABLE = np.full(256, CLASSES.index("other"), dtype=np.int64)
for _name, _chars in (("lower", "abcdefghijklmnopqrstuvwxyz"), ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", "0123456789"), ("space", " \t\r\x0b\x0c"), ("line", "\n"), ("punctuation", ".,;:!?'\"()-[]"), ("symbol", SYMBOLS)):
    _TABLE[[ord(c) for c in _chars]] = CLASSES.index(_name)
_TABLE[0xC0:] = CLASSES.index("beyond_ascii")  # lead bytes; continuation bytes don't count
_CONTINUES = np.zeros(256, dtype=bool)
_CONTINUES[0x80:0xC0] = True

COUNTS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_chars long, n_listed long, classes array<long>, common array<long>"
NAMES = [x.split()[0] for x in COUNTS.split(", ")]


def repeated_words(codes: np.ndarray) -> int:
    """Positions inside 3-word windows that occur twice or more."""
    n = len(codes) - 2
    if n < 2:
        return 0
    width = np.int64(codes.max()) + 1
    if width < 2_000_000:
        keys = (codes[:-2] * width + codes[1:-1]) * width + codes[2:]
    else:  # ids too wide for one word: number the pairs first
        _, pairs = np.unique(codes[:-2] * width + codes[1:-1], return_inverse=True)
        keys = pairs.astype(np.int64) * width + codes[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    at = np.zeros(n, dtype=bool)
    at[order[1:][same]] = True
    at[order[:-1][same]] = True
    covered = np.zeros(n + 2, dtype=bool)
    for k in range(3):
        covered[k : k + n] |= at
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def _measure(ids: pa.Array, languages: pa.Array, texts: pa.Array) -> list[pa.Array]:
    """COUNTS for one batch of rows."""
    texts, langs = texts.fill_null(""), languages.to_pylist()
    split = pc.ascii_split_whitespace(texts)
    words = split.flatten()
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(langs)), lengths)
    keep = pc.greater(pc.binary_length(words), 0)
    row = row[keep.to_numpy(zero_copy_only=False)]
    words = words.filter(keep).dictionary_encode()
    codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    unique = words.dictionary
    sizes = pc.utf8_length(unique).to_numpy(zero_copy_only=False).astype(np.int64)
    plain = pc.utf8_lower(pc.utf8_trim(unique, _EDGE)) if len(unique) else unique
    n = len(langs)
    n_words = np.bincount(row, minlength=n)
    word_chars = np.bincount(row, weights=sizes[codes], minlength=n).astype(np.int64)
    common = np.zeros((n, N_WORDS), dtype=np.int64)
    spoken = np.array([list(COMMON_WORDS).index(x) if x in COMMON_WORDS else -1 for x in langs])
    for k, listed in enumerate(COMMON_WORDS.values()):
        mine = spoken[row] == k
        if mine.any():
            place = pc.fill_null(pc.index_in(plain, pa.array(listed)), N_WORDS - 1).to_numpy(zero_copy_only=False)
            common += np.bincount(row[mine] * N_WORDS + place[codes[mine]], minlength=n * N_WORDS).reshape(n, N_WORDS)
    starts = np.concatenate([[0], np.cumsum(n_words)])
    classes = np.zeros((n, len(CLASSES)), dtype=np.int64)
    repeats, dups = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, text in enumerate(texts.to_pylist()):
        by_byte = np.bincount(np.frombuffer(text.encode(), dtype=np.uint8), minlength=256)
        by_byte[_CONTINUES] = 0
        classes[i] = np.bincount(_TABLE, weights=by_byte, minlength=len(CLASSES))
        repeats[i] = repeated_words(codes[starts[i] : starts[i + 1]])
        dups[i] = duplicate_lines(text)
    numbers = (n_words, word_chars, classes[:, CLASSES.index("symbol")], dups, repeats, classes.sum(axis=1), common.sum(axis=1))
    return [ids, languages, *(pa.array(np.asarray(x, np.int64)) for x in numbers), _lists(classes), _lists(common)]


def _lists(table: np.ndarray) -> pa.Array:
    n, width = table.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(table.ravel()))


@released
def _counts(batches):
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays(_measure(*batch.columns), names=NAMES)


@released
def _counts_beside(batches):
    for batch in slices(batches):
        doc = batch.column("doc")
        yield pa.RecordBatch.from_arrays([doc, *_measure(*(pc.struct_field(doc, x) for x in ("doc_id", "lang", "text")))], names=["doc", *NAMES])


def document_counts(docs: DataFrame) -> DataFrame:
    """The base counts and both histograms of every document, stored."""
    ship(docs.sparkSession)
    narrow = base_columns(docs, "doc_id", "lang", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return stored(narrow.mapInArrow(_counts, COUNTS), "quality")


def _reference_key() -> F.Column:
    return F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(F.lit(OTHER))


def _base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def language_references(counts: DataFrame) -> DataFrame:
    """Both histograms of the documents that pass the base rule, and their totals, by language:
    at most len(COMMON_WORDS) + 1 rows."""
    added = lambda name, n: F.array(*(F.sum(F.col(name)[i]) for i in range(n)))
    passed = counts.where(~_base_failed()).groupBy(_reference_key().alias("reference"))
    return passed.agg(added("classes", len(CLASSES)).alias("ref_classes"), added("common", N_WORDS).alias("ref_common"), F.sum("n_chars").alias("ref_chars"), F.sum("n_listed").alias("ref_listed"))


def divergence(own: str, own_total: str, reference: str, reference_total: str) -> F.Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms; 0 if either is empty or null."""
    gain = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    shares = lambda name, total: F.transform(name, lambda x: x / F.col(total))
    parts = F.zip_with(shares(own, own_total), shares(reference, reference_total), lambda p, q: gain(p, (p + q) / 2) + gain(q, (p + q) / 2))
    summed = F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)
    return F.when((F.col(own_total) > 0) & (F.col(reference_total) > 0), F.sqrt(F.greatest(F.lit(0.0), summed / 2))).otherwise(F.lit(0.0))


def word_limit(n_words: F.Column) -> F.Column:
    """The distance from the common words of its language that a text of n words may have."""
    return F.greatest(F.lit(MAX_WORD_DISTANCE), F.sqrt(F.lit(WORD_NOISE) / n_words) + F.lit(WORD_MARGIN))


def _judged(counts: DataFrame, references: DataFrame) -> DataFrame:
    joined = counts.withColumn("reference", _reference_key()).join(F.broadcast(references), "reference", "left")
    scored = joined.withColumns({"char_distance": divergence("classes", "n_chars", "ref_classes", "ref_chars"), "word_distance": divergence("common", "n_listed", "ref_common", "ref_listed"), "base_failed": _base_failed()})
    strange = ((F.col("n_chars") >= MIN_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)) | ((F.col("n_words") > 0) & (F.col("word_distance") > word_limit(F.col("n_words"))))
    return scored.withColumn("kept", ~F.col("base_failed") & ~strange)


def verdicts(docs: DataFrame) -> DataFrame:
    """One row per document: counts, both distances, base_failed, kept."""
    counts = document_counts(docs)
    return _judged(counts, language_references(counts)).drop("classes", "common", "n_listed", "ref_classes", "ref_common", "ref_chars", "ref_listed", "reference")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, then both distances."""
    return verdicts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


def keep_clean(docs: DataFrame) -> DataFrame:
    """docs without the rejected rows, all columns kept. A second reading of the texts beside
    their counts costs less than a shuffle of the texts to meet stored verdicts would.
    """
    references = stored(language_references(document_counts(docs)), "quality-references")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    counted = whole.mapInArrow(_counts_beside, f"doc {whole.schema['doc'].dataType.simpleString()}, {COUNTS}")
    return _judged(counted, references).where("kept").select("doc.*")
