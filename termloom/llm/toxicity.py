"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Labels come from a sample of at most MAX_TRAIN rows (by a hash of doc_id), never from rows
held out. Everything learned from it is bounded: a lexicon of at most MAX_UNITS units, two
forests and two step functions.

1. Lexicon. Units are whole words and their prefixes of 3 to 7 letters. Spark counts the
   toxic texts that hold each; the MAX_CANDIDATES in most of them are then counted in all
   training texts. A unit's weight is the lower bound (one standard error) of the logarithm of
   its odds, and a word weighs as much as its heaviest unit. Weights that a training text
   meets are counted without the texts of its own fold, so that no text vouches for its own
   words.
2. Features, FEATURES: densities of heavy words and of a stated list of insults, closeness to
   second-person pronouns, capitals, punctuation, obfuscation (letters mixed with digits or
   signs inside a word, read by their likeness to letters), stretched letters. Neither
   labels, lang, source nor doc_id is one.
3. Two members, each a forest of gradient-boosted trees fitted on one half of the training
   rows and calibrated by isotonic regression on the other half's margins. A score is the mean
   of both calibrated members.

Scoring reads each text once, in Arrow batches; trees and calibration run in the JVM.

Defined cases: a null or empty text has no words and gets the score of its features; a null
doc_id is not held out; a null label teaches nothing, of several labels of one doc_id the
greatest counts; if a half of the training rows lacks one of the labels, every score is the
share of toxic rows (0 without any); a very long text is read whole; repeated rows each get
their own row and the same score; equal weights go by the unit's spelling; an empty table
gives an empty result; extra columns are ignored by digest and kept by with_scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released, ship, slices, stored, text_bytes, word_codes

MAX_TRAIN, MAX_CANDIDATES, MAX_UNITS = 200_000, 100_000, 20_000
FOLDS = 4
#: A unit has to stand in so many toxic training texts; prefixes have 3 to 7 letters; longer words are cut.
MIN_TOXIC, PREFIXES, LONGEST = 2, range(3, 8), 24
LEAST_WEIGHT, SOME, HEAVY = 0.3, 1.0, 2.5
NEAR = 5
TREES, DEPTH, STEP = 24, 3, 0.2
#: Training rows to a partition.
FIT_ROWS = 10_000
THRESHOLD = 0.3

# Insults of four languages, and the second person.
INSULTS = {
    "en": "idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown fool fools pig filth vermin imbecile jerk creep".split(),
    "fr": "idiot idiote imbécile crétin abruti connard connasse salaud ordure débile minable pourriture bouffon raclure".split(),
    "es": "idiota imbécil estúpido estúpida tonto tonta basura asqueroso asquerosa inútil patético patética payaso escoria cretino".split(),
    "de": "idiot idioten dumm dummkopf blödmann trottel versager abschaum arschloch müll wertlos erbärmlich widerlich depp schwachkopf".split(),
}
SECOND_PERSON = set("you your yours yourself u ur tu te toi ton ta tes vous votre vos usted ustedes tú ti contigo du dich dir dein deine deiner euch euer ihr".split())
# Signs and digits that stand in for letters.
LIKE_LETTERS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})
EDGES = ".,;:!?\"'()[]{}<>*#%&$~_+=/\\|^`«»„“”‘’¡¿…-–—"

FEATURES = (
    "log_words", "strongest", "second", "third", "some_count", "some_density", "heavy_count", "heavy_density", "weight_density", "unit_repeats", "insult_count", "insult_density",
    "second_person_density", "insults_near_second_person", "capital_share", "exclamations", "questions", "mixed_share", "mixed_insults", "stretched_share", "word_length",
)
_INSULTS = frozenset(x for words in INSULTS.values() for x in words)


def bare(word: str) -> tuple[str, bool]:
    """The word as the lexicon knows it, and whether letters were mixed with signs or digits."""
    core = word.strip(EDGES).lower()
    if core.isalpha():
        return core[:LONGEST], False
    if not any(c.isalpha() for c in core):
        return "", False
    mixed = any(not c.isalpha() and c not in "'’-" for c in core)
    letters = "".join(c for c in (core.translate(LIKE_LETTERS) if mixed else core) if c.isalpha())
    return letters[:LONGEST], mixed


def bare_words(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """bare() of many words: only those that aren't all letters are taken one by one."""
    core = pc.utf8_lower(pc.utf8_trim(words, EDGES))
    odd = pc.invert(pc.utf8_is_alpha(core))
    at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    made = [bare(w) for w in words.take(pa.array(at)).to_pylist()]
    mixed = np.zeros(len(words), bool)
    mixed[at] = [m for _, m in made]
    core = pc.utf8_slice_codeunits(pc.replace_with_mask(core, odd, pa.array([c for c, _ in made], pa.string())), 0, LONGEST)
    return core, mixed


def unit_columns(core: pa.Array) -> list[pa.Array]:
    """A word's units: a prefix for each length (null where the word is no longer), and the whole word marked by a closing sign."""
    size = pc.utf8_length(core)
    none = pa.scalar(None, pa.string())
    prefixes = [pc.if_else(pc.greater(size, k), pc.utf8_slice_codeunits(core, 0, k), none) for k in PREFIXES]
    return [*prefixes, pc.if_else(pc.greater(size, 0), pc.binary_join_element_wise(core, "$", ""), none)]


def _text_units(texts: pa.Array, known: pa.Array | None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, unit) of every unit of every text, once each, and the units: those known, or all that there are."""
    distinct, codes, starts = word_codes(texts)
    if not len(distinct):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string()) if known is None else known
    columns = unit_columns(bare_words(distinct)[0])
    if known is None:
        coded = pa.concat_arrays(columns).dictionary_encode()
        known, numbers = coded.dictionary, coded.indices
    else:
        numbers = pc.index_in(pa.concat_arrays(columns), known)
    of_word = numbers.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(columns), len(distinct))
    text = np.repeat(np.arange(len(texts)), np.diff(starts))
    pair = np.unique(text * len(distinct) + codes)
    text, word = pair // len(distinct), pair % len(distinct)
    found = [np.unique((text * len(known) + u)[u >= 0]) for u in (column[word] for column in of_word)]  # of one length, so no unit is in two
    pair = np.concatenate(found) if len(known) else np.zeros(0, np.int64)
    return pair // max(1, len(known)), pair % max(1, len(known)), known


@released
def _toxic_units(batches):
    """(unit, texts): how many texts of a slice hold each unit."""
    for batch in slices(batches, 4 << 20):
        _, unit, known = _text_units(batch.column("text"), None)
        if len(known):
            yield pa.RecordBatch.from_arrays([known, pa.array(np.bincount(unit, minlength=len(known)))], names=["unit", "texts"])


def _unit_counts(candidates):
    """(unit, texts): of the candidates, in how many texts by toxic * FOLDS + fold each is, a row for each unit and task."""

    @released
    def run(batches):
        known = pa.array(candidates.value, pa.string())
        counts = np.zeros(len(known) * 2 * FOLDS, np.int64)
        for batch in slices(batches, 4 << 20):
            text, unit, _ = _text_units(batch.column("text"), known)
            kind = batch.column("toxic").to_numpy().astype(np.int64) * FOLDS + batch.column("fold").to_numpy()
            counts += np.bincount(unit * 2 * FOLDS + kind[text], minlength=len(counts))
        there = counts.reshape(len(known), 2 * FOLDS).any(axis=1)
        some = counts.reshape(len(known), 2 * FOLDS)[there]
        yield pa.RecordBatch.from_arrays([known.filter(pa.array(there)), _lists(some)], names=["unit", "texts"])

    return run


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic, fold of the sampled labelled documents that are not held out, stored."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, MAX_TRAIN / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    folded = sample.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int"))
    # at most MAX_TRAIN rows of 16 bytes, so broadcasting is bounded
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(folded), "doc_id"), "toxicity-training")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return odds - np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def learn_lexicon(rows: DataFrame) -> list[dict[str, float]]:
    """Weights of units: without each fold's texts, then with all. At most MAX_UNITS units, those that tell most."""
    spread = [F.sum(F.col("texts")[k]).alias(f"n{k}") for k in range(2 * FOLDS)]
    toxic_texts = rows.where("toxic = 1").select("text").mapInArrow(_toxic_units, "unit string, texts long").groupBy("unit").agg(F.sum("texts").alias("n")).where(F.col("n") >= MIN_TOXIC)
    candidates = rows.sparkSession.sparkContext.broadcast([r.unit for r in toxic_texts.orderBy(F.desc("n"), "unit").limit(MAX_CANDIDATES).collect()])
    counted = rows.select("text", "toxic", "fold").mapInArrow(_unit_counts(candidates), "unit string, texts array<long>").groupBy("unit").agg(*spread)
    totals = np.zeros(2 * FOLDS)
    for r in rows.groupBy("toxic", "fold").count().collect():  # 2 * FOLDS rows
        totals[r.toxic * FOLDS + r.fold] = r["count"]
    clean, toxic = (sum((F.col(f"n{k}") for k in range(at, at + FOLDS)), F.lit(0)) for at in (0, FOLDS))
    n_clean, n_toxic = totals[:FOLDS].sum(), totals[FOLDS:].sum()
    odds = F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1)) - F.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    kept = counted.where(toxic >= MIN_TOXIC).withColumn("gain", odds * F.sqrt(toxic)).where(odds > 0).orderBy(F.desc("gain"), "unit").limit(MAX_UNITS).drop("gain").collect()
    names = [r.unit for r in kept]
    counts = np.array([r[1:] for r in kept], np.float64).reshape(len(kept), 2 * FOLDS)
    found = []
    for fold in [*range(FOLDS), None]:
        use = np.array([k % FOLDS != fold for k in range(2 * FOLDS)])
        part, whole = counts * use, totals * use
        weights = _odds(part[:, FOLDS:].sum(axis=1), part[:, :FOLDS].sum(axis=1), whole[FOLDS:].sum(), whole[:FOLDS].sum())
        found.append({n: float(w) for n, w in zip(names, weights, strict=True) if w >= LEAST_WEIGHT})
    return found


def _stretched(words: pa.Array) -> np.ndarray:
    """1 for words with the same ASCII letter three times in a row."""
    flat, offsets = text_bytes(words)
    same = (flat[2:] == flat[1:-1]) & (flat[1:-1] == flat[:-2]) & (flat[2:] >= ord("a")) & (flat[2:] <= ord("z"))
    word = np.searchsorted(offsets, np.flatnonzero(same), side="right") - 1
    word = word[offsets[word + 1] > np.flatnonzero(same) + 2]
    return (np.bincount(word, minlength=len(words)) > 0).astype(np.float64)


def _features(texts: pa.Array, lexicon: dict[str, float]) -> np.ndarray:
    """FEATURES of every text."""
    vocabulary, codes, starts = word_codes(texts)
    n, v = len(texts), len(vocabulary)
    out = np.zeros((n, len(FEATURES)))
    if not v:
        return out
    core, mixed = bare_words(vocabulary)
    weight, unit = np.zeros(v), np.full(v, -1, np.int64)
    names, weights = pa.array(list(lexicon), pa.string()), np.array([*lexicon.values(), 0.0])
    for column in unit_columns(core):
        number = pc.index_in(column, names).fill_null(-1).to_numpy(zero_copy_only=False)
        own = np.where(number >= 0, weights[number], 0.0)
        unit, weight = np.where(own > weight, number, unit), np.maximum(own, weight)
    array = lambda x: x.to_numpy(zero_copy_only=False).astype(np.float64)
    insult, second = array(pc.is_in(core, pa.array(sorted(_INSULTS)))), array(pc.is_in(core, pa.array(sorted(SECOND_PERSON))))
    capital, size = array(pc.and_(pc.utf8_is_upper(vocabulary), pc.greater(pc.utf8_length(core), 1))), array(pc.utf8_length(vocabulary))
    marks, asks, stretched = array(pc.count_substring(vocabulary, "!")), array(pc.count_substring(vocabulary, "?")), _stretched(core)
    text = np.repeat(np.arange(n), np.diff(starts))
    n_words = np.maximum(np.diff(starts), 1).astype(np.float64)
    total = lambda values: np.bincount(text, weights=values, minlength=n)
    of = weight[codes]
    some, heavy = (of >= SOME).astype(float), ((of >= HEAVY) | (insult[codes] > 0)).astype(float)
    pairs = np.unique(text * v + codes)  # distinct words of a text
    pair_text, pair_weight = pairs // v, weight[pairs % v]
    order = np.lexsort((-pair_weight, pair_text))
    first = np.searchsorted(pair_text[order], np.arange(n + 1))
    for rank, name in enumerate(("strongest", "second", "third")):
        there = first[:-1] + rank < first[1:]
        out[there, FEATURES.index(name)] = pair_weight[order][first[:-1][there] + rank]
    known = unit[codes] >= 0
    if known.any():
        repeated, times = np.unique(text[known] * len(names) + unit[codes][known], return_counts=True)
        np.maximum.at(out[:, FEATURES.index("unit_repeats")], repeated // len(names), times)
    said = np.concatenate([[0], np.cumsum(second[codes])])
    place = np.arange(len(codes))
    around = said[np.minimum(place + NEAR + 1, starts[1:][text])] - said[np.maximum(place - NEAR, starts[:-1][text])]
    put = lambda name, values: out.__setitem__((slice(None), FEATURES.index(name)), values)
    put("log_words", np.log1p(np.diff(starts)))
    put("some_count", total(some))
    put("some_density", 100 * total(some) / n_words)
    put("heavy_count", total(heavy))
    put("heavy_density", 100 * total(heavy) / n_words)
    put("weight_density", total(of * some) / np.sqrt(n_words))
    put("insult_count", total(insult[codes]))
    put("insult_density", 100 * total(insult[codes]) / n_words)
    put("second_person_density", 100 * total(second[codes]) / n_words)
    put("insults_near_second_person", total(heavy * (around > 0)))
    put("capital_share", total(capital[codes]) / n_words)
    put("exclamations", 100 * total(marks[codes]) / n_words)
    put("questions", 100 * total(asks[codes]) / n_words)
    put("mixed_share", total(mixed[codes]) / n_words)
    put("mixed_insults", total(mixed[codes] * heavy))
    put("stretched_share", total(stretched[codes]) / n_words)
    put("word_length", total(size[codes]) / n_words)
    return out


def _lists(table: np.ndarray) -> pa.Array:
    n, width = table.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(table.ravel()))


def _training_features(lexicons):
    """(toxic, fold, features) with each fold's own lexicon."""

    @released
    def run(batches):
        for batch in slices(batches, 4 << 20):
            for fold in range(FOLDS):
                part = batch.filter(pc.equal(batch.column("fold"), fold))
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([part.column("toxic"), part.column("fold"), _lists(_features(part.column("text"), lexicons.value[fold]))], names=["toxic", "fold", "features"])

    return run


def _scoring_features(lexicons):
    """(whole, features) from (whole, text)."""

    @released
    def run(batches):
        for batch in slices(batches, 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("whole"), _lists(_features(batch.column("text"), lexicons.value[FOLDS]))], names=["whole", "features"])

    return run


class Members:
    """The fitted forests and their calibrations; share: what every score is when there are none."""

    def __init__(self, rows: DataFrame):
        """rows: toxic, fold, features (arrays) of at most MAX_TRAIN texts."""
        self.pairs, self.share = [], 0.0
        counts = {(r.half, r.toxic): r["count"] for r in rows.groupBy((F.col("fold") % 2).alias("half"), "toxic").count().collect()}
        total = sum(counts.values())
        if total:
            self.share = sum(n for (_, toxic), n in counts.items() if toxic) / total
        if len(counts) < 4:
            return
        few = rows.coalesce(-(-total // FIT_ROWS))  # many small jobs read them
        ready = few.select(F.col("toxic").cast("double").alias("toxic"), "fold", array_to_vector("features").alias("features"))
        forest = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=1)
        calibration = IsotonicRegression(labelCol="toxic", featuresCol="margin", predictionCol="calibrated")
        for half in (0, 1):
            model = forest.fit(ready.where(F.col("fold") % 2 == half))
            self.pairs.append((model, calibration.fit(_margins(model, ready.where(F.col("fold") % 2 != half)))))

    def score(self, df: DataFrame) -> DataFrame:
        """df (whole, features) with its score, in place of its features."""
        if not self.pairs:
            return df.select("whole", F.lit(self.share).alias("score"))
        df = df.withColumn("features", array_to_vector("features")).withColumn("summed", F.lit(0.0))
        for model, calibration in self.pairs:
            scored = calibration.transform(_margins(model, df))
            df = scored.withColumn("summed", F.col("summed") + F.col("calibrated")).select("whole", "features", "summed")
        return df.select("whole", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("summed") / len(self.pairs))).alias("score"))


def _margins(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "probability", "prediction")


def _scored(whole: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """whole (a struct with a text) and its score."""
    spark = docs.sparkSession
    ship(spark)
    rows = training_rows(docs, labels)
    lexicons = spark.sparkContext.broadcast(learn_lexicon(rows))  # MAX_UNITS units at most, FOLDS + 1 times
    trained = stored(rows.select("text", "toxic", "fold").mapInArrow(_training_features(lexicons), "toxic int, fold int, features array<double>"), "toxicity-features")
    members = Members(trained)
    features = whole.select("whole", F.col("whole.text").alias("text")).mapInArrow(_scoring_features(lexicons), f"whole {whole.schema['whole'].dataType.simpleString()}, features array<double>")
    return members.score(features)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = _scored(narrow.select(F.struct("doc_id", "text").alias("whole")), docs, labels)
    return scored.select("whole.doc_id", "score").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def with_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with a column toxicity, all others kept."""
    scored = _scored(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")), docs, labels)
    return scored.select(*(F.col(f"whole.`{c}`").alias(c) for c in docs.columns), F.col("score").alias("toxicity"))
