"""Reading of notes: sections, sentences, cues, segments, candidate phrases.

Each of these needs the order of characters within one note, so they run per note in one pass
over Arrow batches, without a shuffle unless the scan has fewer partitions than there are cores: a
note is read whole and gives rows. Offsets are code
points of the text with its line ends as plain line feeds.

Word lists and patterns are fixed values that results depend on.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize, normalize_text, tokens
from ..sources.storage import spread

# Patterns of each family of cues, English and Spanish, in order of preference.
CUES = {
    "negation": [
        "no evidence of", "no", "not", "without", "denies", "denied", "negative for", "absence of", "free of", "ruled out", "rule[ds]? out", "excluded", "exclude[ds]?",
        "sin evidencia de", "sin", "niega", "descartad[oa]s?", "excluid[oa]s?",
    ],
    "history": ["history of", "hx of", "past medical history", "antecedentes", "previous", "prior"],
    "family": ["family history", "family hx", "mother with", "father with", "madre con", "padre con", "antecedentes familiares"],
    "plan": ["plan", "continue", "repeat", r"follow[\s-]?up", "monitor", "start", "schedule", "continuar", "repetir", "seguimiento", "control"],
    "hypothetical": ["suspected", "possible", "probable", "rule out", "sospecha", "posible"],
    "due-to": ["due to", "secondary to", "debido a", "secundaria a"],
    "associated-with": ["associated with", "with", "con"],
    "caused-by": ["caused by", "resulting from"],
}
RELATIONS = ("due-to", "associated-with", "caused-by")
# What a cue says of its sentence: type, value, and the words of a section's title that say it too.
CUE_MEANING = {
    "family": ("family-history", "family-history", None),
    "history": ("history", "historical", ["history", "antecedentes"]),
    "plan": ("plan", "planned", ["plan", "seguimiento"]),
    "negation": ("negation", "absent", []),
    "hypothetical": ("certainty", "suspected", []),
}
# Of several cues the first of these decides; a history section alone doesn't count.
PRECEDENCE = [
    ("family-history", ("family-history", "family-history", "family")),
    ("negation", ("absent", "negated", "patient")),
    ("plan", ("planned", "plan", "patient")),
    ("certainty", ("suspected", "hypothetical", "patient")),
    ("history", ("historical", "history", "patient")),
]
PRESENT = ("present", "current", "patient")
# Words that end a segment, and words that are worth little in a phrase and end it too.
BREAKS = frozenset("the a an and or for de del la las el los of on to from at by into under en y o para por".split())
LOW_VALUE = frozenset(
    """patient patients assessment current review clinical note notes summary mother father today active prior previous continue repeat monitor schedule
    follow followup follow-up history family plan paciente pacientes madre padre hoy activo activa previo previa continuar repetir seguimiento control familia
    familiar familiares antecedentes resumen evaluacion revision nota notas clinico clinica actual""".split()
)
MAX_WINDOW, WINDOWS_KEPT, MAX_PHRASES = 4, 2, 80
# A task reads a short text once: what it says is kept for the last so many different ones, up to so many characters each.
TEXTS_KEPT, LONGEST_KEPT = 8192, 600
#: Rows that it keeps of them, and bytes of notes that it reads at a time.
ROWS_KEPT, SLICE_BYTES = 1 << 18, 1 << 20


def bounded(words: list[str]) -> str:
    """One pattern of any of them between characters other than ASCII letters, digits and _."""
    return f"(?<![A-Za-z0-9_])(?:{'|'.join(words)})(?![A-Za-z0-9_])"


@lru_cache(maxsize=None)
def cue_pattern(family: str) -> re.Pattern:
    return re.compile(bounded(CUES[family]), re.IGNORECASE)


_HEADER = re.compile(r"(?:^|[\n\r]+|(?<=[.!?])\s+)([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ /()_-]{0,40}):[ \t]*", re.MULTILINE)
_SENTENCE = re.compile(r"[^\n.!?]+[.!?]*")
_TOKEN = re.compile(r"[^\W_]+")


def plain_lines(text: str | None) -> str:
    return (text or "").replace("\r\n", "\n")


def sections_of(text: str) -> list[tuple[str, int, int, int]]:
    """Title, start, start of content, end. What stands before the first header is a Note."""
    heads = list(_HEADER.finditer(text))
    if not heads:
        return [("Note", 0, 0, len(text))]
    ends = [m.start() for m in heads[1:]] + [len(text)]
    found = [(m[1].strip(), m.start(), m.end(), end) for m, end in zip(heads, ends, strict=True)]
    return ([("Note", 0, 0, heads[0].start())] if heads[0].start() else []) + [x for x in found if x[3] > x[1]]


def slug_of(title: str) -> str:
    return normalize_text(title).replace(" ", "-")


def sentences_of(text: str, begin: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Trimmed sentences of a section's content with their places in the text."""
    content = text[begin:end]
    matches = list(_SENTENCE.finditer(content))
    spans = [(m[0], m.start()) for m in matches] if matches else [(content, 0)]
    for raw, at in spans:
        if sentence := raw.strip():
            start = begin + at + len(raw) - len(raw.lstrip())
            yield sentence, start, start + len(sentence)


def signals_of(title: str, sentence: str, start: int) -> list[tuple[str, str, str, str, int | None, int | None]]:
    """Type, value, source (section or sentence), text, start, end of what a sentence's context says."""
    out = []
    for family, (kind, value, titles) in CUE_MEANING.items():
        if m := cue_pattern(family).search(sentence):
            out.append((kind, value, "sentence", m[0].strip(), start + m.start(), start + m.end()))
        elif titles != [] and re.search(bounded(titles or CUES[family]), title, re.IGNORECASE):
            out.append((kind, value, "section", title.strip(), None, None))
    for value in RELATIONS:
        if m := cue_pattern(value).search(sentence):
            out.append(("relation", value, "sentence", m[0].strip(), start + m.start(), start + m.end()))
    return out


def context_of(signals) -> tuple[str, str, str]:
    """Assertion, context type and whom it is about."""
    kinds = {kind for kind, _, source, *_ in signals if kind != "history" or source != "section"}
    return next((meaning for kind, meaning in PRECEDENCE if kind in kinds), PRESENT)


CONTEXT_POINTS = {"current": 4, "history": 2, "negated": 2, "plan": -4, "family-history": -30}


def phrase_points(words: list[str], context: str, n_tokens: int | None = None) -> int:
    """What a phrase is worth as a candidate: by its number of tokens in the text, long and
    low-value words, digits and context."""
    n = len(words) if n_tokens is None else n_tokens
    low = sum(w in LOW_VALUE for w in words)
    by_length = 10 if n == 1 else 24 if 2 <= n <= 4 else max(16 - 3 * (n - 4), 0)
    points = by_length + 6 * sum(len(w) >= 5 for w in words) + 2 * any(re.fullmatch("[0-9]+", w) for w in words) - 10 * low + CONTEXT_POINTS.get(context, 0)
    return points - (8 if len(words) == 1 and len(words[0]) < 6 else 0) - (40 if words and low == len(words) else 0)


def phrase_score(phrase: Column, n_tokens: Column, context: Column) -> Column:
    """phrase_points() of a column of phrases."""
    words = tokens(normalize(phrase))
    n = F.size(words)
    count = lambda test: F.size(F.filter(words, test))
    low = count(lambda w: w.isin(*sorted(LOW_VALUE)))
    by_length = F.when(n_tokens == 1, 10).when(n_tokens.between(2, 4), 24).otherwise(F.greatest(16 - 3 * (n_tokens - 4), F.lit(0)))
    by_context = F.coalesce(F.create_map(*(F.lit(x) for pair in CONTEXT_POINTS.items() for x in pair))[context], F.lit(0))
    points = by_length + 6 * count(lambda w: F.length(w) >= 5) + F.when(F.exists(words, lambda w: w.rlike("^[0-9]+$")), 2).otherwise(0) - 10 * low + by_context
    return points - F.when((n == 1) & (F.length(words[0]) < 6), 8).otherwise(0) - F.when((n > 0) & (low == n), 40).otherwise(0)


def segments_of(sentence: str, start: int, signals) -> list[list[tuple[str, int, int]]]:
    """Runs of words between cues, stopwords and words of little value: word, start, end."""
    cues = [(a, b) for *_, a, b in signals if a is not None]
    out: list[list[tuple[str, int, int]]] = [[]]
    for m in _TOKEN.finditer(sentence):
        word, a, b = normalize_text(m[0]), start + m.start(), start + m.end()
        if not word:
            continue
        if word in BREAKS or word in LOW_VALUE or any(a < y and b > x for x, y in cues):
            out.append([])
        else:
            out[-1].append((word, a, b))
    return [x for x in out if x]


def windows_of(words: list[str], most: int = MAX_WINDOW, keep: int = WINDOWS_KEPT) -> list[tuple[int, int]]:
    """Start and length of a segment's candidate phrases: all of it if short, else its best
    windows, those at its end preferred, earlier and longer ones first."""
    n = len(words)
    if n <= most:
        return [(0, n)] if n else []
    scored = [(phrase_points(words[at : at + size], "current") + (3 if at + size == n else 0) - at, size, at) for size in range(most, 0, -1) for at in range(n - size + 1)]
    return [(at, size) for _, size, at in sorted(scored, key=lambda x: (-x[0], -x[1], x[2]))[:keep]]


PHRASES = "k int, phrase string, normalized string, start int, `end` int, n_tokens int, points int, section string, sentence string, sentence_start int, sentence_end int, assertion string, context_type string, experiencer string, relation_cue boolean"


def phrases_of(text: str, most: int = MAX_PHRASES) -> list[tuple]:
    """PHRASES of a note: its best candidate phrases, by points, then length, then place."""
    found: dict[tuple, tuple] = {}
    for title, _, begin, end in sections_of(text):
        for sentence, s, e in sentences_of(text, begin, end):
            signals = signals_of(title, sentence, s)
            context = context_of(signals)
            related = any(x[0] == "relation" for x in signals)
            for segment in segments_of(sentence, s, signals):
                words = [w for w, *_ in segment]
                for at, size in windows_of(words):
                    a, b = segment[at][1], segment[at + size - 1][2]
                    phrase = text[a:b]
                    normal = normalize_text(phrase)
                    if len(normal) >= (5 if size == 1 else 3):
                        found.setdefault((a, b, normal), (phrase, normal, a, b, size, phrase_points(normal.split(), context[1], size), title, sentence, s, e, *context, related))
    ranked = sorted(found.values(), key=lambda x: (-x[5], -x[4], x[2]))[:most]
    return [(k, *row) for k, row in enumerate(ranked)]


def per_note(notes: DataFrame, key: str, text: str, read: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """key and schema's columns: the rows that read gives for each note. Rows of a text read before are taken
    from those kept, as Arrow columns; only new texts become rows of Python."""
    kind = dict(notes.dtypes)[key]
    types = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    fields = pa.schema([(name.strip("`"), types[of]) for name, of in (c.split() for c in schema.split(", "))])

    def columns(rows: list[tuple]) -> pa.RecordBatch:
        whole = zip(*rows, strict=True) if rows else [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(whole, fields, strict=True)], schema=fields)

    def run(batches):
        held, places = columns([]), {}  # rows of the texts read so far, and where each text's begin and how many they are
        for batch in _slices(batches):
            texts = [plain_lines(x) for x in batch.column(text).to_pylist()]
            if len(places) > TEXTS_KEPT or held.num_rows > ROWS_KEPT:
                held, places = columns([]), {}
            fresh, own, at = [], [], held.num_rows
            for value in texts:
                place = places.get(value)
                if place is None:
                    rows = read(value)
                    place = at, len(rows)
                    at += len(rows)
                    fresh += rows
                    if len(value) <= LONGEST_KEPT:
                        places[value] = place
                own.append(place)
            if fresh:
                held = pa.concat_batches([held, columns(fresh)])
            first, sizes = np.array(own, np.int64).reshape(-1, 2).T
            within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            made = held.take(pa.array(np.repeat(first, sizes) + within))
            keys = batch.column(key).take(pa.array(np.repeat(np.arange(len(own)), sizes)))
            yield pa.RecordBatch.from_arrays([keys, *made.columns], names=[key, *fields.names])

    return spread(notes.select(key, text)).mapInArrow(run, f"{key} {kind}, {schema}")


def _slices(batches):
    """Batches in pieces of at most SLICE_BYTES, or one row: each text gives many rows that repeat its sentences."""
    for batch in batches:
        step = max(1, min(batch.num_rows, int(SLICE_BYTES * batch.num_rows / max(batch.nbytes, 1))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def sections(notes: DataFrame, key: str, text: str) -> DataFrame:
    """key, k, section, slug, start, content, end."""
    read = lambda t: [(k, x[0], slug_of(x[0]), *x[1:]) for k, x in enumerate(sections_of(t))]
    return per_note(notes, key, text, read, "k int, section string, slug string, start int, content int, `end` int")


def sentences(notes: DataFrame, key: str, text: str) -> DataFrame:
    """key, section, sentence, start, end."""
    read = lambda t: [(x[0], *s) for x in sections_of(t) for s in sentences_of(t, x[2], x[3])]
    return per_note(notes, key, text, read, "section string, sentence string, start int, `end` int")


def signals(notes: DataFrame, key: str, text: str) -> DataFrame:
    """key, sentence_start, cue_type, value, source, text, start, end of every sentence's cues."""
    read = lambda t: [(s, *x) for title, _, begin, end in sections_of(t) for sentence, s, _ in sentences_of(t, begin, end) for x in signals_of(title, sentence, s)]
    return per_note(notes, key, text, read, "sentence_start int, cue_type string, value string, source string, cue string, start int, `end` int")


def phrases(notes: DataFrame, key: str, text: str, most: int = MAX_PHRASES) -> DataFrame:
    """key and PHRASES of every note, at most so many of each."""
    return per_note(notes, key, text, lambda t: phrases_of(t, most), PHRASES)


def mention_context(assertion, subject, temporality):
    """The context of an extractor's mention; absence comes before relatives here."""
    triple = lambda a, c, e: F.struct(F.lit(a).alias("assertion"), F.lit(c).alias("context_type"), F.lit(e).alias("experiencer"))
    return (
        F.when(assertion == "absent", triple("absent", "negated", "patient")).when(subject == "family", triple("family-history", "family-history", "family")).when(assertion == "planned", triple("planned", "plan", "patient"))
        .when(assertion == "suspected", triple("suspected", "hypothetical", "patient")).when(temporality == "historical", triple("historical", "history", "patient")).otherwise(triple(*PRESENT))
    )


# What an extractor may say, and what other words become.
MENTION_VALUES = {
    "assertion": (("present", "absent", "suspected", "planned"), "suspected"),
    "subject": (("patient", "family"), "patient"),
    "temporality": (("current", "historical", "unknown"), "unknown"),
    "kind": (("condition", "symptom", "observation", "medication", "procedure", "test", "referral", "context"), None),
    "workflow": (("current", "planned", "conditional", "completed", "continuation", "discussion", "unknown"), "unknown"),
    "clinical_status": (("active", "resolved", "unknown"), "unknown"),
}


def normalized_mentions(raw: DataFrame) -> DataFrame:
    """An extractor's mentions with every enumerated field in its range; those without a phrase go."""
    allowed = {c: F.when(F.col(c).isin(*values), F.col(c)).otherwise(F.lit(other)) for c, (values, other) in MENTION_VALUES.items() if c in raw.columns}
    phrase = F.trim("phrase")
    stated = {"phrase": phrase} | ({"verbatim": F.trim(F.coalesce(F.when(F.col("verbatim") != "", F.col("verbatim")), "phrase"))} if "verbatim" in raw.columns else {})
    return raw.withColumns(allowed | stated).where(F.coalesce(F.col("phrase"), F.lit("")) != "")
