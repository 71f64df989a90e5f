"""Periodic runs of words: heavy/light lag counting, then island scans of the lags that can hold one.

A run is a stretch of words with smallest period q, at least max(6, 4q) words long, that no
neighbour extends. It matches itself q words later in at least max(6 - q, 3q) consecutive
places, so a lag with fewer matches in the whole text holds none. The matches of all lags up
to a quarter of the text are counted first:

- words that stand in few places (light) give their pairwise differences, for all texts of a
  batch at once;
- each frequent word (heavy) of a text gives its autocorrelation: the spectra of the heavy
  words' indicators add up, and one inverse transform, rounded, is the exact count.

Lags are taken in ascending order. Matches inside runs already found whose period divides
the lag are set off, as two runs cannot share them; a lag that is left with too few is
skipped. Of the others, blocks of q words that equal the next block are found by prefix sums
of a polynomial hash, and only around them are words compared, so a lag costs about n / q
steps and not n, and a text of one repeated word costs no more than any other.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; a text
of under six words has no runs; a very long text is taken whole; runs of equal exponent go
by start, then period; repeated rows each get their own row; an empty table gives an empty
result; extra columns are ignored by digest and kept by collapse; a null doc_id is kept, and
digest leaves its text as it is.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ranges, released, ship, slices, word_codes

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4
#: Words in more places than this, and than the root of twice the text's words, are heavy.
LIGHT_PLACES = 64

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def least_matches(lags: np.ndarray) -> np.ndarray:
    """How many consecutive matches a run of each period has at least."""
    return np.maximum(LEAST - lags, (TIMES - 1) * lags)


def _light_matches(codes: np.ndarray, starts: np.ndarray, most: np.ndarray, heavy_from: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Matches by lag, text after text (most + 1 places each), the first place of each text, and (text, places) of the heavy words."""
    sizes = np.diff(starts)
    text = np.repeat(np.arange(len(sizes)), sizes)
    key = text * (np.int64(codes.max()) + 1) + codes if len(codes) else codes.astype(np.int64)
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(ranked)))
    owner = text[order[first]]
    base = np.concatenate([[0], np.cumsum(most + 1)])
    found = np.zeros(base[-1], np.int64)
    is_heavy = counts > heavy_from[owner]
    heavy = [(int(owner[k]), order[first[k] : first[k] + counts[k]] - starts[owner[k]]) for k in np.flatnonzero(is_heavy)]
    light = (counts > 1) & ~is_heavy
    at = ranges(first[light], counts[light])
    left = np.repeat(first[light] + counts[light], counts[light])  # where the word's places end
    limit, shift = np.repeat(most[owner[light]], counts[light]), np.repeat(base[owner[light]], counts[light])
    step = 0
    while len(at):
        step += 1
        going = at + step < left
        at, left, limit, shift = at[going], left[going], limit[going], shift[going]
        apart = order[at + step] - order[at]
        near = apart <= limit
        at, left, limit, shift = at[near], left[near], limit[near], shift[near]
        if len(at) * 8 > len(found):
            found += np.bincount(shift + apart[near], minlength=len(found))
        else:
            np.add.at(found, shift + apart[near], 1)
    return found, base, heavy


def _heavy_matches(places: list[np.ndarray], n: int, most: int) -> np.ndarray:
    """Exact autocorrelation, lags 0 to most, summed over words given by their places in a text of n words."""
    size = 1 << (n + most).bit_length()
    power = np.zeros(size // 2 + 1)
    for where in places:
        mark = np.zeros(size)
        mark[where] = 1
        spectrum = np.fft.rfft(mark)
        power += spectrum.real**2 + spectrum.imag**2
    return np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)


def lag_matches(codes: np.ndarray, starts: np.ndarray, light_places: int = LIGHT_PLACES) -> tuple[np.ndarray, np.ndarray]:
    """Matches by lag, up to a quarter of each text, text after text; and where each text's begin."""
    sizes = np.diff(starts)
    most = sizes // TIMES
    heavy_from = np.maximum(light_places, np.sqrt(2.0 * sizes).astype(np.int64))
    found, base, heavy = _light_matches(codes, starts, most, heavy_from)
    by_text: dict[int, list[np.ndarray]] = {}
    for text, places in heavy:
        by_text.setdefault(text, []).append(places)
    for text, places in by_text.items():
        found[base[text] : base[text + 1]] += _heavy_matches(places, int(sizes[text]), int(most[text]))
    return found, base


_HASH_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    steps = np.full(n + 1, _HASH_BASE)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def _islands(codes: np.ndarray, prefix: np.ndarray, powers: np.ndarray, q: int, within: list) -> list[tuple[int, int]]:
    """(start, matches) of all islands of matches at lag q that can be a run's, outside the runs within."""
    n = len(codes)
    blocks = np.diff(prefix[: (n // q) * q + 1 : q])
    with np.errstate(over="ignore"):
        same = blocks[:-1] * powers[q] == blocks[1:]
    for _, a, b in within:
        same[-(-a // q) : max(0, b // q - 1)] = False
    at = np.flatnonzero(same)
    if not len(at):
        return []
    a, b = np.maximum(at - 1, 0) * q, np.minimum((at + 2) * q, n - q)  # an island goes on for less than a block
    new = np.concatenate([[True], a[1:] > b[:-1]])
    a, b = a[new], np.append(b[np.flatnonzero(new)[1:] - 1], b[-1])
    places = ranges(a, b - a)
    places = places[codes[places] == codes[places + q]]
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) != 1) + 1
    first, last = places[np.concatenate([[0], cut])], places[np.append(cut - 1, len(places) - 1)]
    return [(int(s), int(e - s + 1)) for s, e in zip(first, last, strict=True) if e - s + 1 >= max(LEAST - q, (TIMES - 1) * q)]


def runs_of(codes: np.ndarray, matches: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period. matches: by lag, from 0."""
    n = len(codes)
    if n < LEAST:
        return []
    lags = np.arange(1, len(matches))
    lags = lags[matches[1:] >= least_matches(lags)]
    if not len(lags):
        return []
    powers = _powers(n)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[:n], dtype=np.uint64)])
    found, alive = [], []  # alive: (period, start, end) of runs that can hold a block pair of the lag
    for q in lags.tolist():
        alive = [r for r in alive if r[2] - r[1] >= 2 * q]
        within = [r for r in alive if q % r[0] == 0]
        if matches[q] - sum(b - a - q for _, a, b in within) < max(LEAST - q, (TIMES - 1) * q):
            continue
        for start, n_matches in _islands(codes, prefix, powers, q, within):
            end = start + n_matches + q
            if not any(a <= start and end <= b for _, a, b in within):
                found.append((start, end - start, q))
                alive.append((q, start, end))
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; ties go to the smallest start, then period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for words that a run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which original word stands at each place of a text that repeats part of itself; None: as it was."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def _analysed(texts: pa.Array, ids: list[int | None] | None = None):
    """For each text its runs and its collapsed text; with ids, of the texts that planted makes of them."""
    distinct, codes, starts = word_codes(texts)
    vocabulary = distinct.to_pylist()
    if ids is not None:
        for k, doc_id in enumerate(ids):
            at = planted(int(starts[k + 1] - starts[k]), doc_id)
            if at is not None:
                codes[starts[k] : starts[k + 1]] = codes[starts[k] : starts[k + 1]][at]
    matches, base = lag_matches(codes, starts)
    for k in range(len(texts)):
        own = codes[starts[k] : starts[k + 1]]
        runs = runs_of(own, matches[base[k] : base[k + 1]])
        kept = own[kept_words(len(own), runs)] if runs else own
        yield runs, " ".join([vocabulary[c] for c in kept.tolist()])


@released
def _digests(batches):
    for batch in slices(batches, 4 << 20):
        ids = batch.column("doc_id").to_pylist()
        rows = []
        for runs, text in _analysed(batch.column("text"), ids):
            best = strongest(runs)
            start, length, period = best or (None, None, None)
            listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
            rows.append((len(runs), start, length, period, best and 1000 * length // period, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=[x.split()[0] for x in DIGEST.split(", ")])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, for texts that repeat part of themselves as planted says."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_digests, DIGEST)


@released
def _collapsed(batches):
    for batch in slices(batches, 4 << 20):
        whole = batch.column("whole")
        texts = pc.struct_field(whole, "text")
        made = list(_analysed(texts))
        runs = pa.array([[{"start": a, "length": n, "period": q} for a, n, q in x[0]] for x in made], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
        new = [old if not x[0] else x[1] for x, old in zip(made, texts.to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([whole, runs, pa.array(new, pa.string())], names=["whole", "runs", "collapsed"])


def collapse(docs: DataFrame) -> DataFrame:
    """docs with every run cut down to its first period (words then joined by one space), and its runs in a
    column periodic_runs; texts without runs stay as they are."""
    ship(docs.sparkSession)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    cut = whole.mapInArrow(_collapsed, f"whole {whole.schema['whole'].dataType.simpleString()}, runs {RUNS}, collapsed string")
    return cut.select(*(F.col("collapsed").alias(c) if c == "text" else F.col(f"whole.`{c}`").alias(c) for c in docs.columns), F.col("runs").alias("periodic_runs"))
