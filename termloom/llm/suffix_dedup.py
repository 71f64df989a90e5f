"""Exact substring dedup by suffix arrays, over all documents.

A byte goes if a WINDOW-byte string that covers it also starts earlier. Byte offsets refer
to UTF-8; matches never cross documents.

1. Every window has an anchor: of the SEED-byte strings in it, the one with the least hash,
   the leftmost of equals. Equal windows have equal anchors at equal places, so windows are
   dealt out by their anchors' hashes. Neighbouring windows mostly share an anchor: there
   are about 2 / (WINDOW - SEED + 2) anchors a byte. Equal texts count once.
2. Anchors that occur once can't have a repeated window. The others go back to their
   texts, which send each anchor's context, the bytes of all its windows. Contexts of an
   anchor with very many places are cut by the anchor's place in the window, eight or so cuts
   each, and dealt out by the bytes that all windows of a cut share as well: a seed that
   stands in many different surroundings spreads over all partitions.
3. A partition of the hash range holds all contexts that can share windows with one another.
   Equal contexts are settled at once: all but the first are repeated. Of the rest, those
   whose anchor has several contexts are cut at content-defined bounds, and a suffix
   array of the resulting symbols is built by linear grouping. Its intervals at depth q name
   equal runs of q symbols, so a window's class is the interval of the whole symbols in it
   and the bytes left over at both ends. The first window of each class stays.
4. Runs of repeated windows return to their texts, are merged and cut out.

Hashes only propose: of contexts and windows taken for equal the bytes are compared, and a
partition's piece in which any differ is done again on the bytes alone. Whole texts are equal
if their 128-bit digests are.

What a task holds is one partition of hash ranges. A hot passage doesn't gather there: tasks
settle the anchors and the contexts that they hold several times themselves and send one for
all, so an anchor's partition gets one context for each different surrounding and task.

Defined cases: null and empty texts have no bytes; texts under WINDOW bytes lose nothing; a
very long text is hashed in pieces and cut as a whole; rows that repeat a doc_id are separate
documents, ordered by a hash of their text, and equal rows count as one; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import part_of
from .shared import mix64, pack_planes, pack_sorted, partitions, ranges, released, ship, slices, stored, text_bytes, unpack_planes, unpack_sorted
from .suffix_array import common_prefixes, suffix_array

WINDOW, SEED = 100, 32
#: Windows hashed at a time, and the bytes before a symbol's bound that decide on it: one in BOUND_EVERY.
CHUNK, BOUND_BYTES, BOUND_EVERY, PIECE = 1 << 19, 4, 16, 1 << 20

#: An anchor is hot with so many places, and so large a share of its partition's: at most 1 / HOT_SHARE a
#: partition. Its contexts are cut into windows with the anchor at so many neighbouring places.
HOT_PLACES, HOT_SHARE, CUT = 4096, 0.01, 9
#: Digests that a task remembers at most; a text met again after that is only sent again.
MAX_SEEN = 1 << 18

_BYTES = mix64(np.arange(1, 257).astype(np.uint64))
_BASE = 0x9E3779B97F4A7C15 | 1
_PLACE = (1 << 25) - 1


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(_BASE)
    return np.cumprod(out, dtype=np.uint64)


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each SEED-byte string of data, by doubling."""
    h, size = _BYTES[data], 1
    while size < SEED:
        h = h[: len(h) - size] * np.uint64(_BASE) + h[size:]
        h ^= h >> np.uint64(29)
        size *= 2
    return mix64(h)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each width neighbours, from running minima over blocks in both directions."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _chunks(offsets: np.ndarray):
    """Byte ranges to hash at a time: whole texts, or pieces of a long text counted from its
    own start, so that a text's anchors don't depend on its neighbours."""
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > CHUNK:
            for begin in range(offsets[i], offsets[i + 1] - WINDOW + 1, CHUNK):
                yield begin, min(begin + CHUNK + WINDOW - 1, offsets[i + 1])
            i += 1
            continue
        k = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        yield offsets[i], offsets[k]
        i = k


def anchors(data: np.ndarray, offsets: np.ndarray):
    """For texts one after the other: hash, text number, place, first window, windows of each anchor."""
    found = []
    for begin, end in _chunks(offsets):
        if end - begin < WINDOW:
            continue
        hashes = seed_hashes(data[begin:end])
        keyed = (hashes & ~np.uint64(_PLACE)) | np.arange(len(hashes), dtype=np.uint64)
        place = (sliding_least(keyed, WINDOW - SEED + 1) & np.uint64(_PLACE)).astype(np.int64)
        starts = np.arange(begin, end - WINDOW + 1)
        text = np.searchsorted(offsets, starts, side="right") - 1
        valid = starts + WINDOW <= offsets[text + 1]
        place, text, starts = place[valid], text[valid], starts[valid]
        if not len(place):
            continue
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
        lengths = np.diff(np.concatenate([new, [len(place)]]))
        p, t = place[new], text[new]
        # anchors are least hashes: mixed again, they spread over the whole range
        found.append((mix64(hashes[p] ^ np.uint64(_BASE)), t, begin + p - offsets[t], starts[new] - offsets[t], lengths))
    if not found:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# ---- blobs between stages

BLOBS = "part int, kind int, a binary, b binary, c binary, d binary"
ANCHORS, BACK, TEXTS, FIRSTS, CONTEXTS, RUNS, HOT = range(7)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "kind", "a", "b", "c", "d"])


def _zip(*arrays: np.ndarray) -> bytes:
    """int64 columns, compressed together."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(pack_planes(x.astype(np.int64).view(np.uint64), 8) for x in arrays))


def _unzip(blob: bytes, n: int) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    size = len(raw) // n
    return [unpack_planes(raw[k * size : (k + 1) * size], 8).view(np.int64) for k in range(n)]


def _press(data: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data.tobytes())


def _press_out(blob: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)


def _by_part(part: np.ndarray, parts: int):
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    return [(p, order[cuts[p] : cuts[p + 1]]) for p in range(parts) if cuts[p + 1] > cuts[p]]


def _hash_pair(raw: bytes) -> tuple[int, int]:
    digest = hashlib.md5(raw, usedforsecurity=False).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


IDS = "doc_id long, n_bytes long, h1 long, h2 long, sha256 string"


@released
def _ids(batches):
    for batch in slices(batches):
        raw = [(x or "").encode() for x in batch.column("text").to_pylist()]
        pairs = [_hash_pair(x) for x in raw]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw])], names=["doc_id", "n_bytes", "h1", "h2", "sha256"])


def _distinct(batches, limit: int):
    """Of each task's texts of WINDOW bytes or more, each once: data, offsets, h1, h2."""
    seen: set[tuple[int, int]] = set()
    for batch in slices(batches, limit):
        data, offsets = text_bytes(batch.column(0))
        view, keep, pairs = data.tobytes(), [], []
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if b - a >= WINDOW and (pair := _hash_pair(view[a:b])) not in seen:
                if len(seen) >= MAX_SEEN:
                    seen.clear()
                seen.add(pair)
                keep.append(i)
                pairs.append(pair)
        if keep:
            k = np.array(keep)
            sizes = np.diff(offsets)[k]
            own = np.array(pairs, np.int64)
            yield data[ranges(offsets[k], sizes)], np.concatenate([[0], np.cumsum(sizes)]), own[:, 0], own[:, 1]


def _anchor_blobs(parts: int):
    """Anchors that a batch holds twice are known to be repeated: they go straight back to
    their texts, and one marker for each, without windows and with the number of its places, to
    its partition of the hash range."""

    @released
    def run(batches):
        for data, offsets, h1, _ in _distinct(batches, 8 << 20):
            hashes, text, place, first, count = anchors(data, offsets)
            if not len(hashes):
                continue
            order = np.argsort(hashes, kind="stable")
            hashes, text, place, count = hashes[order], text[order], place[order], count[order]
            back = place - first[order]
            same = hashes[1:] == hashes[:-1]
            many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            rows = _back_blobs(hashes[many], h1[text[many]], place[many], back[many], count[many], parts)
            marker = many & np.concatenate([[True], ~same])
            heads = np.flatnonzero(np.concatenate([[True], ~same]))
            places = np.diff(np.concatenate([heads, [len(hashes)]]))
            text, back, count = (np.where(marker, 0, x) for x in (text, back, count))
            place[heads] = np.where(marker[heads], places, place[heads])
            k = ~many | marker
            hashes, text, place, back, count = (x[k] for x in (hashes, text, place, back, count))
            cuts = np.searchsorted(part_of(hashes, parts), np.arange(parts + 1))
            for p in range(parts):
                k = slice(cuts[p], cuts[p + 1])
                if cuts[p + 1] > cuts[p]:
                    table, local = np.unique(text[k], return_inverse=True)
                    more = [(local, 3), (place[k], 4), (back[k], 1), (count[k], 1)]
                    rows.append((p, ANCHORS, pack_sorted(hashes[k]), h1[table].tobytes(), b"".join(pack_planes(x, w) for x, w in more), b""))
            yield _batch(rows)

    return run


def _back_blobs(hashes, text, place, back, count, parts: int) -> list[tuple]:
    return [(p, BACK, hashes[k].tobytes(), _zip(text[k], place[k], back[k], count[k]), b"", b"") for p, k in _by_part(part_of(text, parts), parts)]


def _text_blobs(parts: int):
    @released
    def run(batches):
        for data, offsets, h1, h2 in _distinct(batches, 16 << 20):
            sizes = np.diff(offsets)
            yield _batch([(p, TEXTS, _press(data[ranges(offsets[k], sizes[k])]), _zip(h1[k], h2[k], sizes[k]), b"", b"") for p, k in _by_part(part_of(h1, parts), parts)])

    return run


def _first_blobs(parts: int):
    def run(batches):
        for batch in batches:
            h1, h2, doc = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if len(h1):
                yield _batch([(p, FIRSTS, _zip(h1[k], h2[k], doc[k]), b"", b"", b"") for p, k in _by_part(part_of(h1, parts), parts)])

    return run


def _rows_of(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _repeated(parts: int):
    """A partition of the hash range: anchors at two or more places go back to their texts."""

    @released
    def run(batches):
        columns: list[list[np.ndarray]] = [[] for _ in range(5)]
        for row in _rows_of(batches):
            _, kind, a, b, c, _ = row
            if kind == BACK:
                yield _batch([row])
                continue
            hashes = unpack_sorted(a)
            n = len(hashes)
            bounds = np.cumsum([0, 3 * n, 4 * n, n, n])
            local, place, back, count = (unpack_planes(c[bounds[k] : bounds[k + 1]], w).astype(np.int64) for k, w in enumerate((3, 4, 1, 1)))
            for held, x in zip(columns, (hashes, np.frombuffer(b, np.int64)[local], place, back, count), strict=True):
                held.append(x)
        if not columns[0]:
            return
        hashes, text, place, back, count = (np.concatenate(x) for x in columns)
        columns.clear()
        text = np.where(count == 0, 0, text)
        order = np.argsort(hashes)
        heads = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
        places = np.add.reduceat(np.where(count[order] == 0, place[order], 1), heads)
        if (often := places >= max(HOT_PLACES, HOT_SHARE * places.sum())).any():
            yield _batch([(0, HOT, hashes[order][heads[often]].tobytes(), b"", b"", b"")])
        place = np.where(count == 0, 0, place)
        same = hashes[order][1:] == hashes[order][:-1]
        k = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        hashes, text, place, back, count = (x[k] for x in (hashes, text, place, back, count))
        order = np.lexsort((count, back, place, text, hashes))
        hashes, text, place, back, count = (x[order] for x in (hashes, text, place, back, count))
        fresh = np.ones(len(hashes), bool)  # another task's copy of a text sends the same again
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1]) | (place[1:] != place[:-1]) | (back[1:] != back[:-1]) | (count[1:] != count[:-1])
        hashes, text, place, back, count = (x[fresh] for x in (hashes, text, place, back, count))
        if not len(hashes):
            return
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(hashes)]]))
        many = (np.repeat(sizes, sizes) > 1) & (count > 0)
        rows = _back_blobs(*(x[many] for x in (hashes, text, place, back, count)), parts)
        for k in range(0, len(rows), 64):
            yield _batch(rows[k : k + 64])

    return run


def _texts_of(rows: list[tuple]):
    """Distinct texts of a partition: data, offsets, h1, h2."""
    data, names = [], []
    for _, _, a, b, _, _ in rows:
        data.append(_press_out(a))
        names.append(_unzip(b, 3))
    flat = np.concatenate(data)
    h1, h2, sizes = (np.concatenate(x) for x in zip(*names, strict=True))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    order = np.lexsort((h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    k = order[new]
    return flat, offsets[k], sizes[k], h1[k], h2[k]


def _cut_up(hashes, back, count, lo, base, flat, hot: np.ndarray):
    """Contexts, those of hot anchors cut: hash, back, count, lo, and the number of the context. A
    cut's windows have the anchor at CUT neighbouring places, so all of them share the bytes that
    its hash is made of; base is where each context's text begins."""
    at = np.arange(len(hashes))
    is_hot = np.isin(hashes, hot)
    if not is_hot.any():
        return hashes, back, count, lo, at
    h = at[is_hot]
    first, last = (back[h] - count[h] + 1) // CUT, back[h] // CUT
    k, r = np.repeat(h, last - first + 1), ranges(first, last - first + 1)
    begin = np.maximum(0, back[k] - (CUT * r + CUT - 1))
    end = np.minimum(count[k], back[k] - CUT * r + 1)
    core = np.full(len(k), WINDOW - CUT + 1, np.int64)
    shared = np.concatenate([_whole_hashes(flat, (base[k] + lo[k] + back[k] - CUT * r)[x : x + 100_000], core[x : x + 100_000]) for x in range(0, len(k), 100_000)])
    name = mix64(shared ^ mix64(hashes[k] + r.astype(np.uint64) + np.uint64(1)))
    cold = at[~is_hot]
    return (np.concatenate([hashes[cold], name]), np.concatenate([back[cold], back[k] - begin]), np.concatenate([count[cold], end - begin]), np.concatenate([lo[cold], lo[k] + begin]), np.concatenate([cold, k]))


def _contexts(parts: int, hot: np.ndarray):
    """A partition of the texts: each repeated anchor's context to the anchor's partition.

    Of equal contexts only the earliest is sent; the others' windows are repeated for sure.
    """

    @released
    def run(batches):
        by_kind: dict[int, list[tuple]] = {}
        for row in _rows_of(batches):
            by_kind.setdefault(row[1], []).append(row)
        if not by_kind.get(TEXTS) or not by_kind.get(BACK):
            return
        flat, starts, sizes, h1, h2 = _texts_of(by_kind[TEXTS])
        f1, f2, first = (np.concatenate(x) for x in zip(*(_unzip(r[2], 3) for r in by_kind[FIRSTS]), strict=True))
        doc_of = dict(zip(zip(f1.tolist(), f2.tolist(), strict=True), first.tolist(), strict=True))
        doc = np.array([doc_of[x] for x in zip(h1.tolist(), h2.tolist(), strict=True)], np.int64)
        hashes = np.concatenate([np.frombuffer(r[2], np.uint64) for r in by_kind[BACK]])
        text, place, back, count = (np.concatenate(x) for x in zip(*(_unzip(r[3], 4) for r in by_kind[BACK]), strict=True))
        order = np.lexsort((count, back, place, text))  # tasks with a copy of a text send the same
        hashes, text, place, back, count = (x[order] for x in (hashes, text, place, back, count))
        fresh = np.ones(len(text), bool)
        fresh[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1]) | (back[1:] != back[:-1]) | (count[1:] != count[:-1])
        hashes, text, place, back, count = (x[fresh] for x in (hashes, text, place, back, count))
        # texts whose first hash halves agree are all candidates: the contexts tell them apart
        low, high = np.searchsorted(h1, text, side="left"), np.searchsorted(h1, text, side="right")
        at = ranges(low, high - low)
        again = np.repeat(np.arange(len(text)), high - low)
        hashes, place, back, count = (x[again] for x in (hashes, place, back, count))
        lo, length = place - back, count + WINDOW - 1
        fits = (lo >= 0) & (lo + length <= sizes[at])
        hashes, back, count, lo, length, at = (x[fits] for x in (hashes, back, count, lo, length, at))
        if not len(hashes):
            return
        hashes, back, count, lo, own = _cut_up(hashes, back, count, lo, starts[at], flat, hot)
        at, length = at[own], count + WINDOW - 1
        whole = np.concatenate([_whole_hashes(flat, starts[at[k : k + 100_000]] + lo[k : k + 100_000], length[k : k + 100_000]) for k in range(0, len(at), 100_000)])
        copies = _later_copies(hashes, back, length, whole, doc[at], h1[at], lo, flat, starts[at] + lo)
        rows = _run_blobs(h1[at[copies]], h2[at[copies]], lo[copies], lo[copies] + count[copies] - 1, parts)
        sent = np.flatnonzero(~copies)
        for p, k in _by_part(part_of(hashes[sent], parts), parts):
            k = sent[k]
            rows.append((p, CONTEXTS, hashes[k].tobytes(), _press(flat[ranges(starts[at[k]] + lo[k], length[k])]), _zip(doc[at[k]], h1[at[k]], h2[at[k]], lo[k], back[k], count[k]), b""))
            if len(rows) >= 32:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    return run


def _run_blobs(h1, h2, a, b, parts: int) -> list[tuple]:
    return [(p, RUNS, _zip(h1[k], h2[k], a[k], b[k]), b"", b"", b"") for p, k in _by_part(part_of(h1, parts), parts)]


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the bytes of each size from a on equal those from b on; sizes are positive."""
    out, ends, x = np.zeros(len(a), bool), np.cumsum(sizes), 0
    while x < len(a):
        y = max(x + 1, int(np.searchsorted(ends, (ends[x - 1] if x else 0) + (4 << 20), side="right")))
        equal = data[ranges(a[x:y], sizes[x:y])] == data[ranges(b[x:y], sizes[x:y])]
        out[x:y] = np.logical_and.reduceat(equal, ends[x:y] - sizes[x:y] - (ends[x - 1] if x else 0))
        x = y
    return out


def _later_copies(hashes, back, length, whole, doc, h1, lo, data, begins) -> np.ndarray:
    """True for all but the first of equal contexts of equal anchors, in order of document and place.
    A context whose bytes differ from the one before it with an equal hash counts as another."""
    key = mix64(whole ^ mix64(hashes + back.astype(np.uint64)) + length.astype(np.uint64))
    order = np.lexsort((lo, h1, doc, key))
    same = np.flatnonzero((key[order][1:] == key[order][:-1]) & (length[order][1:] == length[order][:-1]))
    later = np.zeros(len(key), bool)
    if len(same):
        a, b = order[same + 1], order[same]
        later[a] = _same_bytes(data, begins[a], begins[b], length[a])
    return later


def _verified(data: np.ndarray, start: np.ndarray, context: np.ndarray, later: np.ndarray, before: np.ndarray) -> bool:
    """Whether each later window has the bytes of the one before it in its class. Of neighbouring
    windows that have neighbouring ones before them only the first is compared whole."""
    pair = np.full(len(start), -1, np.int64)
    pair[later] = before
    w = np.sort(later)
    follows = np.zeros(len(w), bool)
    follows[1:] = (w[1:] == w[:-1] + 1) & (context[w[1:]] == context[w[:-1]]) & (pair[w[1:]] == pair[w[:-1]] + 1) & (context[pair[w[1:]]] == context[pair[w[:-1]]])
    p = pair[w]
    ends_equal = data[start[w] + WINDOW - 1] == data[start[p] + WINDOW - 1]
    heads = w[~follows]
    return bool(ends_equal.all() and _same_bytes(data, start[heads], start[pair[heads]], np.full(len(heads), WINDOW)).all())


def _earlier_by_bytes(data: np.ndarray, start: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Windows that an equal one precedes in rank, from their bytes alone."""
    raw, seen, out = data.tobytes(), set(), np.zeros(len(start), bool)
    for k in rank.tolist():
        window = raw[start[k] : start[k] + WINDOW]
        out[k] = window in seen
        seen.add(window)
    return out


def repeated_windows(data: np.ndarray, sizes: np.ndarray, doc: np.ndarray, h1: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of contexts one after the other: each window's context, its offset there, and whether an
    equal window of these contexts starts earlier."""
    n = len(data)
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    hashed, power = _polynomial(data, begins, sizes), _powers(4 * WINDOW)

    def piece(a: np.ndarray, b: np.ndarray, context: np.ndarray) -> np.ndarray:
        return hashed[b + context] - hashed[a + context] * power[b - a]

    # bounds: decided by the BOUND_BYTES bytes before them, all in the same context
    places = np.arange(n)
    mixed = np.zeros(n, np.uint64)
    for k in range(BOUND_BYTES):
        mixed[BOUND_BYTES:] += _BYTES[data[k : n - BOUND_BYTES + k]] * np.uint64(2 * k + 1)
    bound = (mix64(mixed) % np.uint64(BOUND_EVERY) == 0) & (places - begins[owner] >= BOUND_BYTES)
    bounds = np.flatnonzero(bound)
    symbol, text = np.zeros(n, np.int64), [0]
    if len(bounds):
        own = owner[bounds]
        last = np.concatenate([own[1:] != own[:-1], [True]])
        to = np.where(last, bounds, np.concatenate([bounds[1:], [0]]))
        names = mix64(piece(bounds, to, own) ^ (to - bounds).astype(np.uint64) * np.uint64(_BASE))
        codes = np.unique(names, return_inverse=True)[1] + 2
        codes[last] = 1  # a context's last bound starts no whole symbol: it separates contexts
        symbol[bounds] = np.arange(len(bounds))
        text = [*codes.tolist(), 0]
    order = suffix_array(text)
    shared = np.array(common_prefixes(text, order), np.int64)
    rank = np.zeros(len(text), np.int64)
    rank[order] = np.arange(len(text))
    # windows: the bounds inside each, decided by its own bytes only
    count = sizes - WINDOW + 1
    context = np.repeat(np.arange(len(sizes)), count)
    start = ranges(begins, count)
    after = np.minimum.accumulate(np.where(bound, places, n)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(bound, places, -1))
    s, e = after[start + BOUND_BYTES], before[start + WINDOW - 1]
    none = s > e
    s, e = np.where(none, start, s), np.where(none, start, e)
    depth, at = np.where(none, 0, symbol[e] - symbol[s]), rank[symbol[s]]
    interval = np.zeros(len(start), np.int64)
    for q in np.unique(depth).tolist():
        if q:  # the suffixes that share q symbols with this one begin at the last drop below q
            lowest = np.maximum.accumulate(np.where(shared < q, np.arange(len(shared)), 0))
            k = depth == q
            interval[k] = lowest[at[k]]
    key = mix64(piece(start, s, context) + mix64((s - start).astype(np.uint64) + np.uint64(1)))
    key = mix64(key ^ mix64(piece(e, start + WINDOW, context) + mix64((e - start).astype(np.uint64) + np.uint64(WINDOW))))
    key = mix64(key + mix64((interval * (WINDOW + 1) + depth).astype(np.uint64) + np.uint64(3)))
    order = np.lexsort((lo[context] + start - begins[context], h1[context], doc[context], key))
    earlier = np.zeros(len(start), bool)
    same = key[order][1:] == key[order][:-1]
    earlier[order[1:]] = same
    if same.any() and not _verified(data, start, context, order[1:][same], order[:-1][same]):
        earlier = _earlier_by_bytes(data, start, np.lexsort((lo[context] + start - begins[context], h1[context], doc[context])))
    return context, start - begins[context], earlier


def _polynomial(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running polynomial hashes of contexts; those of context c stand at its start + c.

    Contexts are short, so the loop runs over places within a context, all contexts at once.
    """
    heads = np.cumsum(sizes + 1) - (sizes + 1)
    out = np.zeros(int((sizes + 1).sum()), np.uint64)
    for k, live, now in _running(data, begins, sizes):
        out[heads[live] + k + 1] = now
    return out


def _running(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray):
    by_size = np.argsort(-sizes, kind="stable")
    down, now = -sizes[by_size], np.zeros(len(sizes), np.uint64)
    for k in range(int(sizes.max(initial=0))):
        live = by_size[: np.searchsorted(down, -k, side="left")]
        now[live] = now[live] * np.uint64(_BASE) + _BYTES[data[begins[live] + k]]
        yield k, live, now[live]


def _whole_hashes(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes), np.uint64)
    for _, live, now in _running(data, begins, sizes):
        out[live] = now
    return out


def _duplicates(parts: int):
    """A partition of the hash range: runs of repeated windows, back to the texts."""

    @released
    def run(batches):
        columns: list[list[np.ndarray]] = [[] for _ in range(8)]
        for row in _rows_of(batches):
            _, kind, a, b, c, _ = row
            if kind == RUNS:
                yield _batch([row])
                continue
            for held, x in zip(columns, (np.frombuffer(a, np.uint64), _press_out(b), *_unzip(c, 6)), strict=True):
                held.append(x)
        if not columns[0]:
            return
        hashes, data, doc, h1, h2, lo, back, count = (np.concatenate(x) for x in columns)
        columns.clear()
        sizes = count + WINDOW - 1
        begins = np.cumsum(sizes) - sizes
        # equal contexts at equal places of equal anchors: all windows but the first context's are repeated
        later = _later_copies(hashes, back, sizes, _whole_hashes(data, begins, sizes), doc, h1, lo, data, begins)
        found = [(h1[later], h2[later], lo[later], lo[later] + count[later] - 1)]
        # anchors with several contexts, whole anchors at a time, in pieces of about PIECE bytes
        kept = np.flatnonzero(~later)
        kept = kept[np.argsort(hashes[kept], kind="stable")]
        same = hashes[kept][1:] == hashes[kept][:-1]
        kept = kept[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        ends = np.flatnonzero(np.concatenate([hashes[kept][1:] != hashes[kept][:-1], [True]])) + 1 if len(kept) else kept
        total, at = np.concatenate([[0], np.cumsum(sizes[kept])]), 0
        while at < len(kept):
            end = int(ends[np.searchsorted(ends, max(at + 1, np.searchsorted(total, total[at] + PIECE)))]) if total[-1] - total[at] > PIECE else len(kept)
            k, at = kept[at:end], end
            context, offset, earlier = repeated_windows(data[ranges(begins[k], sizes[k])], sizes[k], doc[k], h1[k], lo[k])
            context, offset = context[earlier], offset[earlier]
            if len(context):
                heads = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (offset[1:] != offset[:-1] + 1)]))
                tails = np.concatenate([heads[1:], [len(context)]]) - 1
                own = k[context[heads]]
                found.append((h1[own], h2[own], lo[own] + offset[heads], lo[own] + offset[tails]))
        rows = _run_blobs(*(np.concatenate(x) for x in zip(*found, strict=True)), parts)
        for k in range(0, len(rows), 64):
            yield _batch(rows[k : k + 64])

    return run


CUTS = "h1 long, h2 long, n_removed long, n_spans long, kept_sha256 string"


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals; touching ones are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    heads = np.flatnonzero(new)
    return starts[heads], ends[np.concatenate([heads[1:], [len(starts)]]) - 1]


@released
def _cut(batches):
    """A partition of the texts: what is left of those with repeated windows."""
    by_kind: dict[int, list[tuple]] = {}
    for row in _rows_of(batches):
        by_kind.setdefault(row[1], []).append(row)
    if not by_kind.get(RUNS):
        return
    flat, starts, sizes, h1, h2 = _texts_of(by_kind[TEXTS])
    r1, r2, a, b = (np.concatenate(x) for x in zip(*(_unzip(r[2], 4) for r in by_kind[RUNS]), strict=True))
    at = {pair: k for k, pair in enumerate(zip(h1.tolist(), h2.tolist(), strict=True))}
    order = np.lexsort((a, r2, r1))
    r1, r2, a, b = (x[order] for x in (r1, r2, a, b))
    heads = np.flatnonzero(np.concatenate([[True], (r1[1:] != r1[:-1]) | (r2[1:] != r2[:-1])])) if len(r1) else np.zeros(0, np.int64)
    out = []
    for x, y in zip(heads.tolist(), [*heads[1:].tolist(), len(r1)], strict=True):
        k = at[int(r1[x]), int(r2[x])]
        own = flat[starts[k] : starts[k] + sizes[k]]
        s, e = merged(a[x:y], b[x:y] + WINDOW)
        keep = np.ones(len(own), bool)
        keep[ranges(s, e - s)] = False
        out.append((int(r1[x]), int(r2[x]), int((e - s).sum()), len(s), hashlib.sha256(own[keep].tobytes()).hexdigest()))
    if out:
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["h1", "h2", "n_removed", "n_spans", "kept_sha256"])


def removed_runs(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """ids (IDS), firsts (h1, h2, first_id) and run blobs of the first document of each text."""
    spark = docs.sparkSession
    ship(spark)
    parts = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = stored(rows.mapInArrow(_ids, IDS), "ids")
    # stored, so that a join with ids may split a text that many documents have
    firsts = stored(ids.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id")), "firsts")
    texts = rows.select("text")
    deal = lambda df: df.repartitionById(parts, "part")
    found = stored(deal(texts.mapInArrow(_anchor_blobs(parts), BLOBS)).mapInArrow(_repeated(parts), BLOBS), "anchors")
    # bounded: at most 1 / HOT_SHARE hashes a partition
    hot = np.frombuffer(b"".join(r.a for r in found.where(F.col("kind") == HOT).select("a").collect()), np.uint64)
    back = found.where(F.col("kind") == BACK)
    beside = texts.mapInArrow(_text_blobs(parts), BLOBS).unionByName(firsts.mapInArrow(_first_blobs(parts), BLOBS))
    contexts = deal(back.unionByName(beside)).mapInArrow(_contexts(parts, hot), BLOBS)
    runs = stored(deal(contexts).mapInArrow(_duplicates(parts), BLOBS), "runs")
    return ids, firsts, runs


def digest(docs: DataFrame) -> DataFrame:
    ids, firsts, runs = removed_runs(docs)
    parts = partitions(docs.sparkSession)
    texts = docs.select("text").mapInArrow(_text_blobs(parts), BLOBS)
    cuts = runs.unionByName(texts).repartitionById(parts, "part").mapInArrow(_cut, CUTS)
    whole = ids.join(firsts, ["h1", "h2"]).join(cuts, ["h1", "h2"], "left")
    copy = (F.col("doc_id") != F.col("first_id")) & (F.col("n_bytes") >= WINDOW)
    return whole.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )
