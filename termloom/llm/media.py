"""Media columns: signature sniffing, structural validation, carving.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over a
blob. Each hit is confirmed by its format's validator, which walks the structure and gives
the true start and end, so magic bytes by chance are dropped. The format at offset 0 corrects
a declared type; confirmed formats further in are embedded media, which carve() cuts out.

For text the payload is its UTF-8 form, zero-padded to a positive multiple of BLOCK, stored
losslessly as 8-bit mono PCM in a RIFF/WAVE file under the wrong type text/plain, that of the
column it comes from; features are computed from what sniffing and carving read back.

Defined cases: null text is the empty payload, 64 zero bytes; equal texts give equal values;
each of several rows of a doc_id gets its row; a very long text is one row, held a few times
over in memory while it is its turn, and as a Spark value is under 2 GiB, which RIFF's 32-bit
sizes hold; spans that start together come longest first; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released, scratch, ship, slices

BLOCK, SAMPLE_RATE = 64, 8000

# Magic bytes and the media types whose validator looks at them.
SIGNATURES = [
    (b"RIFF", "audio/wav"),
    (b"RIFF", "image/webp"),
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"BM", "image/bmp"),
    (b"II*\0", "image/tiff"),
    (b"MM\0*", "image/tiff"),
    (b"fLaC", "audio/flac"),
    (b"ID3", "audio/mpeg"),
    (b"OggS", "application/ogg"),
    (b"ftyp", "video/mp4"),
    (b"%PDF-", "application/pdf"),
    (b"PK\x05\x06", "application/zip"),
    (b"\x1f\x8b\x08", "application/gzip"),
]
DECLARED = "text/plain"
#: Bytes of a compressed member that are inflated at a time.
INFLATE_BYTES = 1 << 20


def riff_chunks(data: bytes, at: int, form: bytes) -> tuple[int, list[bytes]]:
    """Length of a RIFF file of this form whose chunks fill it, and their names; else 0."""
    if data[at + 8 : at + 12] != form:
        return 0, []
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return 0, []
    k, seen = at + 12, []
    while k + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, k)
        seen.append(name)
        k += 8 + size + (size & 1)
    return (end - at, seen) if k == end else (0, [])


def wav_length(data: bytes, at: int) -> int:
    """RIFF/WAVE with fmt before data."""
    length, seen = riff_chunks(data, at, b"WAVE")
    return length if b"fmt " in seen and b"data" in seen[seen.index(b"fmt ") :] else 0


def webp_length(data: bytes, at: int) -> int:
    """RIFF/WEBP that begins with one of its three image chunks."""
    length, seen = riff_chunks(data, at, b"WEBP")
    return length if seen and seen[0] in (b"VP8 ", b"VP8L", b"VP8X") else 0


def tiff_length(data: bytes, at: int) -> int:
    """The chain of directories; reaches to the end of the last value, strip or tile."""
    order = "<" if data[at : at + 2] == b"II" else ">"
    sizes = (0, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8)  # of the field types
    place, seen, end = struct.unpack_from(f"{order}I", data, at + 4)[0], set(), 8
    while place:
        if place in seen or place < 8:
            return 0
        seen.add(place)
        count = struct.unpack_from(f"{order}H", data, at + place)[0]
        held: dict[int, tuple[int, ...]] = {}
        for k in range(count):
            entry = at + place + 2 + 12 * k
            tag, kind, n = struct.unpack_from(f"{order}HHI", data, entry)
            if not 0 < kind < len(sizes):
                return 0
            value = entry + 8 if n * sizes[kind] <= 4 else at + struct.unpack_from(f"{order}I", data, entry + 8)[0]
            if value + n * sizes[kind] > len(data):
                return 0
            end = max(end, value + n * sizes[kind] - at)
            if tag in (273, 279, 324, 325) and kind in (3, 4):  # offsets and sizes of strips, of tiles
                held[tag] = struct.unpack_from(f"{order}{n}{'H' if kind == 3 else 'I'}", data, value)
        for offsets, lengths in ((273, 279), (324, 325)):
            end = max([end, *(x + y for x, y in zip(held.get(offsets, ()), held.get(lengths, ())))])
        end = max(end, place + 6 + 12 * count)
        place = struct.unpack_from(f"{order}I", data, at + place + 2 + 12 * count)[0]
    return end if seen and at + end <= len(data) else 0


# Kilobits a second of MPEG 1 layer III by index, samples a second by index.
MPEG_RATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
MPEG_SAMPLES = (44100, 48000, 32000)


def mp3_length(data: bytes, at: int) -> int:
    """An ID3v2 tag and two MPEG 1 layer III frames or more after it, up to the last whole one."""
    if data[at + 3] > 4 or any(x & 0x80 for x in data[at + 6 : at + 10]):
        return 0
    k, frames = at + 10 + sum((x & 0x7F) << s for x, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0), strict=True)), 0
    while k + 4 <= len(data) and data[k] == 0xFF and data[k + 1] & 0xFE == 0xFA:
        rate, sample = data[k + 2] >> 4, data[k + 2] >> 2 & 3
        if not 0 < rate < 15 or sample == 3:
            break
        size = 144_000 * MPEG_RATES[rate] // MPEG_SAMPLES[sample] + (data[k + 2] >> 1 & 1)
        if k + size > len(data):
            break
        k, frames = k + size, frames + 1
    return k - at if frames > 1 else 0


_REVERSED = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def ogg_checksum(page: bytes) -> int:
    """CRC-32 with the highest bit first, nothing before or after it: zlib's, on reversed bits."""
    low = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{low:032b}"[::-1], 2)


def ogg_length(data: bytes, at: int) -> int:
    """Pages of one stream from its first to its last, numbers in order and every CRC right."""
    k, number = at, 0
    while data[k : k + 4] == b"OggS" and k + 27 <= len(data):
        flags, serial, place, crc, segments = data[k + 5], *struct.unpack_from("<IIIB", data, k + 14)
        if k == at:
            stream = serial
        head = 27 + segments
        size = head + sum(data[k + 27 : k + head])
        page = data[k : k + size]
        if data[k + 4] or (k == at) != bool(flags & 2) or serial != stream or place != number or len(page) < size or ogg_checksum(page[:22] + bytes(4) + page[26:]) != crc:
            return 0
        k, number = k + size, number + 1
        if flags & 4:
            return k - at
    return 0


def mp4_length(data: bytes, at: int, known: dict | None = None) -> int:
    """Boxes from ftyp on, as long as they are whole; one of them describes the media."""

    def step(state: int) -> int:  # twice the place, odd after a box that describes
        k, described = state >> 1, state & 1
        size, name = struct.unpack_from(">I4s", data, k) if k + 8 <= len(data) else (0, b"")
        if size == 1 and k + 16 <= len(data):
            size = struct.unpack_from(">Q", data, k + 8)[0]
        if size < 8 or k + size > len(data) or not name.isalnum():
            return ~k if described else ~0
        return 2 * (k + size) + (described or name in (b"moov", b"moof"))

    end = _follow(step, 2 * at, {} if known is None else known.setdefault("mp4", {}))
    return end - at if end else 0


_PDF_END = re.compile(rb"startxref[\r\n ]+(\d{1,10})[\r\n ]+%%EOF(?:\r\n|\r|\n)?")


def pdf_length(data: bytes, at: int) -> int:
    """Up to the last end mark before another document, with the table it refers to inside."""
    if not data[at + 5 : at + 6].isdigit():
        return 0
    following = data.find(b"%PDF-", at + 5)
    last = None
    for last in _PDF_END.finditer(data, at, following if following >= 0 else len(data)):
        pass
    if last is None:
        return 0
    table = at + int(last[1])
    return last.end() - at if table < last.start() and (data.startswith(b"xref", table) or data[table : table + 1].isdigit()) else 0


def zip_span(data: bytes, at: int) -> tuple[int, int]:
    """From the end record back over the directory to the first entry; the entries are counted."""
    count, size, offset, comment = struct.unpack_from("<HIIH", data, at + 10)
    k, start = at - size, at - size - offset
    end = at + 22 + comment
    if start < 0 or end > len(data) or (count and data[start : start + 4] != b"PK\x03\x04"):
        return 0, 0
    for _ in range(count):
        if data[k : k + 4] != b"PK\x01\x02":
            return 0, 0
        k += 46 + sum(struct.unpack_from("<HHH", data, k + 28))
    return (start, end) if k == at else (0, 0)


def png_length(data: bytes, at: int) -> int:
    """Chunks from IHDR to IEND, every CRC right."""
    k, first = at + 8, True
    while k + 12 <= len(data):
        size, name = struct.unpack_from(">I4s", data, k)
        if k + 12 + size > len(data) or first != (name == b"IHDR") or zlib.crc32(data[k + 4 : k + 8 + size]) != struct.unpack_from(">I", data, k + 8 + size)[0]:
            return 0
        k, first = k + 12 + size, False
        if name == b"IEND":
            return k - at
    return 0


#: Of a chain of steps every so many are remembered.
REMEMBERED = 8


def _follow(step, state: int, known: dict[int, int]) -> int:
    """Where steps from a state end (0: nowhere valid). step gives the next state, or ~end.

    Chains that meet go on together, so what one walk has passed ends the next: all walks over a
    blob take no more steps than it has states, and REMEMBERED more each.
    """
    trail, n = [], 0
    while state not in known:
        if n % REMEMBERED == 0:
            trail.append(state)
        n += 1
        state = step(state)
        if state < 0:
            end = ~state
            break
    else:
        end = known[state]
    known.update(dict.fromkeys(trail, end))
    return end


def gif_length(data: bytes, at: int, known: dict | None = None) -> int:
    """Header, colour tables, blocks of extensions and images up to the trailer."""
    size = len(data)

    def step(state: int) -> int:  # twice the place, odd inside a chain of sub-blocks
        k = state >> 1
        if k >= size:
            return ~0
        if state & 1:
            return 2 * (k + 1 + data[k]) + 1 if data[k] else 2 * (k + 1)
        if data[k] == 0x3B:
            return ~(k + 1)
        if data[k] == 0x21:
            return 2 * (k + 2) + 1
        if data[k] == 0x2C and k + 10 <= size:
            local = data[k + 9]
            return 2 * (k + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0)) + 1
        return ~0

    if at + 13 > size:
        return 0
    flags = data[at + 10]
    k = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    end = _follow(step, 2 * k, {} if known is None else known.setdefault("gif", {}))
    return end - at if end else 0


def jpeg_length(data: bytes, at: int, known: dict | None = None) -> int:
    """Segments from SOI, then entropy-coded data up to EOI; needs a frame and a scan."""
    known = {} if known is None else known
    if "eoi" not in known:
        known["eoi"] = [m.start() for m in re.finditer(b"\xff\xd9", data)]
    ends = known["eoi"]

    def step(state: int) -> int:  # twice the place, odd after a frame
        k, frame = state >> 1, state & 1
        if k + 4 > len(data) or data[k] != 0xFF:
            return ~0
        mark, size = data[k + 1], struct.unpack_from(">H", data, k + 2)[0]
        if size < 2:
            return ~0
        frame |= mark in (0xC0, 0xC1, 0xC2)
        if mark == 0xDA:
            after = bisect_left(ends, k + 2 + size)
            return ~(ends[after] + 2) if frame and after < len(ends) else ~0
        return 2 * (k + 2 + size) + frame

    end = _follow(step, 2 * (at + 2), known.setdefault("jpeg", {}))
    return end - at if end else 0


def bmp_length(data: bytes, at: int) -> int:
    """File size and pixel offset within the data, a known header size, one plane."""
    if at + 30 > len(data):
        return 0
    size, reserved, pixels, header = struct.unpack_from("<IIII", data, at + 2)
    planes = struct.unpack_from("<H", data, at + 26)[0]
    return size if at + size <= len(data) and not reserved and header in (12, 40, 108, 124) and 14 + header <= pixels <= size and planes == 1 else 0


def flac_length(data: bytes, at: int, known: dict | None = None) -> int:
    """Metadata blocks from STREAMINFO on; the audio reaches to the end of the blob."""

    def step(k: int) -> int:
        if k + 4 > len(data):
            return ~0
        after = k + 4 + int.from_bytes(data[k + 1 : k + 4], "big")
        if not data[k] & 0x80:
            return after
        return ~len(data) if after + 2 <= len(data) and data[after] == 0xFF and data[after + 1] & 0xFC == 0xF8 else ~0

    if data[at + 4] & 0x7F or int.from_bytes(data[at + 5 : at + 8], "big") != 34:
        return 0
    end = _follow(step, at + 4, {} if known is None else known.setdefault("flac", {}))
    return end - at if end else 0


def gzip_length(data: bytes, at: int) -> int:
    """One member, inflated to its end piece by piece, nothing of it kept; zlib checks its CRC."""
    inflate, fed = zlib.decompressobj(31), at
    try:
        while not inflate.eof:
            rest = inflate.unconsumed_tail
            if not rest:
                rest = data[fed : fed + INFLATE_BYTES]
                fed += len(rest)
                if not rest:
                    return 0
            inflate.decompress(rest, INFLATE_BYTES)
    except zlib.error:
        return 0
    return fed - len(inflate.unused_data) - at


def _from(length):
    """A validator of what starts with its magic bytes, as one that gives start and end."""
    return lambda data, at, known: (at, at + length(data, at))


def _sharing(length):
    """The same of a format whose chains are remembered for the blob."""
    return lambda data, at, known: (at, at + length(data, at, known))


def mp4_span(data: bytes, at: int, known: dict) -> tuple[int, int]:
    return (at - 4, at - 4 + mp4_length(data, at - 4, known)) if at >= 4 else (0, 0)


VALIDATORS = {
    "audio/wav": _from(wav_length), "image/webp": _from(webp_length), "image/png": _from(png_length), "image/gif": _sharing(gif_length),
    "image/jpeg": _sharing(jpeg_length), "image/bmp": _from(bmp_length), "image/tiff": _from(tiff_length), "audio/flac": _sharing(flac_length),
    "audio/mpeg": _from(mp3_length), "application/ogg": _from(ogg_length), "video/mp4": mp4_span, "application/pdf": _from(pdf_length),
    "application/zip": lambda data, at, known: zip_span(data, at), "application/gzip": _from(gzip_length),
}


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found, kinds = ahocorasick.Automaton(), {}
    for magic, kind in SIGNATURES:
        kinds.setdefault(magic, []).append(kind)
    for magic, own in kinds.items():
        found.add_word(magic.decode("latin-1"), (len(magic), own))
    found.make_automaton()
    return found


def carve(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, type) of every confirmed format, outermost first, in order of start."""
    spans, known = set(), {}
    for last, (size, kinds) in automaton().iter(data.decode("latin-1")):
        for kind in kinds:
            try:
                start, end = VALIDATORS[kind](data, last + 1 - size, known)
            except (struct.error, IndexError):  # it breaks off before its structure ends
                continue
            if end > start:
                spans.add((start, end, kind))
    return sorted(spans, key=lambda x: (x[0], -x[1], x[2]))


def sniff(data: bytes, declared: str = "application/octet-stream") -> str:
    """The confirmed type at offset 0, else what was declared."""
    return next((kind for start, _, kind in carve(data) if start == 0), declared)


def wav_bytes(samples: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """8-bit mono PCM; samples of even length."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + 8 + len(samples), b"WAVE") + form + struct.pack("<4sI", b"data", len(samples)) + samples


def wav_samples(data: bytes) -> bytes:
    k = 12
    while True:
        name, size = struct.unpack_from("<4sI", data, k)
        if name == b"data":
            return data[k + 8 : k + 8 + size]
        k += 8 + size + (size & 1)


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


@released
def _stored(batches):
    for batch in slices(batches):
        made = [payload(x) for x in batch.column("text").to_pylist()]
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in made], pa.int64()), pa.array([DECLARED] * n), pa.array([wav_bytes(x[1]) for x in made], pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])


def store(docs: DataFrame, path: str) -> None:
    """doc_id, n_bytes, declared type and media bytes of every text, as Parquet."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows.mapInArrow(_stored, "doc_id long, n_bytes long, declared string, media binary").write.options(**{"compression": "zstd", "parquet.enable.dictionary": "false"}).parquet(path)


def describe(media: bytes, declared: str) -> tuple[str, bytes, str]:
    """Corrected type, payload, and a feature string with integers only."""
    spans = carve(media)
    kind = next((k for start, _, k in spans if start == 0), declared)
    samples = wav_samples(media) if kind == "audio/wav" else media
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int64) - 128
    turns = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    embedded = ";".join(f"{k}@{a}+{b - a}" for a, b, k in spans if a > 0)
    return kind, samples, f"type={kind} samples={len(x)} sum={int(x.sum())} energy={int((x * x).sum())} peak={int(np.abs(x).max(initial=0))} turns={turns} embedded=[{embedded}]"


@released
def _features(batches):
    for batch in slices(batches):
        out = []
        for doc, n, declared, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            _, samples, feature = describe(media, declared)
            out.append((doc, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FEATURES.split(", ")])


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(docs: DataFrame) -> DataFrame:
    path = scratch(docs.sparkSession, "media")
    store(docs, path)
    return docs.sparkSession.read.parquet(path).select("doc_id", "n_bytes", "declared", "media").mapInArrow(_features, FEATURES)
