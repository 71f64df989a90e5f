"""Line dedup by range-partitioned, secondarily sorted line hashes.

A key is a line without the white space at its ends, A-Z lower-cased. Keys of MIN_CHARS
code points or more that MIN_DOCS documents or more hold lose all their lines but those in
the largest doc_id. Each document sends one row per such key: a 128-bit hash, its id and
the key's line numbers. The rows are range-partitioned by hash and descending id and sorted alike,
so one pass in constant memory sees each key's keeper first and drops
the key from later documents. The id is part of the range, so a key that holds a third of
all rows spreads over many partitions; keys at a partition's ends stay undecided there and
are settled from their counts, summed over partitions: at most two keys a partition, so
joining those by broadcast is bounded.

What comes back is no text but, per document with a dropped line, a compressed bitmap of
the lines to keep.

Defined cases: null or empty text is one empty line; rows that repeat a doc_id count as one
document in the frequency rule and lose their lines alike; rows with a null doc_id don't
count in the frequency rule, come after all others and lose their lines like them; equal rows get equal bitmaps;
an empty table gives an empty result; extra columns are kept by keep_first and ignored by
digest.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, partitions, released, ship, slices, stored

MIN_CHARS, MIN_DOCS = 40, 5

LINES = "h1 long, h2 long, down long, mark long, n_lines int, lines binary"
DECIDED = "state int, h1 long, h2 long, doc_id long, mark long, n_lines int, lines binary"
DROP, PENDING, SUMMARY = range(3)
NO_ID = (1 << 63) - 1  # in column down, for a null doc_id: the last of its key


def line_keys(text: str) -> list[bytes]:
    return [x.strip(SPACE).lower() for x in text.encode().split(b"\n")]  # bytes.lower() is ASCII only


def long_enough(key: bytes) -> bool:
    return len(key) >= MIN_CHARS and (key.isascii() or len(key.decode()) >= MIN_CHARS)


@released
def _lines(batches):
    """One row per document and distinct long key: hash, document, packed line numbers."""
    for batch in slices(batches):
        out: list[tuple] = []
        for doc, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            at: dict[bytes, list[int]] = {}
            keys = line_keys(text or "")
            for k, key in enumerate(keys):
                if long_enough(key):
                    at.setdefault(key, []).append(k)
            out += ((hashlib.blake2b(key, digest_size=16).digest(), NO_ID if doc is None else -doc, mark, len(keys), np.array(k, "<u4").tobytes()) for key, k in at.items())
        if out:
            hashes = np.frombuffer(b"".join(x[0] for x in out), dtype="<i8").reshape(-1, 2)
            down, mark, n, lines = zip(*(x[1:] for x in out), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy()), pa.array(down, pa.int64()), pa.array(mark, pa.int64()), pa.array(n, pa.int32()), pa.array(lines, pa.binary())], names=["h1", "h2", "down", "mark", "n_lines", "lines"])


@released
def _stream(batches):
    """One partition's rows in order of hash, then descending doc_id (column down: its negative).

    states: DROP is settled; PENDING belongs to a key that may go on in another partition;
    SUMMARY counts such a key's documents here. Holds the rows of under MIN_DOCS documents.
    """
    key, first, docs, top, last, held, out = None, True, 0, 0, None, [], []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            h1, h2, down, *rest = row
            if key != (h1, h2):
                if key is not None:
                    if first:
                        out.append((SUMMARY, *key, top, docs, 0, b""))
                    first = False
                key, docs, last, top, held = (h1, h2), 0, None, None if down == NO_ID else -down, []
            own = None if down == NO_ID else -down
            if own is not None and down != last:
                docs, last = docs + 1, down
            if first:
                out.append((PENDING, *key, own, *rest))
                continue
            if own is None and docs < MIN_DOCS:  # all documents that count have passed
                continue
            held.append((own, *rest))
            if docs >= MIN_DOCS:
                out += ((DROP, *key, *x) for x in held if x[0] != top)
                held = []
        if out:
            yield _decided(out)
            out = []
    if key is not None:
        out += [(PENDING, *key, *x) for x in held]
        out.append((SUMMARY, *key, top, docs, 0, b""))
        yield _decided(out)


def _decided(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in DECIDED.split(", ")])


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, mark, n_lines, lines: packed numbers of lines to drop, a row for each key."""
    spark = docs.sparkSession
    ship(spark)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    rows = marked.mapInArrow(_lines, LINES)
    order = ("h1", "h2", "down")
    decided = stored(rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_stream, DECIDED), "lines")
    totals = decided.where(F.col("state") == SUMMARY).groupBy("h1", "h2").agg(F.sum("mark").alias("docs"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= MIN_DOCS)
    columns = ("doc_id", "mark", "n_lines", "lines")
    settled = decided.where(F.col("state") == DROP).select(*columns)
    late = decided.where(F.col("state") == PENDING).join(F.broadcast(totals), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select(*columns)
    return settled.unionByName(late)


def _bitmap(lines: list[bytes], n_lines: int) -> tuple[int, bytes]:
    keep = np.ones(n_lines, dtype=bool)
    keep[np.frombuffer(b"".join(lines), dtype="<u4")] = False
    return int(n_lines - keep.sum()), zlib.compress(np.packbits(keep).tobytes())


@released
def _bitmaps(batches):
    for batch in batches:
        doc, mark, n_lines, lines = batch.columns
        made = [_bitmap(x, n) for x, n in zip(lines.to_pylist(), n_lines.to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([doc, mark, pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.binary())], names=["doc_id", "mark", "n_dropped", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), n_dropped, keep_bitmap, for documents that lose lines.

    The bitmap has a bit per line, first line first, packed and zlib-compressed.
    """
    grouped = dropped_lines(docs).groupBy("doc_id", "mark").agg(F.first("n_lines").alias("n_lines"), F.collect_list("lines").alias("lines"))
    return grouped.mapInArrow(_bitmaps, "doc_id long, mark long, n_dropped long, keep_bitmap binary")


def kept_lines(text: str, bitmap: bytes | None) -> str:
    if bitmap is None:
        return text
    lines = text.split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), count=len(lines))
    return "\n".join(x for x, k in zip(lines, keep, strict=True) if k)


def _with_bitmaps(docs: DataFrame) -> DataFrame:
    """whole (the row as it came), text, n_dropped, keep_bitmap."""
    bitmaps = keep_bitmaps(docs).select(F.col("doc_id").alias("b_doc"), F.col("mark").alias("b_mark"), "n_dropped", "keep_bitmap")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    joined = rows.join(bitmaps, F.col("whole.doc_id").cast("long").eqNullSafe(F.col("b_doc")) & (F.xxhash64("whole.text") == F.col("b_mark")), "left")
    return joined.select("whole", F.coalesce("n_dropped", F.lit(0)).alias("n_dropped"), "keep_bitmap")


@released
def _digests(batches):
    for batch in slices(batches):
        ids, texts, dropped, bitmaps = batch.columns
        texts = [x or "" for x in texts.to_pylist()]
        kept = [hashlib.sha256(kept_lines(t, b).encode()).hexdigest() for t, b in zip(texts, bitmaps.to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([ids, pa.array([t.count("\n") + 1 for t in texts], pa.int64()), dropped, pa.array(kept)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def digest(docs: DataFrame) -> DataFrame:
    narrow = docs.select("doc_id", "text")
    rows = _with_bitmaps(narrow).select(F.col("whole.doc_id").cast("long").alias("doc_id"), F.col("whole.text").alias("text"), F.col("n_dropped").cast("long"), "keep_bitmap")
    return rows.mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


@released
def _kept_texts(batches):
    for batch in slices(batches):
        whole, bitmaps = batch.columns
        texts = pc.struct_field(whole, "text").to_pylist()
        yield pa.RecordBatch.from_arrays([whole, pa.array([None if t is None else kept_lines(t, b) for t, b in zip(texts, bitmaps.to_pylist(), strict=True)], pa.string())], names=["whole", "kept"])


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with every text reduced to its kept lines; n_chars follows where there is one.

    A document that loses every line keeps an empty text.
    """
    rows = _with_bitmaps(docs).select("whole", "keep_bitmap")
    cut = rows.mapInArrow(_kept_texts, f"whole {rows.schema['whole'].dataType.simpleString()}, kept string")
    new = {"text": F.col("kept"), "n_chars": F.char_length(F.coalesce("kept", F.lit(""))).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return cut.select(*(new.get(c, F.col(f"whole.`{c}`")).alias(c) for c in docs.columns))
