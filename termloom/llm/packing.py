"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document longer than a window is cut
at window lengths; what is left of it, or a short document, goes into the open window that
it fills best. If it fits none and all windows are open, the fullest is emitted and a new
one opened. The windows still open at a partition's end, as many at most as may be open,
are merged in further rounds of the same packing over whole windows, each with a
MERGE_WAYS-th of the partitions.

What is stored is sequences: a row each, with its ids as little-endian unsigned 32-bit
integers and its pieces in order. A window is written where it is filled; only windows that
are still open at a partition's end move, ids and all. A piece's checksum is taken from the
stored ids.

Defined cases: null or empty text is the end id alone; a very long text fills whole windows
and leaves one piece; each of several rows of a doc_id, null or not, is packed; equal windows
fill in order of their numbers; an empty table gives no rows; extra columns are ignored. A
sequence whose length is a power of two gets no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import BATCH_BYTES, encoder
from .shared import arrow_rows, released, ship, slices, stored

WINDOW, OPEN_WINDOWS, MERGE_WAYS = 4096, 64, 32

SEQUENCES = "seq long, open boolean, ids binary, pieces array<struct<doc_id:bigint,start:bigint,length:bigint,doc_tokens:bigint,offset:bigint>>"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_PIECE = pa.struct([(x, pa.int64()) for x in ("doc_id", "start", "length", "doc_tokens", "offset")])
#: Bytes of ids in one batch of windows.
OUT_BYTES = 4 << 20


class Packer:
    """Open windows, sorted by fill. Items are (length, payload)."""

    def __init__(self, size: int = WINDOW, most: int = OPEN_WINDOWS):
        self.size, self.most, self.fills, self.windows = size, most, [], {}
        self.made = 0

    def add(self, length: int, payload) -> tuple[int, list] | None:
        """Place an item; returns a window that had to be emitted for it, if any."""
        k = bisect_right(self.fills, (self.size - length, float("inf"))) - 1
        emitted = None
        if k >= 0:
            fill, name = self.fills.pop(k)
        else:
            if len(self.fills) >= self.most:
                emitted = self._take(len(self.fills) - 1)
            fill, name = 0, self.made
            self.made += 1
            self.windows[name] = []
        self.windows[name].append((fill, length, payload))
        insort(self.fills, (fill + length, name))
        if emitted is None and self.fills[-1][0] == self.size:
            emitted = self._take(len(self.fills) - 1)
        return emitted

    def _take(self, k: int) -> tuple[int, list]:
        _, name = self.fills.pop(k)
        return name, self.windows.pop(name)

    def rest(self):
        while self.fills:
            yield self._take(len(self.fills) - 1)


class _Out:
    """Emitted windows on their way to a batch. An item is a list of (piece, ids)."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, window: tuple[int, list], is_open: bool) -> None:
        pieces, ids, at = [], [], 0
        for _, _, item in window[1]:
            for piece, own in item:
                pieces.append({**piece, "offset": at})
                ids.append(own)
                at += piece["length"]
        self.rows.append((window[0], is_open, b"".join(ids), pieces))
        self.size += 4 * at

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.bool_(), pa.binary(), pa.list_(_PIECE)]
        columns = [pa.array(list(c), t) for c, t in zip(zip(*self.rows, strict=True), kinds, strict=True)]
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays(columns, names=["seq", "open", "ids", "pieces"])


def _packed(items, window: int, most: int):
    """Batches of windows from (length, item) pairs."""
    packer, out = Packer(window, most), _Out()
    for length, item in items:
        if full := packer.add(length, item):
            out.add(full, False)
            if out.size >= OUT_BYTES:
                yield out.batch()
    for left in packer.rest():
        out.add(left, True)
        if out.size >= OUT_BYTES:
            yield out.batch()
    if out.rows:
        yield out.batch()


def pack_partition(vocabulary: str | None, window: int = WINDOW, most: int = OPEN_WINDOWS):
    @released
    def run(batches):
        own = encoder(vocabulary)

        def items():
            for batch in slices(batches, BATCH_BYTES):
                ids, offsets = own.encode(batch.column("text"))
                ids = ids.astype("<u4", copy=False)
                for doc, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    for at in range(a, b, window):
                        end = min(b, at + window)
                        yield end - at, [({"doc_id": doc, "start": at - a, "length": end - at, "doc_tokens": b - a}, ids[at:end].tobytes())]

        yield from _packed(items(), window, most)

    return run


def merge_partition(window: int = WINDOW, most: int = OPEN_WINDOWS):
    """Packs whole open windows; their pieces keep their order."""

    @released
    def run(batches):
        def items():
            for batch in batches:
                for raw, pieces in zip(batch.column("ids").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
                    cut = lambda p, raw=raw: raw[4 * p["offset"] : 4 * (p["offset"] + p["length"])]
                    yield len(raw) // 4, [(p, cut(p)) for p in pieces]

        yield from _packed(items(), window, most)

    return run


#: Documents, and sequences, that move to Python at a time.
TEXT_ROWS, SEQUENCE_ROWS = 2000, 500


def pack_sequences(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """sequence_id, ids (binary), pieces of every sequence, from stored files."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def numbered(df: DataFrame, level: int) -> DataFrame:
        with arrow_rows(spark, SEQUENCE_ROWS if level else TEXT_ROWS):
            return stored(df.withColumn("part", F.spark_partition_id()), f"packing-{level}", compression="zstd")

    made, done, level = numbered(rows.mapInArrow(pack_partition(vocabulary), SEQUENCES), 0), [], 0
    parts = (made.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        named = made.withColumn("sequence_id", F.lit(level).cast("long") * F.lit(1 << 58) + F.col("part").cast("long") * F.lit(1 << 34) + F.col("seq"))
        if parts == 1 and level:
            done.append(named)
            break
        done.append(named.where(~F.col("open")))
        parts, level = -(-parts // MERGE_WAYS), level + 1
        made = numbered(named.where("open").select("ids", "pieces").repartition(parts).mapInArrow(merge_partition(), SEQUENCES), level)
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.select("sequence_id", "ids", "pieces")


@released
def _pieces(batches):
    """A row per piece, its checksum taken from the ids that were read."""
    for batch in batches:
        out = []
        for name, raw, pieces in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            view = memoryview(raw)
            out += ((p["doc_id"], p["start"], p["length"], zlib.crc32(view[4 * p["offset"] : 4 * (p["offset"] + p["length"])]), p["doc_tokens"], name, p["offset"]) for p in pieces)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])


def pack(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    sequences = pack_sequences(docs, vocabulary)
    with arrow_rows(docs.sparkSession, SEQUENCE_ROWS):
        return stored(sequences.mapInArrow(_pieces, PIECES), "pieces")


def padded_length(n: int, window: int = WINDOW) -> int:
    """What a sequence of n ids is padded to."""
    return n if n & (n - 1) == 0 else window


def _padded(pad_id: int):
    def run(batches):
        for batch in batches:
            lists = []
            for raw in batch.column("ids").to_pylist():
                own = np.frombuffer(raw, "<u4").astype(np.int64)
                lists.append(np.concatenate([own, np.full(padded_length(len(own)) - len(own), pad_id, np.int64)]))
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(lists, pa.list_(pa.int64()))], names=["sequence_id", "ids"])

    return run


def training_sequences(sequences: DataFrame, pad_id: int) -> DataFrame:
    """sequence_id, ids: what a trainer reads, padded to WINDOW except at a power of two."""
    return sequences.select("sequence_id", "ids").mapInArrow(_padded(pad_id), "sequence_id long, ids array<long>")


digest = pack
