"""What the operators share: the cluster's scratch folder, shipping of this package to
executors, and packed binary blobs that move many small records in one shuffle row.
"""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word rule [^\x20\x09-\x0D]+.
SPACE = b" \t\n\x0b\x0c\r"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only a local session without that setting (tests) gets one of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="termloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python may not see the driver's folders."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    tmp = Path(tempfile.mkdtemp(prefix="termloom-zip-"))  # the driver serves the file while it runs
    shutil.copytree(package, tmp / "src" / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(tmp / f"{package.name}-{uuid.uuid4().hex[:8]}"), "zip", tmp / "src"))
    _shipped.add(sc.applicationId)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Jobs run inside move at most so many rows to Python at a time: for tables of long rows."""
    before = spark.conf.get(_ARROW_ROWS)
    spark.conf.set(_ARROW_ROWS, str(min(int(before), most)))
    try:
        yield
    finally:
        spark.conf.set(_ARROW_ROWS, before)


def _trim() -> None:
    """Gives freed memory back to the system, which allocators keep otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run):
    """run, whose worker holds no freed memory once it has ended: workers live on between jobs, beside
    those of later stages."""

    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            _trim()

    return whole


def base_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that clashing extra columns never meet the operator's own."""
    return df.select(*(F.col(n) for n in names))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column as one uint8 array, and each row's offsets (null: empty)."""
    array = column.cast(pa.large_string())
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    n = len(array)
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64, count=n + 1 + array.offset)[array.offset :] if n else np.zeros(1, np.int64)
    data = array.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_codes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words [^\\x20\\x09-\\x0D]+, the number of each word of all texts, and where the texts' words begin."""
    split = pc.ascii_split_whitespace(texts.fill_null(""))
    words = split.flatten()
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.greater(pc.binary_length(words), 0)
    row = np.repeat(np.arange(len(sizes)), sizes)[real.to_numpy(zero_copy_only=False)]
    coded = words.filter(real).dictionary_encode()
    starts = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))])
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), starts


def slices(batches, limit: int = 8 << 20):
    """Record batches cut so that each holds about limit bytes of text or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer, vectorized: spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pack_planes(values: np.ndarray, width: int) -> bytes:
    """Little-endian integers as byte planes, so that the shuffle codec meets runs of zeros."""
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
    return np.ascontiguousarray(raw.T).tobytes()


def unpack_planes(blob: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(blob, dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(values: np.ndarray, width: int = 8) -> bytes:
    """Ascending integers as planes of their differences."""
    first = values[:1].astype(np.uint64)
    return pack_planes(np.concatenate([first, np.diff(values.astype(np.uint64))]), width)


def unpack_sorted(blob: bytes, width: int = 8) -> np.ndarray:
    return np.cumsum(unpack_planes(blob, width), dtype=np.uint64)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated arange(start, start + length) of many runs."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
