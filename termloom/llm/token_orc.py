"""Token ids as ORC: integer run-length encoding, row indexes, Bloom filters on doc_id.

Documents are range-partitioned and sorted by id (and, where rows share one, by a hash of their text), encoded in Arrow batches and written by
Spark's ORC writer: the id lists become run-length-encoded integer streams, each stripe
carries row indexes and a Bloom filter on doc_id. Files are in ascending order of doc_id,
so a reader prunes files, stripes and row groups by their statistics and stripes are read
in parallel.

Each row also has its offset within its file (before) and the file's number (part). A
manifest beside the files holds each file's first and last doc_id, its number of ids and its
base, the number of ids in all files before it: as many rows as there are files. A document's
place among all ids is its file's base plus its offset, so looking up a document reads the
manifest and the row groups that its metadata can't rule out, and nothing else.

Defined cases: null or empty text is the end id alone; a very long text is encoded whole and
is one row, its ids one list; rows that repeat a doc_id stand next to each other, ordered by
a hash of their text, in as many files as their number needs (equal rows in one), a null
doc_id comes first; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import BATCH_BYTES, encoder
from .shared import partitions, released, scratch, ship, slices

SCHEMA = "doc_id long, part int, before long, n_tokens long, ids array<int>"
ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "10000", "orc.stripe.size": str(64 << 20), "orc.create.index": "true", "compression": "zstd"}


def encode_partition(vocabulary: str | None):
    @released
    def run(batches):
        own, before = encoder(vocabulary), 0
        for batch in slices(batches, BATCH_BYTES):
            ids, offsets = own.encode(batch.column("text"))
            n, sizes = batch.num_rows, np.diff(offsets)
            starts = before + offsets[:-1]
            before += int(offsets[-1])
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.nulls(n, pa.int32()), pa.array(starts), pa.array(sizes), lists], names=["doc_id", "part", "before", "n_tokens", "ids"])

    return run


def manifest_path(path: str) -> str:
    return f"{path.rstrip('/')}.manifest"


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """The ids of every document's whole text, end id appended, as ORC files under path, and
    their manifest beside it."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the hash splits rows that share an id or lack one; an id that is one row's alone isn't touched by it
    ordered = rows.repartitionByRange(partitions(spark), F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"), "text")
    encoded = ordered.mapInArrow(encode_partition(vocabulary), SCHEMA).withColumn("part", F.spark_partition_id())
    encoded.write.options(**ORC).orc(path)
    files = spark.read.schema(SCHEMA).orc(path).groupBy("part").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).coalesce(1).write.parquet(manifest_path(path))


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids. A condition on doc_id reaches the files' metadata."""
    rows = spark.read.schema(SCHEMA).orc(path)
    wanted = rows if where is None else rows.where(where)
    bases = spark.read.schema("part int, base long").parquet(manifest_path(path))
    joined = wanted.join(F.broadcast(bases), "part")
    return joined.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")


@released
def _checked(batches):
    for batch in batches:
        lists = batch.column("ids")
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
        sums = [zlib.crc32(flat[ends[i] : ends[i + 1]]) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, vocabulary)
    return read_tokens(docs.sparkSession, path).mapInArrow(_checked, "doc_id long, start long, n_tokens long, ids_crc32 long")
