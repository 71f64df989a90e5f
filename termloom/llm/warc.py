"""WARC archives compressed record by record with an embedded Zstandard dictionary.

A dictionary is trained on a bounded sample of the pages' records, spread over the whole
table by a hash, and stands, itself compressed, in a skippable frame at the head of every
archive. Where the sample is too small to train on, it is the dictionary itself, as raw
content. Each record is a Zstandard frame of its own, so a reader can start at any record's
offset. Pages with equal payloads are archived once, as a response with the smallest page_id;
the others become revisit records that refer to it.

What a page is gets settled on ids and digests alone. Pages then meet their verdict by their
own id, not by their payload's digest, so a payload that very many pages share never gathers
in one task, and revisits drop their payload before they are written.

Archives go to the shared folder under a name of their task attempt. The index beside them has
a row for each record of the attempts that Spark committed (page, archive, offset, length), so
that a lost executor's half-written files are never read, one page is read alone, and large
archives are read in ranges of bounded size.

Defined cases: null html is an empty payload, archived like any other; null urls get the
target urn:page:<id>; rows that repeat a page_id are each archived, and of equal payloads
with an equal smallest id the row with the smaller url is the response, as is any row equal
to it; a null page_id is written as urn:page:null and comes after all others, and of equal
payloads that all lack an id each is a response, as a revisit could not name one; a very long
html is one record in memory at a time; an empty table gives no archives and no rows; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import partitions, released, scratch, ship, slices, stored

# The skippable frame that holds a dictionary, and the first bytes of a frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
DATE = "2024-01-01T00:00:00Z"
DICTIONARY_BYTES, LEVEL = 64 << 10, 3
#: The dictionary's sample: so many records at most, each cut to so many bytes.
SAMPLE_RECORDS, SAMPLE_BYTES = 400, 16 << 10
MIN_REVISIT_BYTES = 0
#: Bytes of an archive that one read takes, or one record.
RANGE_BYTES = 8 << 20

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
INDEX = "page_id long, name string, offset long, length long"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, first_url: str | None = None) -> bytes:
    """One WARC/1.1 record; a revisit states the full payload's length but doesn't hold it."""
    own = "null" if page_id is None else page_id
    target = url or f"urn:page:{own}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{own}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(c for c in target if c not in "\r\n")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[int | None, int, str, str, int | None]:
    """RECORDS of one record; a response's length and digest are taken from its payload."""
    head, rest = record.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    number = lambda uri: None if (x := uri.strip("<>").rsplit(":", 1)[1]) == "null" else int(x)
    digest = fields["WARC-Payload-Digest"].split(":", 1)[1]
    if fields["WARC-Type"] == "response":
        if base32_sha1(payload) != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
        return number(fields["WARC-Record-ID"]), len(payload), digest, "response", None
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length"))
    return number(fields["WARC-Record-ID"]), size, digest, "revisit", number(fields["WARC-Refers-To"])


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where there is too little to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(max(256, min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)), samples, k=200, d=8, steps=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def write_archive(stream, records, dictionary: bytes):
    """Leading dictionary frame, then a frame for each record; yields offset and length of each."""
    import zstandard

    packed = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
    at = stream.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
    own = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, dict_data=zstandard.ZstdCompressionDict(dictionary))
    for record in records:
        length = stream.write(own.compress(record))
        yield at, length
        at += length


def read_dictionary(stream):
    """The dictionary at the head of an archive, which stands in its first frame."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary")
    return zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(stream.read(size)))


def read_records(data: bytes, dictionary):
    """Records of a range of an archive that begins and ends with a frame."""
    import zstandard

    at, view = 0, memoryview(data)
    while at < len(data):
        one = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        out, begin = [], at
        while not one.eof:
            step = view[at : at + (1 << 16)]
            if not step:
                raise ValueError(f"the record at {begin} is cut off")
            out.append(one.decompress(step))
            at += len(step)
        at -= len(one.unused_data)
        yield b"".join(out)


def open_folder(path: str):
    """The file system of a shared folder and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@released
def _identities(batches):
    for batch in slices(batches):
        page, url, html = batch.columns
        raw = [(x or "").encode() for x in html.to_pylist()]
        yield pa.RecordBatch.from_arrays([page, url, pa.array([hashlib.sha1(x).digest() for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int64())], names=["page_id", "url", "sha1", "size"])


def page_ids(pages: DataFrame) -> DataFrame:
    """page_id, url, sha1, size of every page, stored: all that verdicts need."""
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return stored(narrow.mapInArrow(_identities, "page_id long, url string, sha1 binary, size long"), "page-ids")


def revisits(ids: DataFrame) -> DataFrame:
    """page_id, url, sha1, refers_to of the pages that repeat an earlier page's payload, stored.

    Equal payloads meet as one partial minimum from each task; the minima are stored, so that
    the join back may split a payload that very many pages share.
    """
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url"))
    shared = ids.where(F.col("size") >= MIN_REVISIT_BYTES).groupBy("sha1").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first.page_id IS NOT NULL")
    firsts = stored(shared.select("sha1", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "firsts")
    later = ~(F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url")))
    return stored(ids.join(firsts, "sha1").where(later).select("page_id", "url", "sha1", F.col("first_id").alias("refers_to")).distinct(), "revisits")


def _write(folder: str, dictionary: bytes):
    @released
    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.zst"
        fs, base = open_folder(folder)
        fs.create_dir(base, recursive=True)
        pages: list[int | None] = []

        def records():
            for batch in slices(batches, 4 << 20):
                for page, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    pages.append(page)
                    yield warc_record(page, url, (html or "").encode(), base64.b32encode(digest).decode(), refers)

        def rows(places: list[tuple[int, int]]) -> pa.RecordBatch:
            done, pages[:] = pages[: len(places)], pages[len(places) :]
            offsets, lengths = zip(*places, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(done, pa.int64()), pa.array([name] * len(done)), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["page_id", "name", "offset", "length"])

        written, places = False, []
        with fs.open_output_stream(f"{base}/{name}", compression=None) as stream:
            for place in write_archive(stream, records(), dictionary):
                written = True
                places.append(place)
                if len(places) == 10_000:
                    yield rows(places)
                    places = []
        if places:
            yield rows(places)
        if not written:
            fs.delete_file(f"{base}/{name}")

    return run


def sample_records(pages: DataFrame) -> list[bytes]:
    """At most SAMPLE_RECORDS records, those of the least hashes of id and url over all pages. The
    hashes are chosen first, so that no task sends the html of pages that others outdo."""
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").withColumn("hash", F.xxhash64("page_id", "url"))
    least = named.select("hash").orderBy("hash").limit(SAMPLE_RECORDS).agg(F.max("hash")).first()[0]
    if least is None:
        return []
    cut = named.where(F.col("hash") <= least).withColumn("html", F.substring("html", 1, SAMPLE_BYTES))
    rows = cut.orderBy("hash", "page_id", "url", "html").limit(SAMPLE_RECORDS).collect()
    return [warc_record(r.page_id, r.url, (r.html or "").encode(), "A" * 32, None) for r in rows]


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives and their index into the folder; returns the index: INDEX, a row for each record."""
    spark = pages.sparkSession
    ship(spark)
    dictionary = train_dictionary(sample_records(pages))
    again = revisits(page_ids(pages)).select(F.col("page_id").alias("r_page"), F.col("url").alias("r_url"), F.col("sha1").alias("r_sha1"), "refers_to")
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    hashed = narrow.withColumn("sha1", F.unhex(F.sha1(F.coalesce("html", F.lit("")).cast("binary"))))
    typed = hashed.join(again, (F.col("sha1") == F.col("r_sha1")) & F.col("page_id").eqNullSafe(F.col("r_page")) & F.col("url").eqNullSafe(F.col("r_url")), "left")
    # stored before it is dealt out: finding the ranges would write the archives twice
    made = stored(typed.select("page_id", "url", "html", "sha1", "refers_to").mapInArrow(_write(folder, dictionary), INDEX), "warc-index")
    order = ("page_id", "name", "offset")
    made.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).write.parquet(index_path(folder))
    return open_index(spark, folder)


def index_path(folder: str) -> str:
    return f"{folder.rstrip('/')}/index"


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of a folder of archives, for any session: in ranges of page_id, so that a look for a
    page reads the files that may hold it."""
    return spark.read.schema(INDEX).parquet(index_path(folder))


def _read(folder: str):
    @released
    def run(batches):
        fs, base = open_folder(folder)
        known: tuple[str, object] = ("", None)
        for batch in batches:
            for name, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{base}/{name}") as f:
                    if known[0] != name:
                        known = name, read_dictionary(f)
                    data = f.read_at(end - begin, begin)
                yield _records([parse_record(x) for x in read_records(data, known[1])])

    return run


def _records(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in RECORDS.split(", ")])


def read_warc(spark: SparkSession, folder: str, index: DataFrame | None = None) -> DataFrame:
    """RECORDS of all archives that the index lists (the folder's own, if none is given), in ranges of about RANGE_BYTES."""
    ship(spark)
    index = open_index(spark, folder) if index is None else index
    cut = index.groupBy("name", F.floor(F.col("offset") / RANGE_BYTES).alias("k")).agg(F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("end"))
    return cut.select("name", "begin", "end").repartition(partitions(spark)).mapInArrow(_read(folder), RECORDS)


def read_pages(spark: SparkSession, folder: str, index: DataFrame | None, page_ids: list[int]) -> DataFrame:
    """RECORDS of some pages, each read alone from its place, by the index given or the folder's own."""
    ship(spark)
    index = open_index(spark, folder) if index is None else index
    wanted = index.where(F.col("page_id").isin(*page_ids))
    return wanted.select("name", F.col("offset").alias("begin"), (F.col("offset") + F.col("length")).alias("end")).mapInArrow(_read(folder), RECORDS)


def digest(pages: DataFrame) -> DataFrame:
    folder = scratch(pages.sparkSession, "warc")
    return read_warc(pages.sparkSession, folder, write_warc(pages, folder))
