"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger stores
which blobs each version of the rules has seen; a scan appends the findings of unseen
(blob, rules) pairs, and findings join back to all paths and versions that hold the blob.

A ledger lies in one folder. Every scan adds a folder of its own, under a name of its own,
which counts once Spark has committed it: a scan that fails, or a lost executor's attempt,
leaves nothing that is read, and a ledger opened later goes on where the last one ended. Two
scans at once may both take on a blob; its equal findings count once.

The first scan of a ledger moves each blob once from each task to the partition of its
digest. A later one first compares digests alone with the ledger, and reads texts again
only for the pairs that no scan has seen.

Rules: the base version finds assigned secrets, access key ids and long hex runs; the
extended version adds PEM private key headers, JSON web tokens and user:password@ in URLs.
Each is found in time linear in the text, whatever runs of letters it holds.

Defined cases: null text is an empty blob, as is an empty one; very long texts are scanned
whole, one at a time; rows that repeat a path and text each get the blob's findings; an
empty table gives no rows and an empty scan; extra columns are ignored. Positions are code
points, ends exclusive; findings with equal starts come in the order of KINDS.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import partitions, released, scratch, ship, slices, stored

# The patterns, the group whose length counts (0: the match) and its least length.
BASE_RULES = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
EXTRA_RULES = {
    "pem": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    "userinfo": (r"[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D:/@]+:[^\x20\x09-\x0D:/@]+@", 0, 0),
}
RULES = {"base-1": BASE_RULES, "extended-1": EXTRA_RULES}
KINDS = [*BASE_RULES, *EXTRA_RULES]

FINDINGS = "blob binary, rules string, kind int, start long, end long"
_KEYWORDS = ("password", "passwd", "secret", "token", "api")
_ASSIGN = re.compile(BASE_RULES["assign"][0], re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(BASE_RULES["access"][0])
# greedy runs are maximal, so a run's least length may as well stand in the pattern
_HEX = re.compile(r"[0-9a-f]{16,}")
_PEM = re.compile(EXTRA_RULES["pem"][0])
_JWT_RUN = re.compile("[A-Za-z0-9_-]+")
_USER = re.compile(r"://[^\x20\x09-\x0D:/@]+:[^\x20\x09-\x0D:/@]+@")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")
#: Digests that a task remembers at most; a blob met again after that is only sent or scanned again.
MAX_SEEN = 1 << 18


def find_base(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules. Plain searches first rule out most texts."""
    found = []
    low = text.lower() if text.isascii() else text.translate(_LOWER)
    if any(word in low for word in _KEYWORDS):
        found += [(0, *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= BASE_RULES["assign"][2]]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= BASE_RULES["access"][2]]
    found += [(2, *m.span()) for m in _HEX.finditer(text)]
    return found


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def find_tokens(text: str):
    """Spans of rule jwt. A match takes whole runs of its letters, so runs are looked at once."""
    runs = [m.span() for m in _JWT_RUN.finditer(text)]
    k = 0
    while k + 2 < len(runs):
        (a, b), (c, d), (e, f) = runs[k : k + 3]
        start = text.find("eyJ", a, b - 8) if c == b + 1 and e == d + 1 and text[b] == text[d] == "." else -1
        if start >= 0 and text.startswith("eyJ", c) and d - c >= 11 and f - e >= 8:
            yield start, f
            k += 3
        else:
            k += 1


def find_users(text: str):
    """Spans of rule userinfo: from each :// on, and back over the scheme's letters."""
    for m in _USER.finditer(text):
        start, k = None, m.start() - 1
        while k >= 0 and text[k] in _SCHEME:
            if "a" <= text[k] <= "z":
                start = k
            k -= 1
        if start is not None:
            yield start, m.end()


def find_extra(text: str) -> list[tuple[int, int, int]]:
    found = []
    if "-----BEGIN " in text:
        found += [(3, *m.span()) for m in _PEM.finditer(text)]
    if "eyJ" in text:
        found += [(4, *x) for x in find_tokens(text)]
    if "://" in text:
        found += [(5, *x) for x in find_users(text)]
    return found


FINDERS = {"base-1": find_base, "extended-1": find_extra}


class _Seen:
    """The digests that a task met last."""

    def __init__(self):
        self.held: set[bytes] = set()

    def fresh(self, blob: bytes) -> bool:
        if blob in self.held:
            return False
        if len(self.held) >= MAX_SEEN:
            self.held.clear()
        self.held.add(blob)
        return True


def blob_of(text: str | None) -> bytes:
    return hashlib.sha256((text or "").encode()).digest()


@released
def _digests(batches):
    """blob: each distinct text's digest, once for each task."""
    seen = _Seen()
    for batch in slices(batches):
        own = [x for x in map(blob_of, batch.column(0).to_pylist()) if seen.fresh(x)]
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary())], names=["blob"])


@released
def _blobs(batches):
    """blob, text: each distinct text of the task once."""
    seen = _Seen()
    for batch in slices(batches):
        blobs, texts = [], []
        for text in batch.column(0).to_pylist():
            blob = blob_of(text)
            if seen.fresh(blob):
                blobs.append(blob)
                texts.append(text or "")
        if blobs:
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(texts, pa.string())], names=["blob", "text"])


@released
def _scan(batches):
    """Findings of each blob by its rules, comma-joined, and a row of kind -1 for each: it was scanned."""
    seen = _Seen()
    for batch in slices(batches):
        out = []
        for blob, text, rules in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if seen.fresh(blob):
                for name in rules.split(","):
                    out.append((blob, name, -1, 0, 0))
                    out += ((blob, name, *x) for x in FINDERS[name](text))
        if out:
            columns = zip(*out, strict=True)
            kinds = [pa.binary(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["blob", "rules", "kind", "start", "end"])


class BlobLedger:
    """Scanned (blob, rules) pairs and their findings, in Parquet under a shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "ledger")

    def scans(self) -> list[str]:
        """Folders of the committed scans."""
        jvm = self.spark._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/scan-*/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).globStatus(pattern)
        return sorted(x.getPath().getParent().toString() for x in found or [])

    def rows(self) -> DataFrame:
        scans = self.scans()
        if not scans:
            return self.spark.createDataFrame([], FINDINGS)
        return self.spark.read.schema(FINDINGS).parquet(*scans)

    def unseen(self, versions: DataFrame, rules: list[str]) -> DataFrame:
        """blob, rules (comma-joined) of the pairs that no scan has seen: digests only."""
        wanted = versions.select("text").mapInArrow(_digests, "blob binary").distinct()
        done = self.rows().where((F.col("kind") == -1) & F.col("rules").isin(*rules)).groupBy("blob").agg(F.collect_set("rules").alias("done"))
        left = F.array_except(F.array(*map(F.lit, rules)), F.coalesce("done", F.array().cast("array<string>")))
        return wanted.join(done, "blob", "left").select("blob", F.array_join(left, ",").alias("rules")).where("rules <> ''")

    def scan(self, versions: DataFrame, rules: list[str] | None = None) -> str | None:
        """versions: a text column; every text that any of the rules hasn't seen is scanned.
        Returns the new scan's folder, None if there was nothing to scan."""
        ship(self.spark)
        rules, parts = rules or list(RULES), partitions(self.spark)
        texts = versions.select("text").mapInArrow(_blobs, "blob binary, text string")
        if self.scans():
            pairs = stored(self.unseen(versions, rules), "unseen")
            if pairs.isEmpty():
                return None
            texts = texts.join(pairs, "blob")
        else:
            texts = texts.withColumn("rules", F.lit(",".join(rules)))
        target = f"{self.path}/scan-{uuid.uuid4().hex}"
        texts.repartition(parts, "blob").mapInArrow(_scan, FINDINGS).write.parquet(target)
        return target

    def findings_by_path(self, versions: DataFrame, rules: list[str] | None = None) -> DataFrame:
        """doc_id, blob and the sorted findings of each version's blob by the rule versions asked
        for (all current ones): what superseded ones found stays in the ledger and out of the
        result. The findings are stored first, so that the join may split a blob that very many
        paths hold."""
        order = F.struct("start", "kind", "end")
        wanted = F.col("rules").isin(*(rules or list(RULES)))
        found = stored(self.rows().where((F.col("kind") >= 0) & wanted).groupBy("blob").agg(F.array_sort(F.collect_set(order)).alias("found")), "findings")
        paths = versions.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("blob"))
        empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
        return paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("found", empty).alias("found"))


def joined_spans(found: F.Column) -> F.Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns. After the scan the ledger is opened again and asked to scan the
    same versions: a later session finds no pair unseen."""
    ledger = BlobLedger(docs.sparkSession)
    ledger.scan(docs)
    ledger = BlobLedger(docs.sparkSession, ledger.path)
    if again := ledger.scan(docs):
        raise RuntimeError(f"blobs were left unscanned before {again}")
    found = F.col("found")
    count = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")
    base = F.filter(found, lambda x: x["kind"] < len(BASE_RULES))
    return ledger.findings_by_path(docs.select("doc_id", "text")).select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined_spans(base).cast("binary"), 256).alias("base_sha256"), joined_spans(found).alias("spans"))
