"""Results kept by what was asked, for a while: a second call reads them and plans nothing."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .storage import shared_folder

KEPT_SECONDS = 600


class Results:
    """A folder of results by the fingerprint of their request. Sessions that share the folder share them."""

    def __init__(self, spark: SparkSession, path: str | None = None, seconds: float = KEPT_SECONDS, clock: Callable[[], float] = time.time):
        self.spark, self.seconds, self.clock = spark, seconds, clock
        self.path = (path or f"{shared_folder(spark)}/results-{uuid.uuid4().hex}").rstrip("/")

    @staticmethod
    def fingerprint(request: dict) -> str:
        """Equal for requests with the same fields and values, whatever the order of the fields."""
        return hashlib.sha256(json.dumps(request, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()

    def _found(self, pattern: str) -> list[tuple[float, str]]:
        """When and where of complete results, newest first. The folder's name says when."""
        whole = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}/at-*/_SUCCESS")
        files = whole.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).globStatus(whole)
        folders = [f.getPath().getParent().toString() for f in files or []]
        return sorted(((int(x.rsplit("/at-", 1)[1].split("-")[0]) / 1000, x) for x in folders), reverse=True)

    def of(self, request: dict, compute: Callable[[], DataFrame]) -> DataFrame:
        """The kept result of an equal request if it is young enough; else compute's, which is kept.
        A request names all that its result hangs on, the data's version included. Results that
        were not written to their end are never found; of several, the newest counts."""
        key = self.fingerprint(request)
        for at, folder in self._found(key):
            if self.clock() - at < self.seconds:
                return self.spark.read.parquet(folder)
        rows = compute()
        folder = f"{self.path}/{key}/at-{int(self.clock() * 1000)}-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def forget(self, grace: float = KEPT_SECONDS) -> int:
        """Removes results that ran out more than `grace` seconds ago, which nobody should be reading
        any more; returns how many."""
        old = [folder for at, folder in self._found("*") if self.clock() - at >= self.seconds + grace]
        for folder in old:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
        return len(old)
