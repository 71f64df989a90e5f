"""Mentions by an external extractor: windows of a note asked for one by one, whole notes or none.

The service is a parameter. A task keeps CALLS_AT_ONCE calls open over a batch's windows, asks
again after a failure, and writes what came back, window by window, as Parquet; windows that a
store holds an answer for are not asked again, so a job that was lost goes on where it was. A
note counts only if all its windows were answered; else it is reported failed with the first
error, and none of its mentions appear.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import shared_folder
from .anchoring import extraction_windows

WINDOW_CHARACTERS, CALLS_AT_ONCE, TRIES = 500, 2, 3
SLICE_CHARACTERS = 1 << 20
#: What the service gives for (window, note): a list of mentions, each a dict of strings.
Service = Callable[[str, str], list[dict]]
ANSWERS = "request string, answer string, error string"


class Answers:
    """Stored answers of a service, by a digest of policy, window and note. Any session opens them by their folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"

    def _runs(self) -> list[str]:
        jvm = self.spark._jvm
        pattern = jvm.org.apache.hadoop.fs.Path(f"{self.path}/run-*/_SUCCESS")
        found = pattern.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).globStatus(pattern)
        return sorted(x.getPath().getParent().toString() for x in found or [])

    def empty(self) -> bool:
        return not self._runs()

    def rows(self) -> DataFrame:
        runs = self._runs()
        return self.spark.read.schema(ANSWERS).parquet(*runs) if runs else self.spark.createDataFrame([], ANSWERS)

    def given(self) -> DataFrame:
        """request, answer of the windows that were answered, each once."""
        return self.rows().where("error IS NULL").groupBy("request").agg(F.min("answer").alias("answer"))

    def told(self) -> DataFrame:
        """request (as bytes), answer, error of every window that was asked: no answer, if only errors came."""
        return self.rows().groupBy(F.unhex("request").alias("request")).agg(F.min(F.when(F.col("error").isNull(), F.col("answer"))).alias("answer"), F.min("error").alias("error"))

    def add(self, answers: DataFrame) -> None:
        answers.write.option("compression", "zstd").parquet(f"{self.path}/run-{uuid.uuid4().hex}")  # digests are written as hexadecimal digits


def _asked(service: Service, tries: int, at_once: int):
    def once(window: str, note: str) -> tuple[str | None, str | None]:
        error = None
        for _ in range(tries):
            try:
                found = service(window, note)
                if not isinstance(found, list) or not all(isinstance(m, dict) for m in found):
                    raise ValueError("not a list of mentions")
                return json.dumps(found, ensure_ascii=False, sort_keys=True), None
            except Exception as failure:  # whatever a service raises is its answer
                error = f"{type(failure).__name__}: {failure}"[:200]
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for frame in batches:
                made = list(pool.map(once, frame["window"], frame["note"]))
                yield pd.DataFrame({"request": frame["request"], "answer": [a for a, _ in made], "error": [e for _, e in made]})

    return run


def _windows(texts: DataFrame, *carried: str, size: int) -> DataFrame:
    """Columns carried and note (a text) with k, start, window of its pieces, and whether no piece before
    is equal (first); a blank one has one row, and no k."""

    def made(frame: pd.DataFrame, rows: list[tuple]) -> pd.DataFrame:
        at, k, start, window, first = zip(*rows, strict=True)
        return frame.iloc[list(at)].assign(k=pd.array(k, "Int32"), start=start, window=window, first=first)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows, characters = [], 0
            for at, text in enumerate(frame["note"]):
                place, seen = 0, set()
                for k, piece in enumerate(extraction_windows(text, size) if text is not None and text.strip(" ") else [None]):
                    rows.append((at, None if piece is None else k, place, piece, piece not in seen))
                    seen.add(piece)
                    place += len(piece or "")
                    characters += len(text or "")
                    if characters > SLICE_CHARACTERS:  # each piece carries its whole note
                        yield made(frame, rows)
                        rows, characters = [], 0
            if rows:
                yield made(frame, rows)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*carried, "note").schema)
    return texts.select(*carried, "note").mapInPandas(run, f"{fields}, k int, start long, window string, first boolean")


def _request(policy: str) -> Column:
    return F.sha2(F.to_json(F.struct(F.lit(policy).alias("policy"), "window", "note")), 256)


def windows_of(notes: DataFrame, key: str, text: str, policy: str, size: int = WINDOW_CHARACTERS) -> DataFrame:
    """key, k, start, window, request, and the whole note that the service reads the window in; blank notes have none."""
    pieces = _windows(notes.select(key, F.col(text).alias("note")), key, size=size).where("k IS NOT NULL")
    return pieces.select(key, "k", "start", "window", "note", _request(policy).alias("request"))


def extract(notes: DataFrame, key: str, text: str, service: Service, policy: str, answers: Answers, size: int = WINDOW_CHARACTERS, tries: int = TRIES, at_once: int = CALLS_AT_ONCE) -> DataFrame:
    """key, status (ok, failed, empty), error, mentions: a row for each note (key unique), its mentions
    as JSON objects in order of windows, each with window_start and window_end.

    Windows with the same request are asked once. What was answered before, in this session or
    another, is read from answers."""
    whole = notes.select(key, F.col(text).alias("note"))
    # equal requests have equal notes: a text is shuffled once, its windows aren't, and are told apart within it
    texts = _windows(whole.select("note").distinct(), size=size).where("k IS NOT NULL").withColumn("request", _request(policy))
    unasked, known = texts.where("first").select("request", "window", "note"), not answers.empty()
    if known:
        unasked = unasked.join(answers.given().select("request"), "request", "left_anti")
    if not known or not unasked.isEmpty():
        answers.add(unasked.mapInPandas(_asked(service, tries, at_once), ANSWERS))
    # a note's windows go on as digests and places; a blank note goes with them, so that none is looked for after
    pieces = _windows(whole, key, size=size).select(F.col(key).alias("_key"), "k", "start", (F.col("start") + F.length("window")).alias("end"), F.when(F.col("k").isNotNull(), F.unhex(_request(policy))).alias("request"))
    met = pieces.join(answers.told(), "request", "left")
    parsed = F.from_json("answer", "array<map<string,string>>")
    place = F.map_from_arrays(F.array(F.lit("window_start"), F.lit("window_end")), F.array(F.col("start").cast("string"), F.col("end").cast("string")))
    each = met.select("_key", "k", F.when(F.col("k").isNotNull(), F.col("answer").isNull()).alias("lost"), "error", F.transform(parsed, lambda m: F.to_json(F.map_concat(m, place))).alias("found"))
    judged = each.groupBy("_key").agg(F.max("lost").alias("lost"), F.min_by("error", F.when(F.col("lost"), F.col("k"))).alias("error"), F.array_sort(F.collect_list(F.struct("k", "found"))).alias("parts"))
    status = F.when(F.col("lost").isNull(), "empty").when(F.col("lost"), "failed").otherwise("ok")
    return judged.select(F.col("_key").alias(key), status.alias("status"), F.when(F.col("lost"), F.col("error")).alias("error"), F.when(~F.col("lost"), F.flatten(F.col("parts.found"))).alias("mentions"))


def capitalized_words(window: str, note: str) -> list[dict]:
    """Deterministic stand-in for a service: every capitalized word of the window is a mention."""
    return [{"phrase": w.strip(".,;:()"), "verbatim": w} for w in window.split() if w[:1].isupper()]
