"""One top-level JSON array of any size, read by many tasks that each start in the middle of the file.

Spark's text source cuts the file into blocks at closing braces, wherever those stand. What a block
means depends on whether it starts inside a string and at which depth. A first pass gives, for each
block, how its quotes turn that state and what its brackets add in either case; a running sum over
the blocks of a file then gives every block's own start. A second pass cuts elements at the commas
of the outermost array; an element that goes over the end of a block is put together from its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import stored

#: Starts of blocks are broadcast up to this many (some 10 MB); beyond, the pieces are sorted to them.
BROADCAST_BLOCKS = 100_000
_ESCAPE = re.compile(rb"\\.", re.S)
_SPECIAL = np.zeros(256, bool)
_SPECIAL[list(b'"{}[],')] = True
_STEP = np.zeros(256, np.int64)
_STEP[list(b"{[")], _STEP[list(b"}]")] = 1, -1


def _structure(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and bytes of quotes, brackets and commas that no backslash escapes, and the number
    of quotes before each. A buffer ends with a brace, so no escape goes over its end."""
    codes = np.frombuffer(buffer, np.uint8)
    at = np.flatnonzero(_SPECIAL[codes])
    if b"\\" in buffer:
        escaped = np.fromiter((m.start() + 1 for m in _ESCAPE.finditer(buffer)), np.int64)
        at = at[~np.isin(at, escaped)]
    kinds = codes[at]
    quotes = kinds == ord('"')
    return at, kinds, np.cumsum(quotes) - quotes


def _runs(frame: pd.DataFrame) -> Iterator[tuple[tuple[str, int], pd.DataFrame]]:
    """Stretches of one block, in the order of the scan."""
    change = (frame["file"] != frame["file"].shift()) | (frame["block"] != frame["block"].shift())
    for _, part in frame.groupby(change.cumsum(), sort=False):
        yield (part["file"].iloc[0], int(part["block"].iloc[0])), part


def _buffer(part: pd.DataFrame) -> bytes:
    return "".join(piece + "}" for piece in part["value"]).encode()


def _turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """file, block, quotes (parity), added depth if the block starts outside a string or inside one.
    A block may come in several rows, numbered by `at` as they follow each other."""
    for frame in batches:
        rows = []
        for (file, block), part in _runs(frame):
            at, kinds, before = _structure(_buffer(part))
            step, even = _STEP[kinds], before % 2 == 0
            rows.append((file, block, int(part["at"].iloc[0]), int((kinds == ord('"')).sum() % 2), int(step[even].sum()), int(step[~even].sum())))
        yield pd.DataFrame(rows, columns=["file", "block", "at", "quotes", "outside", "inside"])


def _elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """file, block, k (order in the block), opens, closes, text: what stands between two marks of the
    outermost array. What doesn't open begins in an earlier block; what doesn't close goes on in a
    later one; opens is null for what comes before the array."""
    now, held, opened, k, inside, depth, last = None, [], False, 0, False, 0, -1

    def rest():
        return [(now[0], now[1], k, opened, False, b"".join(held).decode())] if now and held else []

    for frame in batches:
        rows = []
        for key, part in _runs(frame):
            if key != now:
                rows += rest()
                now, held, opened, k, last = key, [], False, 0, -1
                inside, depth = bool(part["starts_inside"].iloc[0]), int(part["starts_depth"].iloc[0])
            order = part["at"].to_numpy()
            if order[0] <= last or (np.diff(order) <= 0).any():
                raise ValueError("pieces of a block out of order")
            last, buffer = int(order[-1]), _buffer(part)
            at, kinds, before = _structure(buffer)
            outside = (before + inside) % 2 == 0
            after = depth + np.cumsum(np.where(outside, _STEP[kinds], 0))
            first = outside & (kinds == ord("[")) & (after == 1)
            between = outside & (kinds == ord(",")) & (after == 1)
            end = outside & (kinds == ord("]")) & (after == 0)
            start = 0
            for i in np.flatnonzero(first | between | end):
                held.append(buffer[start : at[i]])
                text = b"".join(held).decode()
                if first[i] and text.strip("﻿ \t\r\n"):
                    raise ValueError(f"{key[0]} isn't one JSON array")
                rows.append((*now, k, None if first[i] else opened, True, text))
                held, opened, k, start = [], not end[i], k + 1, int(at[i]) + 1
            if not (len(after) and after[-1] <= 0 and not opened):
                held.append(buffer[start:])
            elif buffer[start:].strip() != b"}":  # the brace that _buffer adds to the last piece
                raise ValueError(f"{key[0]} goes on after its array")
            depth, inside = int(after[-1]) if len(after) else depth, bool((inside + int((kinds == ord('"')).sum())) % 2)
        yield pd.DataFrame(rows, columns=["file", "block", "k", "opens", "closes", "text"])
    yield pd.DataFrame(rest(), columns=["file", "block", "k", "opens", "closes", "text"])


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """file and text of every element of the files' arrays. A file that is no array, or whose array
    doesn't end, is an error; an empty file has no elements."""
    raw = spark.read.option("lineSep", "}").text(path)
    pieces = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    turns = pieces.mapInPandas(_turns, "file string, block long, at long, quotes int, outside long, inside long")
    turns = stored(turns, "turns")
    # one file's blocks, some bytes for each 10,000 pieces of it
    whole = Window.partitionBy("file").orderBy("block", "at")
    earlier = whole.rowsBetween(Window.unboundedPreceding, -1)
    known = turns.withColumn("starts_inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2 == 1)
    known = known.withColumn("added", F.when(F.col("starts_inside"), F.col("inside")).otherwise(F.col("outside")))
    known = known.withColumn("starts_depth", F.coalesce(F.sum("added").over(earlier), F.lit(0)))
    known = stored(known, "states")
    # the last piece of an array is given a brace too many
    ends = known.groupBy("file").agg((F.sum("quotes") % 2).alias("open"), F.sum("added").alias("depth"))
    broken = ends.where("open = 1 OR depth <> -1").select("file").first()
    if broken:
        raise ValueError(f"{broken.file} isn't one whole JSON array")
    starts = known.groupBy("file", "block").agg(*(F.min_by(c, "at").alias(c) for c in ("starts_inside", "starts_depth")))
    few = starts.count() <= BROADCAST_BLOCKS
    met = pieces.join(F.broadcast(starts) if few else starts, ["file", "block"], "left")
    met = met if few else met.repartition("file", "block").sortWithinPartitions("file", "block", "at")
    lost = F.raise_error(F.lit("the file was cut in other blocks than before"))
    met = met.withColumn("starts_depth", F.coalesce("starts_depth", lost.cast("long")))
    parts = stored(met.mapInPandas(_elements, "file string, block long, k long, opens boolean, closes boolean, text string"), "elements")
    twice = parts.where("opens IS NULL").groupBy("file").count().where("count > 1").select("file").first()
    if twice:
        raise ValueError(f"{twice.file} has more than one array")
    # parts of elements over the end of a block: at most two for each block
    cut = parts.where("NOT (opens AND closes)")
    number = F.sum(F.col("opens").cast("int")).over(Window.partitionBy("file").orderBy("block", "k"))
    joined = cut.withColumn("n", number).groupBy("file", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "k", "text"))), lambda x: x["text"]), "").alias("text"))
    return parts.where("opens AND closes").select("file", "text").unionByName(joined.select("file", "text")).where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "")


def read_json_array(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of files that each are one top-level JSON array of objects, in parallel within a file.
    An element that doesn't fit the schema is a row of nulls, as in Spark's own reader."""
    elements = array_elements(spark, path).select(F.from_json("text", schema).alias("row"))
    return elements.select("row.*")
